"""Hashes of stretches of bytes from prefix sums: polynomials modulo the prime 2^31 - 1 in two fixed random bases.

Modulo a power of two, words built from a doubling sequence collide under every odd base. Modulo a prime two different
stretches of n bytes collide under a random base with a probability of n / 2^31 at most, independently for each base.
"""

from __future__ import annotations

import numpy as np

PRIME = (1 << 31) - 1
#: Bytes whose terms are summed up before the sum is reduced: 2^24 terms below 2^39.
_SEGMENT = 1 << 24


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of a base and of its inverse modulo the prime, as far as needed."""

    def __init__(self, base: int):
        self.bases = {"up": base, "down": pow(base, -1, PRIME)}
        self.up = self.down = np.ones(1, dtype=np.uint32)

    def need(self, n: int) -> None:
        for name, base in self.bases.items():
            x = getattr(self, name)
            while len(x) < n:  # doubled
                step = np.uint64(pow(base, len(x), PRIME))
                x = np.concatenate([x, (x * step % np.uint64(PRIME)).astype(np.uint32)])
            setattr(self, name, x)


def _bases(seed: int) -> tuple[Powers, Powers]:
    a, b = np.random.Generator(np.random.PCG64(seed)).integers(1 << 20, PRIME - 1, 2).tolist()
    return Powers(a), Powers(b)


#: Two independent pairs of bases.
FIRST, SECOND = _bases(1), _bases(2)


class Stretches:
    """62 bits for each stretch of an array of bytes."""

    def __init__(self, buf: np.ndarray, pair: tuple[Powers, Powers] = FIRST):
        n = len(buf)
        v = buf.astype(np.uint64) + np.uint64(1)
        self.pair, self.sums = pair, []
        for p in pair:
            p.need(n + 1)
            s = np.zeros(n + 1, dtype=np.uint64)
            for at in range(0, n, _SEGMENT):
                to = min(n, at + _SEGMENT)
                np.cumsum(v[at:to] * p.up[at:to], out=s[at + 1 : to + 1])
                s[at + 1 : to + 1] += s[at] % np.uint64(PRIME)
            self.sums.append(s)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each buf[start:end], its length included."""
        m = np.uint64(PRIME)
        h = np.zeros(len(start), dtype=np.uint64)
        for p, s in zip(self.pair, self.sums, strict=True):
            h = h << np.uint64(31) | (s[end] % m + m - s[start] % m) % m * p.down[start] % m
        return mixed(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
