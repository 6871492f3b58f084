"""Words of whole texts as hashes of 62 bits in 64, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .hashes import Stretches, mixed

#: Texts are hashed in blocks of about so many bytes; a longer text in parts cut at white space.
BLOCK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in UTF-8 bytes, A-Z lower-cased."""
    buf = np.frombuffer(joined.translate(_LOWER), dtype=np.uint8)
    inside = np.concatenate([[False], ~_SPACE[buf], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    return starts, Stretches(buf).of(starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)


def _long(data: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + 4 * BLOCK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_hashes(data[at:end])[1])
        at = end
    return np.concatenate(out)


def word_hashes(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(number, hashes of its words in order) of each text; null has no words."""
    held: list[bytes] = []
    first, size = 0, 0

    def flush():
        starts, h = _hashes(b" ".join(held))
        begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in held])])
        cuts = np.searchsorted(starts, begin)
        for k in range(len(held)):
            yield first + k, h[cuts[k] : cuts[k + 1]]

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > 4 * BLOCK:
            if held:
                yield from flush()
            yield i, _long(data)
            held, first, size = [], i + 1, 0
            continue
        held.append(data)
        size += len(data)
        if size >= BLOCK:
            yield from flush()
            held, first, size = [], i + 1, 0
    if held:
        yield from flush()


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows in order; fewer words make one window; no words none."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9DDFEA08EB382D69) + words[i : len(words) - k + 1 + i]
    return mixed(h + np.uint64(k * 0xC2B2AE3D27D4EB4F % 2**64))


def winnowed(h: np.ndarray, w: int, part: int = 1 << 22) -> np.ndarray:
    """Places of the least hash of each w neighbours, the leftmost of equal ones; of fewer hashes than w the least."""
    out = []
    for at in range(0, max(1, len(h) - w + 1), part):
        x = h[at : at + part + w - 1]
        if len(x):
            ranked = x >> np.uint64(24) << np.uint64(24) | np.arange(len(x), dtype=np.uint64)
            out.append((window_least(ranked, min(w, len(x))) & np.uint64((1 << 24) - 1)).astype(np.int64) + at)
    p = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    return p[np.concatenate([[True], p[1:] != p[:-1]])] if len(p) else p


def window_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours: block-wise running minima from both sides."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
