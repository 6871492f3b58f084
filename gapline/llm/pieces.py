"""Texts to token ids through distinct pieces.

A text is cut where every match of the byte-level pre-tokenizer must end: before a single space or line break between two
known characters, and between letters, digits and punctuation. Known are ASCII and the letters of U+00C0 to U+017F, but for
U+0130 (two characters in lower case); apostrophes (contractions) and all else are never cut at. Whatever lies between two
cuts is a piece, coded by itself by the caller's tokenizer; a distinct piece is coded once and its ids are gathered for every place it stands at. Equal pieces are found by a hash, and
their bytes are compared before one takes the ids of another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd

from .hashes import Stretches

#: Texts are handled in blocks of about so many bytes; longer texts are cut at a space between ASCII letters.
BLOCK = 1 << 20
#: Distinct pieces remembered by a worker; beyond that it starts anew.
REMEMBERED = 1_500_000

_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 unknown, 1 letter, 2 digit, 3 punctuation, 4 space, 5 line break
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 3
_CLASS[32], _CLASS[10] = 4, 5


def parts(text: str, most: int = BLOCK) -> Iterator[str]:
    """`text` in parts of about `most` characters, cut at single spaces between ASCII letters."""
    at = 0
    while len(text) - at > 2 * most and (cut := _CUT.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def blocks(texts: Iterable[str | None], most: int = BLOCK) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers of texts and parts of texts as UTF-8, together about `most` bytes."""
    at: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        for part in parts(text or ""):
            at.append(i)
            held.append(part.encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= most:
                yield at, held
                at, held, size = [], [], 0
    if held:
        yield at, held


def cut_places(buf: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes at which pre-tokenizer matches end for certain."""
    c = _CLASS[buf]
    latin = np.flatnonzero((buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC5) & (buf[1:] != 0x97) & (buf[1:] != 0xB7) | (buf[:-1] >= 0xC4) & (buf[:-1] <= 0xC5))
    latin = latin[(buf[latin] != 0xC4) | (buf[latin + 1] != 0xB0)]
    c[latin] = 1
    c[latin + 1] = 1
    known = (c >= 1) & (c <= 3)
    a, b = c[:-1], c[1:]
    cut = known[:-1] & known[1:] & (a != b)
    before = known[:-1] & (b == 5)
    before[:-1] |= known[:-2] & (b[:-1] == 4) & known[2:]
    after = np.zeros_like(cut)
    after[1:] = (a[1:] == 5) & known[:-2] & known[2:]
    return np.flatnonzero(cut | before | after) + 1


def gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all stretches, one stretch after the other."""
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - (upto - size), size)


class _Store:
    """Numbers of known pieces by hash, in sorted arrays, and their values end to end."""

    KINDS = (("piece", np.uint8), ("ids", np.uint32), ("bytes", np.uint8))

    def __init__(self):
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.entry = np.zeros(0, dtype=np.int32)
        self.begin = {k: np.zeros(0, dtype=np.int64) for k, _ in self.KINDS}
        self.size = {k: np.zeros(0, dtype=np.int32) for k, _ in self.KINDS}
        self.flat = {k: np.zeros(0, dtype=dtype) for k, dtype in self.KINDS}
        self.used = dict.fromkeys(self.flat, 0)

    def find(self, h: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of known pieces, -1 for others: those whose hash is known and whose bytes are the same."""
        if not len(self.hashes):
            return np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        entry = np.where(self.hashes[at] == h, self.entry[at], -1).astype(np.int64)
        entry[(entry >= 0) & (self.size["piece"][entry] != size)] = -1
        met = np.flatnonzero(entry >= 0)
        n = size[met]
        same = buf[gathered(start[met], n)] == self.flat["piece"][gathered(self.begin["piece"][entry[met]], n)]
        if not same.all():
            entry[met[np.repeat(np.arange(len(met)), n)[~same]]] = -1
        return entry

    def add(self, h: np.ndarray, values: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """`values`: of each kind all values end to end and their number for each piece."""
        n = len(self.entry)
        number = np.arange(n, n + len(h), dtype=np.int32)
        order = np.argsort(h)
        at = np.searchsorted(self.hashes, h[order])
        self.hashes, self.entry = np.insert(self.hashes, at, h[order]), np.insert(self.entry, at, number[order])
        for kind, dtype in self.KINDS:
            new, size = values[kind]
            used = self.used[kind]
            if used + len(new) > len(self.flat[kind]):
                self.flat[kind] = np.concatenate([self.flat[kind][:used], np.zeros(max(used // 2, len(new), 1 << 16), dtype=dtype)])
            self.flat[kind][used : used + len(new)] = new
            self.begin[kind] = np.concatenate([self.begin[kind], used + np.cumsum(size) - size])
            self.size[kind] = np.concatenate([self.size[kind], size.astype(np.int32)])
            self.used[kind] = used + len(new)
        return number.astype(np.int64)


class PieceCoder:
    """encode_pieces: distinct pieces as bytes to their `ids` and, where they are asked for, decoded `bytes`: of each kind all
    values end to end and their number for each piece."""

    def __init__(self, encode_pieces: Callable[[list[bytes]], dict[str, tuple[np.ndarray, np.ndarray]]], remembered: int = REMEMBERED, whole: Iterable[bytes] = (), most: int = BLOCK, loose: bool = False):
        """`whole`: literals that are never cut; `most`: bytes of text at once; `loose`: spaces and the case of letters are
        nothing to the tokenizer, so pieces that differ in them are one."""
        self.most, self.loose = most, loose
        self.encode_pieces, self.remembered, self.known, self.whole = encode_pieces, remembered, _Store(), tuple(whole)

    def block(self, held: list[bytes], decode: bool = False) -> tuple[list[np.ndarray], list[bytes]]:
        """The ids of each text and, with `decode`, the bytes they stand for."""
        joined = b"\xff".join([b"", *held, b""])  # 0xff is in no UTF-8 text
        buf = np.frombuffer(joined, dtype=np.uint8)
        lengths = np.array([len(x) for x in held], dtype=np.int64)
        first = np.cumsum(lengths + 1) - lengths  # places where texts start
        cuts = cut_places(buf)
        for literal in self.whole:
            at = joined.find(literal)
            while at >= 0:
                a, b = np.searchsorted(cuts, [at + 1, at + len(literal)])
                cuts = np.delete(cuts, slice(a, b))
                at = joined.find(literal, at + len(literal))
        starts = np.concatenate([first[lengths > 0], cuts])
        starts.sort()
        starts = starts[np.concatenate([[True], starts[1:] != starts[:-1]])] if len(starts) else starts
        text_of = np.searchsorted(first, starts, side="right") - 1
        ends = np.minimum(np.concatenate([starts[1:], [len(buf)]]), (first + lengths)[text_of]) if len(starts) else starts
        if self.loose:  # a letter before ASCII: one before a combining character may be another letter in lower case
            upper = np.flatnonzero((buf[:-1] >= 65) & (buf[:-1] <= 90) & (buf[1:] < 0x80))
            buf = buf.copy()
            buf[upper] += 32
            joined = buf.tobytes()
            starts = starts + ((buf[starts] == 32) & (ends - starts > 1))
        size = ends - starts
        h = Stretches(buf).of(starts, ends)
        codes, first_of = self._equal(h, buf, starts, size)
        if len(self.known.entry) > self.remembered:
            self.known = _Store()
        entry = self.known.find(h[first_of], buf, starts[first_of], size[first_of])
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            at = first_of[missing]
            pieces = [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            values = self.encode_pieces(pieces)
            entry[missing] = self.known.add(h[at], {"bytes": (buf[:0], np.zeros(len(at), dtype=np.int64))} | values | {"piece": (buf[gathered(starts[at], size[at])], size[at])})
        entry = entry[codes]
        return self._gather("ids", entry, text_of, len(held)), [x.tobytes() for x in self._gather("bytes", entry, text_of, len(held))] if decode else []

    @staticmethod
    def _equal(h: np.ndarray, buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each piece, the same for equal ones, and the first piece of each number."""
        if not len(h):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        codes, _ = pd.factorize(h.view(np.int64))
        first_of = np.flatnonzero(np.concatenate([[True], codes[1:] > np.maximum.accumulate(codes)[:-1]]))
        like = first_of[codes]
        if (size == size[like]).all() and (buf[gathered(starts, size)] == buf[gathered(starts[like], size)]).all():
            return codes, first_of
        codes, _ = pd.factorize(np.array([buf[s : s + n].tobytes() for s, n in zip(starts.tolist(), size.tolist(), strict=True)], dtype=object))
        return codes, np.flatnonzero(np.concatenate([[True], codes[1:] > np.maximum.accumulate(codes)[:-1]]))

    def _gather(self, kind: str, entry: np.ndarray, text_of: np.ndarray, n: int) -> list[np.ndarray]:
        each = self.known.size[kind][entry].astype(np.int64)
        values = self.known.flat[kind][gathered(self.known.begin[kind][entry], each)]
        ends = np.cumsum(np.bincount(text_of, weights=each, minlength=n).astype(np.int64)) if n else np.zeros(0, dtype=np.int64)
        return np.split(values, ends[:-1]) if n else []

    def encode(self, texts: list[str | None], decode: bool = False) -> Iterator[tuple[int, list[np.ndarray], list[bytes]]]:
        """(number, ids, decoded bytes) of each text in order, in parts for long texts joined again."""
        at, ids, back = -1, [], []
        for numbers, held in blocks(texts, self.most):
            got, decoded = self.block(held, decode)
            for k, i in enumerate(numbers):
                if i != at and at >= 0:
                    yield at, ids, back
                    ids, back = [], []
                at = i
                ids.append(got[k])
                if decode:
                    back.append(decoded[k])
        if at >= 0:
            yield at, ids, back
