"""Vectorised text primitives: words, their hashes and rolling hashes over whole Arrow batches.

Texts of a batch are taken together as one byte buffer; UTF-8 keeps ASCII separators apart from every other
byte, so splitting bytes splits characters. Hashes have 64 bits. Every step of eight bytes, and every step that joins the hashes of
two runs of words, ends in a mixing function that is not linear, so no family of unlike texts (such as Thue-Morse
strings, for polynomials modulo 2**64) has equal hashes but by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64

#: Byte tables: True where a byte belongs to a word.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_G, _C = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: For 0 to 8 bytes, the bits of a little-endian word that they fill.
_FILLED = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
#: Words of more bytes are hashed by BLAKE2b, one by one.
LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """A-Z, and the capital letters U+00C0 to U+00DE, in lower case."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    if len(buf) > 1:
        second = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[second] += 32
    return out


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most limit bytes of text, or a single row: no text is cut."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


class Words:
    """Words of a slice: start and end bytes, hashes, and each text's first word (first[i] to first[i + 1])."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, table: np.ndarray = NOT_SPACE, lower: bool = False):
        self.raw, self.off = buf, off
        self.buf = LOWER[buf] if lower else buf
        n = len(buf)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(off), np.int64)
            return
        inside = table[self.buf]
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        before[off[:-1][off[:-1] < n]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        last = off[1:] - 1
        after[last[last >= 0]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def loads(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first 8 bytes (or size, if less) from each place, as little-endian numbers."""
        if not hasattr(self, "padded"):
            self.padded = np.concatenate((self.buf, np.zeros(8, np.uint8)))
        view = np.ndarray(len(self.buf) + 1, "<u8", self.padded, strides=(1,))
        return view[at] & _FILLED[np.clip(size, 0, 8)]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: eight at a time."""
        if not len(self):
            return np.zeros(0, U)
        size = self.end - self.start
        h = mix(self.loads(self.start, size) + size.astype(U) * _G)
        more, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(more):
            h[more] = join(h[more], self.loads(self.start[more] + done, size[more] - done))
            done += 8
            more = more[size[more] > done]
        raw = memoryview(self.buf)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(raw[self.start[i] : self.end[i]], digest_size=8).digest(), "little")
        return h


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of what two hashes stand for, one after the other."""
    return mix(left * _C + right)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values; len(h) - k + 1 of them (none if there are fewer values).

    Runs of 1, 2, 4 and so on values are joined to runs of k.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, at, level, width = None, 0, h, 1
    while True:
        if k & width:
            part = level[at : at + n]
            out, at = (part if out is None else join(out, part)), at + width
        if at == k:
            return mix(out) if k == 1 else out
        level, width = join(level[:-width], level[width:]), 2 * width


def word_hash(word: str) -> int:
    """The hash that Words gives this word."""
    raw = word.encode()
    return int(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), np.ones(256, bool)).hashes()[0])


def starts_of(first: np.ndarray, k: int) -> np.ndarray:
    """The word indexes where k consecutive words of one text start."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return np.arange(total) + skip


def argmin_window(h: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive values, the index of the smallest one, the last of equals."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, width = np.arange(len(h), dtype=np.int32), 1
    value = h
    while width < w:
        step = min(width, w - width)
        left_i, right_i = best[: len(best) - step], best[step:]
        left, right = value[: len(value) - step], value[step:]
        take = right <= left
        best, value = np.where(take, right_i, left_i), np.where(take, right, left)
        width += step
    return best


def large(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
