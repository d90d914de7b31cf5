"""Words of whole texts as numpy arrays, without a Python object for each word.

A batch of texts is taken as one byte buffer. Words become (start, end) places in it; a word's hash
takes in eight bytes a round, each round mixed into the one before, so words of up to eight bytes and one length never share
a hash. Hashes of k consecutive words are made of those of k / 2 words, and so on. Equal words have equal hashes in every
process and on every machine; where a hash decides over a result, bytes are compared too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a longer text is taken alone and whole).
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: True for the bytes of words that only ASCII white space separates.
PLAIN = ~_SPACE
_byte = np.arange(256)
#: True for the bytes of words of ASCII letters, digits and all that isn't ASCII.
ALNUM = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x41) & (_byte <= 0x5A)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)

#: A-Z as a-z, other bytes as they are.
_LOWER = _byte.astype(np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: The first 0 to 8 bytes of eight.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Rounds of eight bytes by numpy; what is longer is hashed word by word.
ROUNDS = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Octets:
    """Eight bytes from any place of a buffer on, as one number."""

    def __init__(self, buf: np.ndarray, lower: bool = False):
        self.data = np.zeros(len(buf) + 8, np.uint8)
        self.data[: len(buf)] = _LOWER[buf] if lower else buf
        self.at = np.ndarray(len(buf) + 1, "<u8", self.data, strides=(1,))

    def __call__(self, places: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next eight bytes; of fewer left, those."""
        return self.at[places] & _FIRST[np.minimum(left, 8)]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each run of bytes."""
        import xxhash

        left = ends - starts
        h = mix((left.astype(np.uint64) << np.uint64(8)) + np.uint64(seed + 1))
        h = mix(h ^ self(starts, left))
        some = np.flatnonzero(left > 8)
        for done in range(1, ROUNDS):
            if not len(some):
                return h
            h[some] = mix((h[some] + np.uint64(done)) ^ self(starts[some] + 8 * done, left[some] - 8 * done))
            some = some[left[some] > 8 * done + 8]
        for i in some.tolist():
            h[i : i + 1] = mix(h[i : i + 1] ^ np.uint64(xxhash.xxh3_64_intdigest(self.data[starts[i] : ends[i]])))
        return h

    def same(self, a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Whether the runs of ``left`` bytes from a and from b on are equal."""
        out = self(a, left) == self(b, left)
        some, done = np.flatnonzero(out & (left > 8)), 8
        while len(some):
            if done >= 8 * ROUNDS:
                for i in some.tolist():
                    out[i] = np.array_equal(self.data[a[i] : a[i] + left[i]], self.data[b[i] : b[i] + left[i]])
                break
            same = self(a[some] + done, left[some] - done) == self(b[some] + done, left[some] - done)
            out[some] = same
            done += 8
            some = some[same & (left[some] > done)]
        return out


@dataclass
class Words:
    """The words of some texts. Text d has the words first[d] to first[d + 1]."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        return Octets(self.buf, lower).hashes(self.starts, self.ends)

    def left(self, k: int) -> np.ndarray:
        """For each word, whether k words of the same text begin with it."""
        n = len(self.starts)
        out = np.zeros(n, bool)
        end = np.repeat(self.first[1:], self.counts())
        np.less_equal(np.arange(n) + k, end, out=out)
        return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    x = a ^ (a >> np.uint64(29))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each word on; 0 for the last k - 1. Texts aren't told apart here."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    if n >= k:
        made, size, whole, span = None, 0, hashes, 1
        while True:
            if k & span:
                made, size = (whole, span) if made is None else (_joined(made[: n - size - span + 1], whole[size:]), size + span)
            if size == k:
                break
            whole, span = _joined(whole[:-span], whole[span:]), 2 * span
        out[: n - k + 1] = mix(made + np.uint64(k))
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each place on; past the end there is nothing smaller."""
    out, span = x, 1
    while span < w:
        step = min(span, w - span)
        nxt = out.copy()
        if len(out) > step:
            np.minimum(out[:-step], out[step:], out=nxt[:-step])
        out, span = nxt, span + step
    return out


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """The words of the texts buf[offsets[d] : offsets[d + 1]]; offsets begin at 0."""
    inside = is_word[buf]
    begins, ends = inside.copy(), inside.copy()
    if len(buf):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[:-1][np.diff(offsets) > 0]
        begins[edge] = inside[edge]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return Words(buf, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets), offsets)


def texts_of(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of rows of at most limit bytes, or of one row. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64, count=n + 1, offset=8 * column.offset)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


#: What stands where no window begins.
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


def window_minima(w: Words, hashes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: for each window of ``length`` words of one text, by its first word, the least hash of its
    k-word grams, and whether such a window begins there. Equal windows have equal minima."""
    g = grams(hashes, k)
    g[~w.left(k)] = NOTHING
    return sliding_min(g, length - k + 1), w.left(length)


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n words lie in the runs of the given starts and lengths."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0
