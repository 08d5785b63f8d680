"""Vectorised word kernel over Arrow string columns.

Texts are handled as UTF-8 bytes. All word classes used here are defined by
ASCII separators, so splitting on bytes equals splitting on code points.
A word's identity is a 64-bit hash: a polynomial over the bytes, evaluated
with one running sum for a whole block and passed through a finaliser.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SEG = 1 << 20
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, in place on a fresh array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mix_int(x: int) -> int:
    x &= _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U(pow(base, k, 1 << 64))
        k += m
    return out


_G = 0x9E3779B97F4A7C15
_Q = 0xD1342543DE82EF95
_tables: dict = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = _tables[base] = (_powers(base, size), _powers(pow(base, -1, 1 << 64), size))
    return have


_VALUE = mix(np.arange(1, 257, dtype=U) * U(_G))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Separators of words that hold ASCII letters, digits and all non-ASCII characters.
_NOTALNUM = np.zeros(256, bool)
_NOTALNUM[[*range(0, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


class Words:
    """Words of a block of texts.

    buf: bytes of all texts; at: byte offsets of texts (n + 1); start, end:
    byte offsets of words in buf; key: 64-bit hashes; ofs: index of each
    text's first word (n + 1); doc: text index of each word.
    """

    __slots__ = ("buf", "at", "start", "end", "key", "ofs", "doc")

    def __init__(self, buf: np.ndarray, at: np.ndarray, lower: bool = True, alnum: bool = False) -> None:
        """lower: fold A-Z before hashing (buf itself keeps its case)."""
        seps = _NOTALNUM if alnum else _SPACE
        if alnum and lower:
            seps = seps.copy()
            seps[65:91] = False
        value = _VALUE[_LOWER] if lower else _VALUE
        starts, ends, keys = [], [], []
        sep = seps[buf]
        sep_edge = np.ones(len(buf) + 1, bool)
        if len(buf):
            sep_edge[1:-1] = sep[:-1]
            sep_edge[at[:-1][at[:-1] < len(buf)]] = True
            first = sep_edge[:-1] & ~sep
            last = np.ones(len(buf), bool)
            last[:-1] = sep[1:]
            cut = at[1:-1]
            last[cut[cut > 0] - 1] = True
            last &= ~sep
            self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        a = 0
        n = len(self.start)
        while a < n:  # in segments, so that memory follows the segment and not the text
            b = int(np.searchsorted(self.start, self.start[a] + _SEG, "left"))
            lo, hi = int(self.start[a]), int(self.end[b - 1])
            up, down = powers(_G, hi - lo + 1)
            run = np.empty(hi - lo + 1, U)
            run[0] = 0
            np.cumsum(value[buf[lo:hi]] * up[: hi - lo], out=run[1:])
            s, e = self.start[a:b] - lo, self.end[a:b] - lo
            keys.append(mix((run[e] - run[s]) * down[s]))
            a = b
        self.buf, self.at = buf, at
        self.key = np.concatenate(keys) if keys else np.zeros(0, U)
        self.ofs = np.searchsorted(self.start, at).astype(np.int64)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.ofs))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of every run of k words within one text."""
        n = len(self.key)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        i = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return i, runs(self.key, k)[i]


def runs(key: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive keys."""
    out = np.zeros(len(key) - k + 1, U)
    for j in range(k):
        out += key[j : len(key) - k + 1 + j] * U(mix_int(_Q * (j + 1)) | 1)
    return mix(out)


def text_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    bufs = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(bufs[1], np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


_give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give memory that is no longer used back to the system. Workers outlive
    their tasks, and else keep what the largest of them took."""
    pa.default_memory_pool().release_unused()
    if _give_back:
        _give_back(0)


def blocks(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows of at most `most` bytes, or one row."""
    buf, at = text_arrays(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, buf[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def codepoints(buf: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte (length + 1)."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


def word_array(buf: np.ndarray, at: np.ndarray, also: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """The words of a block of texts one after the other, as bytes, and the
    index of each text's first word (n + 1). also: bytes before which a word is
    cut as well."""
    keep = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True  # a text's end ends its last word
    if also is not None:
        edge[:-1] |= also
    first = keep.copy()
    first[1:] &= ~keep[:-1] | edge[1:-1]
    last = keep.copy()
    last[:-1] &= ~keep[1:] | edge[1:-1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    ofs = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first + 1, out=ofs[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ofs), pa.py_buffer(buf[keep])])
    return words, np.searchsorted(first, at).astype(np.int64)
