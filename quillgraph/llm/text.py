"""Vectorised word kernels over Arrow string buffers.

Texts are never turned into Python strings here: the UTF-8 bytes of a batch are one numpy array, words
are found as runs of word bytes, and each word becomes a 64-bit polynomial hash.  Separators of all the
word definitions used in this package are ASCII, so working on bytes gives the same words as working on
code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one round of the kernels handles (a longer text is a round of its own).
ROUND_BYTES = 1 << 20

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def byte_class(separators: bytes) -> np.ndarray:
    """True for each byte value that belongs to a word."""
    table = np.ones(256, bool)
    table[np.frombuffer(separators, np.uint8)] = False
    return table


#: Words of [^\x20\x09-\x0D]+
SPACED = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after A-Z became a-z
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_BYTE_CODE = mix(np.arange(1, 257, dtype=U) * _MULT)
_power = np.ones(1, U)
_inverse = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _power
    if len(_power) < n:
        p = np.full(max(n, 2 * len(_power)), _MULT, U)
        p[0] = 1
        _power = np.cumprod(p, dtype=U)
    return _power[:n]


def inverse_powers(n: int) -> np.ndarray:
    """The inverses of :func:`powers`."""
    global _inverse
    if len(_inverse) < n:
        p = np.full(max(n, 2 * len(_inverse)), U(pow(int(_MULT), -1, 1 << 64)), U)
        p[0] = 1
        _inverse = np.cumprod(p, dtype=U)
    return _inverse[:n]


def rounds(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive groups of texts; null counts as empty."""
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for a in arrays:
        if a.null_count:
            a = pc.fill_null(a, "")
        a = a.cast(pa.large_string())
        n = len(a)
        if not n:
            continue
        _, off, data = a.buffers()
        off = np.frombuffer(off, np.int64)[a.offset : a.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + ROUND_BYTES, "right")) - 1)
            yield base + i, base + j, data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
        base += n


@dataclass
class Words:
    """Words of a group of texts: byte spans, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """For each word, the words from it to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def find_words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> Words:
    """Words of each text; ``data`` is folded by the caller if case is to be ignored."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge[:-1] | ~before))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    return Words(starts, ends, np.searchsorted(starts, off))


def hash_words(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(w.starts):
        return np.zeros(0, U)
    size = w.ends - w.starts
    total = np.zeros(len(data) + 1, U)
    # the weight of a byte is a power that counts from the start of its word
    begin = np.zeros(len(data), np.int64)
    begin[w.starts] = np.diff(w.starts, prepend=0)
    place = np.arange(len(data)) - np.cumsum(begin)
    np.clip(place, 0, int(size.max()) - 1, out=place)
    np.cumsum(_BYTE_CODE[data] * powers(int(size.max()))[place], out=total[1:], dtype=U)
    return mix(total[w.ends] - total[w.starts] + size.astype(U) * _M1)


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each place; the last n - 1 places are meaningless."""
    h = words.copy()
    for k in range(1, n):
        h *= _MULT
        if k < len(h):
            h[: len(h) - k] += words[k:]
    return mix(h)


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()
