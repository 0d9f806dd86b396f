"""Vectorised word hashing over Arrow string buffers.

Everything here works on one Arrow batch with numpy and never builds a Python
string per word.  A word's hash is a polynomial over random 64-bit byte codes,
finished with a mixer, so it depends on the word's bytes alone and is equal on
every executor.  The buffer is walked in slices cut at separators, so memory
beyond the batch itself stays at a few MB however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a uint64 array."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt))


_CODE = seeds(256, 77) | _U(1)
_BASE = 0x5851F42D4C957F2D
_pow = np.ones(1, _U)
_inv = np.ones(1, _U)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes that are part of a word: anything but ASCII white space
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: letters, digits and every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def _powers(n: int) -> None:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, _SLICE + 2)
        p = np.full(size, _U(_BASE))
        q = np.full(size, _U(pow(_BASE, -1, 1 << 64)))
        p[0] = q[0] = 1
        _pow, _inv = np.cumprod(p, dtype=_U), np.cumprod(q, dtype=_U)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED, heads: tuple[int, ...] = ()) -> tuple:
    """Hashes of the words of all texts, where each begins and ends, and the texts' offsets in them.

    A-Z count as a-z; a word never crosses from one text into the next.  With heads, a fifth
    item has for each length k in heads the hash of each word's first k bytes, 0 for words of k bytes or fewer."""
    n = len(buf)
    inside = kind[buf]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] |= inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] |= inside[cuts - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(begin), _U)
    first_of = [np.zeros(len(begin), _U) for _ in heads]
    at = 0
    while at < len(begin):
        upto = max(int(np.searchsorted(end, begin[at] + _SLICE, side="right")), at + 1)
        lo, hi = begin[at], end[upto - 1]
        _powers(int(hi - lo) + 1)
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(_CODE[LOWER[buf[lo:hi]]] * _pow[: hi - lo], out=total[1:])
        b = begin[at:upto] - lo
        out[at:upto] = mix((total[end[at:upto] - lo] - total[b]) * _inv[b])
        for k, head in zip(heads, first_of):
            long = np.flatnonzero(end[at:upto] - lo - b > k)
            head[at + long] = mix((total[b[long] + k] - total[b[long]]) * _inv[b[long]] + _U(k))
        at = upto
    found = out, begin, end, np.searchsorted(begin, offsets)
    return (*found, first_of) if heads else found


def shingles(words: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words in each text (with repeats), and the texts' offsets.

    A text of fewer than k words has one shingle, its whole sequence; one without words has none."""
    counts = np.diff(offs)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_offs = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(out_offs[-1], _U)
    m = _U(0xD6E8FEB86659FD93)
    if len(words) >= k:
        whole = np.zeros(len(words) - k + 1, _U)
        for j in range(k):
            whole = whole * m + words[j : len(words) - k + 1 + j]
        text = np.repeat(np.arange(len(counts)), made * (counts >= k))
        rank = np.arange(len(text)) - np.concatenate([[0], np.cumsum(made * (counts >= k))])[text]
        out[out_offs[text] + rank] = mix(whole[offs[text] + rank] + _U(k))
    for short in range(1, k):
        which = np.flatnonzero(counts == short)
        if len(which):
            acc = np.zeros(len(which), _U)
            for j in range(short):
                acc = acc * m + words[offs[which] + j]
            out[out_offs[which]] = mix(acc + _U(short))
    return out, out_offs


def distinct(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text."""
    parts = [np.unique(values[a:b]) for a, b in zip(offs[:-1], offs[1:])]
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)


def groups(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of texts of about `most` bytes each; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        upto = max(int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1, at + 1)
        yield at, upto
        at = upto
