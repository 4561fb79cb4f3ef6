"""Vectorised word splitting and hashing over the UTF-8 bytes of whole Arrow columns.

Word separators are ASCII bytes, so splitting bytes is splitting text.  A word's first
16 bytes and its length go through a 64-bit mixer; a longer word is hashed by BLAKE2.
Windows are hashed as trees over word hashes.  Both have no algebraic structure that
would make texts of some form collide.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
#: Odd constants: for each of two independent word hashes four, and four for windows.
_WORD_KEYS = [[U64(int(x) | 1) for x in _RNG.integers(2**40, 2**63, 4, dtype=U64)] for _ in range(2)]
_JOIN_KEYS = [U64(int(x) | 1) for x in _RNG.integers(2**40, 2**63, 4, dtype=U64)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
_SHORT = 16

#: True where a byte belongs to a word: everything but space and \x09-\x0D.
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the result."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, size: int = 1 << 19):
    """Ranges of documents of about ``size`` bytes each; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = BLANK_SEPARATED):
    """Starts and ends of all words, and for each document the index of its first word."""
    w = is_word[data]
    before, after = np.zeros(len(w), bool), np.zeros(len(w), bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = False
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
    """64-bit hashes of words; ``second`` gives another, independent one."""
    if not len(starts):
        return np.zeros(0, U64)
    keys = _WORD_KEYS[second]
    raw = np.concatenate((_LOWER[data] if lower else data, np.zeros(24, np.uint8)))
    lanes = np.lib.stride_tricks.as_strided(raw[:8].view(U64), (len(data) + 16,), (1,))  # eight bytes from each place on
    n = ends - starts
    head = lanes[starts] & _MASKS[np.minimum(n, 8)]
    tail = lanes[starts + 8] & _MASKS[np.clip(n - 8, 0, 8)]
    out = mix(mix(head + keys[0]) * keys[1] + mix(tail + keys[2]) + n.astype(U64) * keys[3])
    for i in np.flatnonzero(n > _SHORT):
        digest = blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        out[i] = int.from_bytes(digest[8:] if second else digest[:8], "little")
    return out


def _joined(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    return mix(left * _JOIN_KEYS[0] + (right ^ (right >> U64(32))) * _JOIN_KEYS[1] + U64(size * int(_JOIN_KEYS[2]) % (1 << 64)))


def hash_windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i to i+k-1 for each i; windows over a document's end mean nothing.

    Runs of 1, 2, 4, ... words are joined to k by the binary digits of k.
    """
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, U64)
    out, done, run, size = None, 0, words, 1
    while True:
        if k & size:
            out = run if out is None else _joined(out[: len(run) - done], run[done:], done)
            done += size
        if done == k:
            return out[:n]
        run = _joined(run[: len(run) - size], run[size:], size)
        size *= 2


def hashed(column, lower: bool = False, size: int = 1 << 19, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all documents of a column, and the index of each one's first word."""
    data, offsets = utf8(column)
    hashes, first, seen = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
    for i, j in chunks(offsets, size):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, heads = word_spans(part, at)
        hashes.append(hash_words(part, starts, ends, lower, second))
        first.append(heads[1:] + seen)
        seen += len(starts)
    return np.concatenate(hashes), np.concatenate(first)
