"""Words of Arrow text columns as NumPy arrays, without a Python object per word."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def parts(batch: pa.RecordBatch, column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """batch in slices of about most_bytes of the text column; a longer text is a slice of its own."""
    _, offsets = column_bytes(batch.column(column))
    begin = 0
    while begin < len(batch):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most_bytes, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: none) and the offsets of its rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the number of words before each row (one more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    letter = ~SPACE[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]  # a row's end also ends a word
    first[edges] = letter[edges]
    last[edges - 1] = letter[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: longer words are hashed one by one
LONG_WORD = 512
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words: eight bytes at a time go through a finaliser that starts from the length.

    Words of up to eight bytes never collide with others of their length; other pairs do by chance, once in 2^64.
    """
    n = (ends - starts).astype(np.int64)
    h = mixed(n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
    if not len(n):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    who, at = np.flatnonzero(n <= LONG_WORD), starts
    while len(who):
        left = ends[who] - at[who] if at is starts else ends[who] - at
        place = starts[who] if at is starts else at
        h[who] = mixed(h[who] ^ (lanes[place] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        who, at = who[more], place[more] + 8
    for i in np.flatnonzero(n > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives memory that it no longer uses back to the system: idle workers stay alive beside others."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied
