"""Cost-balanced packing of documents into token sequences.

A document is its token ids and an end id.  The cost of a piece of n tokens is LINEAR * n + QUADRATIC * n * n (the
matrix products and the attention inside the piece).  Full sequences are cut from the front of documents longer than
a sequence.  What is left is packed in windows of some WINDOW_TOKENS: pieces in descending order go to the lowest-cost
sequence with enough room; one that fits nowhere is cut, its front filling the roomiest sequence.  The sequences of a
window hold exactly its tokens: as many full ones as there are, and for the rest one for each power of two in its
binary form, so that nothing is padded.

Windows are consecutive documents of one input split, so no document moves between machines, memory is bounded by the
window (or by one very long document), and a lost task is simply done again.  Sequence ids are the split's number
times 2^33 and a counter.

Tokenising: this tokenizer lower-cases, and never joins across ASCII white space nor between ASCII letters and punctuation.
So texts are cut there, and the ids of each part come from a cache in each worker, by the part itself and bounded in bytes:
each distinct one is encoded about once per worker.  Tests hold this against whole texts.

Nulls: a null or empty text is the end id alone; a null id stays null; equal rows are packed separately.  Empty tables
give empty results; other columns are ignored.  Ties: equal pieces go in the order of their documents, equal costs to the
first sequence; a very long text is a window of its own and is cut into full sequences.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import importable
from .common import table
from .textbytes import LOWER, SPACE, column_bytes, parts, tidy

SEQUENCE, END_ID, WINDOW_TOKENS = 2048, 1, 2_000_000
#: a worker forgets its words when they take about so much memory
CACHE_BYTES, BYTES_PER_WORD = 256_000_000, 200
LINEAR, QUADRATIC = 1.0, 1 / 1024

_encoders: dict[str, WordEncoder] = {}


#: ASCII punctuation but the apostrophe and "<": between it and an ASCII letter or digit the tokenizer always cuts
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[ord(c) for c in '!"#$%&()*+,-./:;=?@[\\]^_`{|}~>']] = True
_ALNUM[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def word_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, cut at ASCII punctuation, and their number before each row."""
    letter = ~SPACE[data]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    mark, alnum = _MARK[data], _ALNUM[data]
    first[1:] |= mark[1:] & alnum[:-1] | alnum[1:] & mark[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = letter[edges]
    last[:-1] &= ~letter[1:] | first[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


class WordEncoder:
    """Token ids of texts by a tokenizer file, through a cache of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.size, self.used = 0, 0
        self.begin, self.count, self.flat = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        have, more = len(self.place), int(count.sum())
        self.begin, self.count, self.flat = grown(self.begin, have + len(ids)), grown(self.count, have + len(ids)), grown(self.flat, self.used + more)
        self.begin[have : have + len(ids)] = np.cumsum(count) - count + self.used
        self.count[have : have + len(ids)] = count
        self.flat[self.used : self.used + more] = np.fromiter(chain.from_iterable(ids), np.uint32, more)
        self.place.update(zip(words, range(have, have + len(ids))))
        self.used += more
        self.size += sum(map(len, words)) + 4 * more + BYTES_PER_WORD * len(words)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of the texts in them."""
        data, offsets = column_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if b"<|" in data.tobytes():  # maybe a special token, whose letters' case matters
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.append(0, np.cumsum([len(i) for i in ids]))
        data = LOWER[data]
        starts, ends, before = word_parts(data, offsets)
        bounds = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
        # the words' bytes without what is between them; Arrow numbers the distinct ones
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[~SPACE[data]])]).dictionary_encode()
        if self.size > CACHE_BYTES:
            self.clear()
        distinct = words.dictionary.to_pylist()
        known = list(map(self.place.get, distinct))
        new = [w for w, k in zip(distinct, known) if k is None]
        if new:
            self.learn(new)
            known = list(map(self.place.get, distinct))
        place = np.array(known, np.int64)[words.indices.to_numpy()]
        n = self.count[place]
        last = np.cumsum(n)
        out = self.flat[np.repeat(self.begin[place] - (last - n), n) + np.arange(int(n.sum()))]
        return out, np.append(0, last)[before]


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n elements, doubled."""
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def capacities(tokens: int, sequence: int = SEQUENCE) -> list[int]:
    """Room of the sequences that hold so many tokens without padding."""
    rest = tokens % sequence
    return [sequence] * (tokens // sequence) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def packed(lengths: list[int], sequence: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, all packed together."""
    out, left = [], []
    count = 0
    for d, n in enumerate(lengths):
        full = n // sequence
        out += [(d, k * sequence, sequence, count + k, 0) for k in range(full)]
        count += full
        if n % sequence:
            left.append((n % sequence, d, full * sequence))
    left.sort(key=lambda x: (-x[0], x[1]))
    room = np.array(capacities(sum(x[0] for x in left), sequence), np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    for n, d, start in left:
        while n:
            fits = np.flatnonzero(room >= n)
            k = int(fits[cost[fits].argmin()]) if len(fits) else int(room.argmax())
            piece = min(n, int(room[k]))
            out.append((d, start, piece, count + k, int(size[k] - room[k])))
            room[k] -= piece
            cost[k] += linear * piece + quadratic * piece * piece
            n, start = n - piece, start + piece
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Pieces: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, next_id = encoder(tokenizer_path), TaskContext.get().partitionId() << 33
        names, held, tokens = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            rows = packed([len(x) for x in held], sequence)
            d, start, length, seq, at = (np.array(c, np.int64) for c in zip(*rows))
            ids = pa.array([held[i][s : s + n].tobytes() for i, s, n, _, _ in rows], pa.binary())
            total = np.array([len(held[i]) for i in d], np.int64)
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(names).take(pa.array(d)), pa.array(start), pa.array(length), ids, pa.array(total), pa.array(seq + next_id), pa.array(at)], names=schema.names)
            next_id += int(seq.max()) + 1
            names.clear()
            held.clear()
            return out

        for whole in batches:
            for batch in parts(whole, text_col, 8_000_000):
                ids, offsets = own.encode(batch.column(text_col))
                names.append(batch.column(id_col))
                for a, b in zip(offsets[:-1], offsets[1:]):
                    held.append(np.append(ids[a:b], np.uint32(end_id)))
                    tokens += int(b - a) + 1
                if tokens >= window_tokens:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    importable(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
