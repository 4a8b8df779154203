"""Words of whole texts as numpy arrays, for operators whose work is done on Arrow batches.

A batch is cut into pieces of bounded bytes, so memory follows the piece (or the longest single
text), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

PIECE_BYTES = 2 << 20
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Cap the bytes of the Arrow batches that Spark hands to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _table(separators: list[tuple[int, int]], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    keep, to = np.ones(256, bool), np.arange(256, dtype=np.uint8)
    for first, last in separators:
        keep[first:last + 1] = False
    if lower:
        to[65:91] += 32
    return keep, to


# The separators are ASCII, so bytes may be judged one by one in UTF-8.
BLANKS = [(0x20, 0x20), (0x09, 0x0D)]
SPACED = _table(BLANKS, lower=False)
SPACED_LOWER = _table(BLANKS, lower=True)
ALNUM_LOWER = _table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], lower=True)


@dataclass
class Words:
    """Words of a run of texts, in order.

    ``first[d] : first[d + 1]`` are the words of text ``d``; ``start`` and ``stop`` are byte places in
    ``data``, the joined texts; ``code`` numbers the distinct words, whose bytes are ``distinct``.
    """

    first: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    code: np.ndarray
    distinct: pa.Array
    data: np.ndarray
    text_at: np.ndarray
    hashed: dict[int, np.ndarray] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.start)

    def digests(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        if seed not in self.hashed:
            of = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))
            self.hashed[seed] = of[self.code]
        return self.hashed[seed]


def split_words(texts: pa.Array, rule: tuple[np.ndarray, np.ndarray]) -> Words:
    """NULL has no words."""
    keep, to = rule
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = keep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], inside))  # before[i]: byte i - 1 is of a word
    after = np.concatenate((inside, [False]))
    start = np.flatnonzero(after & (~before | edge))
    stop = np.flatnonzero(before & (~after | edge))
    offsets = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int64)
    letters = to[data[inside]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    return Words(np.searchsorted(start, at), start, stop, code, coded.dictionary, data, at)


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def window_sums(digests: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every run of ``size`` words; ``base`` is odd."""
    n = len(digests) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.empty(len(digests), np.uint64)
    powers[0] = 1
    powers[1:] = base
    np.multiply.accumulate(powers, out=powers)
    inverse = np.empty(len(digests), np.uint64)
    inverse[0] = 1
    inverse[1:] = pow(base, -1, 1 << 64)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(digests * powers)))
    return mix((sums[size:] - sums[:-size]) * inverse[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (an invertible finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
