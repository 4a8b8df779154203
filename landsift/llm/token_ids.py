"""Token ids in ORC files: run-length encoded integers in stripes, row indexes and Bloom filters on ids.

Texts are dealt into ranges of document ids, encoded where they land and written in order. A reader
takes stripes in parallel, skips stripes and row groups by the minimum, maximum and Bloom filter of
the document id, and needs no file but these.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from json import dumps, loads
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landsift.llm.words import SPACED, SPACED_LOWER, bounded_batches, pieces, split_words
from landsift.session import shared_folder

PIECE = 4 << 20
KEPT_BYTES = 64 << 20
JOINED = 512
TASK_BYTES = 64 << 20
# Fixed value: a pattern by which a tokenizer takes letters, digits and other marks apart.
APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = b".,;:!?"


class _Encoder:
    """A tokenizer and the ids of words it has met, in arrays by a 128-bit hash of the word; one task's, gone with it."""

    def __init__(self, json: str, end_id: int, kept_bytes: int = KEPT_BYTES):
        import tokenizers

        self.tokenizer, self.end_id = tokenizers.Tokenizer.from_str(json), end_id
        self.joiner = tokenizers.Tokenizer.from_str(_without_space_rule(json))
        self.marks, self.room = _marks(json), kept_bytes
        self.ended = self._new_words(pa.array([MARKS[k:k + 1] for k in range(len(MARKS))], pa.large_binary())) if _takes_apart(json) else None
        self.high, self.low = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _new_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has. Many words are joined to one text; a token belongs to the word its offset lies in."""
        chars = pc.utf8_length(words.cast(pa.large_string())).to_numpy().astype(np.int64) + 1
        spelled, flat, sizes = words.to_pylist(), [], []
        for k in range(0, len(spelled), JOINED * 8):
            groups = [(j, b" ".join(spelled[j:j + JOINED]).decode()) for j in range(k, min(k + JOINED * 8, len(spelled)), JOINED)]
            plain = not any(OTHER_SPACE.search(text) for _, text in groups)
            coded = (self.joiner if plain else self.tokenizer).encode_batch([text for _, text in groups], add_special_tokens=False)
            for (j, _), one in zip(groups, coded, strict=True):
                first = np.fromiter((o[0] for o in one.offsets), np.int64, len(one.ids))
                ends = np.searchsorted(first, np.cumsum(chars[j:j + JOINED]))
                sizes.append(np.diff(ends, prepend=0))
                flat.append(np.array(one.ids, np.int32))
        return np.concatenate(flat or [np.zeros(0, np.int32)]), np.concatenate(sizes or [np.zeros(0, np.int64)])

    def _keep(self, high: np.ndarray, low: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Remember words while there is room; those that come first are those that come often."""
        cost = np.cumsum(32 + 4 * size)
        n = int(np.searchsorted(cost, self.room, side="right"))
        self.room -= int(cost[n - 1]) if n else 0
        order = np.argsort(high[:n], kind="stable")
        begin = np.concatenate(([0], np.cumsum(size[:n])))[:-1] + len(self.flat)
        place = np.searchsorted(self.high, high[:n][order])
        self.high, self.low = np.insert(self.high, place, high[:n][order]), np.insert(self.low, place, low[:n][order])
        self.at, self.size = np.insert(self.at, place, begin[order]), np.insert(self.size, place, size[:n][order])
        self.flat = np.concatenate((self.flat, flat[:int(size[:n].sum())]))

    def by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each begins; a word is encoded once a piece at most, a kept one never again."""
        words = split_words(texts, self._rule(texts))
        spelled, code, mark = self._without_marks(words.distinct)
        n = len(spelled)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, spelled.to_pylist())), np.uint64).reshape(n, 2)
        high, low = digests[:, 0], digests[:, 1]
        place = np.minimum(np.searchsorted(self.high, high), max(len(self.high) - 1, 0))
        known = (self.high[place] == high) & (self.low[place] == low) if len(self.high) else np.zeros(n, bool)
        new = np.flatnonzero(~known)
        flat, size = self._new_words(spelled.take(pa.array(new)))
        both, at, many = np.concatenate((self.flat, flat)), np.empty(n, np.int64), np.empty(n, np.int64)
        if len(self.high):
            at[known], many[known] = self.at[place[known]], self.size[place[known]]
        at[new], many[new] = len(self.flat) + np.concatenate(([0], np.cumsum(size)))[:-1], size
        offsets = np.concatenate(([0], np.cumsum(many)))
        own = both[np.arange(offsets[-1]) + np.repeat(at - offsets[:-1], many)]
        if self.room > 0 and len(new):
            self._keep(high[new], low[new], flat, size)
        # each text is its words, each with its mark, and the end; marks and the end are numbered behind the words
        flat, size = self.ended or (np.zeros(0, np.int32), np.zeros(0, np.int64))
        behind = np.concatenate((offsets, offsets[-1] + np.cumsum(size), [offsets[-1] + len(flat) + 1]))
        ids = pa.ListArray.from_arrays(pa.array(behind.astype(np.int32)), pa.array(np.concatenate((own, flat, [self.end_id])).astype(np.int32)))
        order, marked = code[words.code], mark[words.code]
        at = np.flatnonzero(marked >= 0)
        order = np.insert(order, at + 1, n + marked[at])
        ends = words.first[1:] + np.searchsorted(at, words.first[1:])
        order = np.insert(order, ends, n + len(size))
        taken = ids.take(pa.array(order))
        return taken.values.to_numpy(), taken.offsets.to_numpy()[np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))]

    def _without_marks(self, distinct: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words without the mark that ends them behind a letter A-Z, which the tokenizer takes apart; each word's place there, and its mark or -1."""
        n = len(distinct)
        if self.ended is None or not n:
            return distinct, np.arange(n, dtype=np.int64), np.full(n, -1)
        ends = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset:distinct.offset + n + 1]
        data = np.frombuffer(distinct.buffers()[2], np.uint8)
        long = np.diff(ends) > 1
        last, before = data[ends[1:] - 1], data[np.maximum(ends[1:] - 2, 0)] | 0x20
        which = np.full(256, -1)
        which[list(MARKS)] = np.arange(len(MARKS))
        mark = np.where(long & (before >= 97) & (before <= 122), which[last], -1)
        bare = pc.if_else(pa.array(mark >= 0), pc.binary_slice(distinct, 0, -1), distinct).dictionary_encode()
        return bare.dictionary, bare.indices.to_numpy(zero_copy_only=False).astype(np.int64), mark

    def _rule(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Fold A-Z if the tokenizer does so too, and no text holds what might become a special token of it."""
        if self.marks is None or any(pc.any(pc.match_substring(texts, m, ignore_case=True)).as_py() for m in self.marks):
            return SPACED
        return SPACED_LOWER

    def by_text(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        rows = [np.array([*x.ids, self.end_id], np.int32) for x in found]
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


OTHER_SPACE = re.compile(r"[^\S ]")


def _without_space_rule(json: str) -> str:
    """The tokenizer without the rule that makes one blank of any white space, for texts with single blanks alone."""
    rules = loads(json)
    steps = (rules.get("normalizer") or {}).get("normalizers")
    if steps:
        rules["normalizer"]["normalizers"] = [s for s in steps if (s.get("type"), s.get("pattern"), s.get("content")) != ("Replace", {"Regex": r"\s+"}, " ")]
    return dumps(rules)


def _takes_apart(json: str) -> bool:
    """Does the tokenizer make a piece of its own of a mark behind a letter?"""
    steps = (loads(json).get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = steps[0]
    return (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": APART}, "Removed", True)


def _marks(json: str) -> list[str] | None:
    """The special tokens of a tokenizer that puts texts in lower case, None for any other."""
    rules = loads(json)
    if '"Lowercase"' not in dumps(rules.get("normalizer") or {}):
        return None
    return [token["content"] for token in rules.get("added_tokens") or []]


def _encoder(shared: Broadcast, end_id: int, words_apart: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _Encoder(shared.value, end_id)
        for batch in batches:
            for piece in pieces(batch, "t", PIECE):
                ids, at = (encoder.by_word if words_apart else encoder.by_text)(piece.column("t"))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([piece.column("i"), lists], names=["i", "ids"])

    return encode


def write_ids(
    docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 1, ident: str = "doc_id", text: str = "text",
    words_apart: bool = False, stripe_bytes: int = 16 << 20, index_rows: int = 2_000, task_bytes: int = TASK_BYTES,
) -> str:
    """Encode every whole text and write ``doc_id``, ``row`` (ascending with the id), ``n_ids`` and ``ids``; gives the folder.

    ``tokenizer`` is a vocabulary file on the driver; its content goes to the tasks. ``words_apart`` says
    that it drops white space, so that words may be encoded one by one: set it only for such a
    tokenizer. NULL text is empty and has the end id alone. NULL ids come first; rows that share an id
    stay apart and keep some order; an empty table makes a folder without rows. Other columns are not read,
    so they may have any name. A task takes ``task_bytes`` of text: the more, the less often a word is encoded anew. A text has no length limit but must fit a task several times over, with its ids.
    What a task keeps of words is bounded by ``KEPT_BYTES`` and ends with the task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(Path(tokenizer).read_text())
    framed = docs.select(F.col(ident).alias("i"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("salt"))
    order = [F.col("i").asc_nulls_first(), F.col("salt")]
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    dealt = framed.repartitionByRange(max(1, -(-size // task_bytes)), *order).sortWithinPartitions(*order).select("i", "t")
    schema = T.StructType([framed.schema["i"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    coded = dealt.mapInArrow(_encoder(shared, end_id, words_apart), schema)
    rows = coded.select(F.col("i").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.size("ids").cast("long").alias("n_ids"), "ids")
    options = {
        "orc.stripe.size": stripe_bytes, "orc.create.index": "true", "orc.row.index.stride": index_rows,
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    }
    rows.write.options(**{k: str(v) for k, v in options.items()}).orc(path)
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_ids`` wrote; comparisons with ``doc_id`` skip stripes and row groups."""
    return spark.read.orc(path)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "row", "n_tokens", "ids_crc32"])


def positions(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids before it), ``n_tokens`` and ``ids_crc32`` of every row written.

    Lengths are summed by part (from the lengths alone, without the ids), the parts' totals, a row each, in
    one place, and then within each part.
    """
    bounded_batches(spark)
    files = read_ids(spark, path)
    schema = T.StructType([files.schema["doc_id"], files.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    rows = files.select("doc_id", "row", "ids").mapInArrow(_summed, schema).withColumn("part", F.shiftright("row", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lengths = files.select(F.shiftright("row", 33).alias("part"), "n_ids")
    parts = lengths.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(parts, "part").select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
