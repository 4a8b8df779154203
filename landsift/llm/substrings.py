"""Substring deduplication: a count-min sketch rules out windows that stand in one document only,
then the windows left are grouped exactly.

A window is counted under its anchor, the least hash among its shorter word runs. Equal windows have
equal anchors, so the documents counted for an anchor are never fewer than those that hold the window:
the estimate only errs upwards, and no repeat is lost. Neighbouring windows share their anchor, so the
sketch takes one entry for about a dozen windows.

Tasks send the sketch entries they touched, in slices; slices are merged apart from each other. What
the tasks get back are the counters that reached two, at most ``2 * 2**max_bits`` bits (256 MB at 30).
With ``a`` anchors and ``w`` counters a row, about ``(1 - exp(-a / w)) ** 2`` of the single windows pass;
``w`` follows the text until ``max_bits``, and beyond that the exact pass has more to do but gives the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landsift.llm.words import SPACED, Words, bounded_batches, mix, pieces, split_words, window_sums
from landsift.session import cut_lineage, release

SLICE_BITS = 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
FLUSH = 1 << 20
TOUCHED_BITS = 27


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` values."""
    span = 1
    while span * 2 <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:len(values) - (size - span)], values[size - span:]) if size > span else values


def _windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window begins, and the text of each."""
    n = np.diff(words.first)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text))
    whole = place + size <= words.first[text + 1]
    return place[whole], text[whole]


def _anchors(words: Words, size: int) -> np.ndarray:
    """The anchor of the window at each place; meaningful only where the window stays in its text."""
    part = (size + 1) // 2
    runs = window_sums(words.digests(), part, BASES[0])
    return _least(runs, size - part + 1) if len(words) >= size else np.zeros(0, np.uint64)


def _counters(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each anchor in both rows of the sketch; the second row lies behind the first."""
    shift = np.uint64(64 - bits)
    return anchors >> shift, (mix(anchors ^ np.uint64(BASES[1])) >> shift) + np.uint64(1 << bits)


def _sketcher(text: str, size: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        entries = np.sort(np.concatenate(parts))
        slices = (entries >> np.uint64(SLICE_BITS)).astype(np.int32)
        at = np.flatnonzero(np.concatenate(([True], slices[1:] != slices[:-1])))
        local = (entries & np.uint64((1 << SLICE_BITS) - 1)).astype(np.uint32)
        rows = [x.tobytes() for x in np.split(local, at[1:])]
        return pa.RecordBatch.from_arrays([pa.array(slices[at]), pa.array(rows, pa.binary())], names=["slice", "entries"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            for piece in pieces(batch, text):
                words = split_words(piece.column(text), SPACED)
                place, of = _windows(words, size)
                if not len(place):
                    continue
                anchor = _anchors(words, size)[place]
                change = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])))
                anchor, of = anchor[change], of[change]
                by = np.lexsort((anchor, of))  # an anchor counts once for a text
                anchor, of = anchor[by], of[by]
                anchor = anchor[np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])))]
                parts += _counters(anchor, bits)
                if sum(map(len, parts)) > FLUSH:
                    yield flush(parts)
                    parts = []
        if parts:
            yield flush(parts)

    return sketch


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters that reached two, of each slice; rows come sorted by slice."""
    current, once, twice = None, np.zeros(0, bool), np.zeros(0, bool)

    def done() -> pa.RecordBatch:
        packed = zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([packed], pa.binary())], names=["slice", "entries"])

    for batch in batches:
        for number, entries in zip(batch.column("slice").to_pylist(), batch.column("entries").to_pylist(), strict=True):
            if number != current:
                if current is not None:
                    yield done()
                current, once, twice = number, np.zeros(1 << SLICE_BITS, bool), np.zeros(1 << SLICE_BITS, bool)
            at = np.frombuffer(entries, np.uint32)  # sorted
            again = at[1:][at[1:] == at[:-1]]
            twice[at[once[at]]] = True
            twice[again] = True
            once[at] = True
    if current is not None:
        yield done()


def repeated_counters(docs: DataFrame, text: str, size: int, bits: int) -> np.ndarray:
    """Bit per counter of the merged sketch: was it reached twice?"""
    schema = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("entries", T.BinaryType())])
    parts = docs.select(text).mapInArrow(_sketcher(text, size, bits), schema)
    merged = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge, schema)
    out = np.zeros((2 << bits) // 8, np.uint8)
    step = (1 << SLICE_BITS) // 8
    for number, packed in merged.toLocalIterator():  # 128 KB a slice at most
        out[number * step:(number + 1) * step] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return out


def _candidates(shared: Broadcast, names: list[str], size: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows whose estimate is two or more: hash, document and place; equal neighbours are one row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = shared.value
        for batch in batches:
            for piece in pieces(batch, "t"):
                words = split_words(piece.column("t"), SPACED)
                place, of = _windows(words, size)
                if not len(place):
                    continue
                anchor = _anchors(words, size)[place]
                change = np.concatenate(([True], anchor[1:] != anchor[:-1]))
                passed = np.ones(int(change.sum()), bool)
                for counter in _counters(anchor[change], bits):
                    counter = counter.astype(np.int64)
                    passed &= (repeated[counter >> 3] >> (counter & 7).astype(np.uint8)) & 1 == 1
                passed = passed[np.cumsum(change) - 1]
                place, of = place[passed], of[passed]
                if not len(place):
                    continue
                one, two = (window_sums(words.digests(k), size, base)[place] for k, base in enumerate(BASES))
                one, two = one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)
                fresh = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)))
                at = np.flatnonzero(fresh)
                length = np.diff(np.append(at, len(place)))
                begin = (place - words.first[of])[at]
                own = piece.select(names).take(pa.array(of[at]))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(one[at]), pa.array(two[at]), pa.array(begin.astype(np.int32)), pa.array((begin + length + size - 1).astype(np.int32))],
                    names=[*names, "one", "two", "begin", "stop"])

    return find


def _touched(gone: DataFrame) -> np.ndarray:
    """A bit for every value that the first ``TOUCHED_BITS`` bits of a touched text's digest take, 16 MB in all."""
    slot = F.shiftrightunsigned("d", 64 - TOUCHED_BITS)
    bits = gone.select(F.shiftrightunsigned(slot, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(d, {64 - TOUCHED_BITS}) % 64 AS INT))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # TOUCHED_BITS bound its rows
    out = np.zeros(1 << (TOUCHED_BITS - 6), np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _may_be(touched: np.ndarray, digests: pa.Array) -> np.ndarray:
    """Which digests may belong to a touched text; NULL never does."""
    slot = (pc.fill_null(digests, 0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - TOUCHED_BITS)).astype(np.int64)
    found = (touched[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found & digests.is_valid().to_numpy(zero_copy_only=False)


def _chosen(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_may_be(shared.value, batch.column("d"))))

    return choose


def _cutter(names: list[str], shared: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words of each text, those in ``gone`` (places, from and to) left out.

    With ``shared`` there is no such column: texts that may be touched are left to others.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                batch = batch.filter(pa.array(~_may_be(shared.value, batch.column("d"))))
            for piece in pieces(batch, "t"):
                words = split_words(piece.column("t"), SPACED)
                edge = np.zeros(len(words) + 1, np.int64)
                gone = piece.column("gone") if shared is None else pa.nulls(piece.num_rows)
                for k in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    for begin, stop in gone[k].as_py():
                        edge[words.first[k] + begin] += 1
                        edge[words.first[k] + stop] -= 1
                stay = np.cumsum(edge[:-1]) == 0
                sums = np.concatenate(([0], np.cumsum(stay)))
                total = np.diff(words.first)
                kept = sums[words.first[1:]] - sums[words.first[:-1]]
                dictionary = np.array(words.distinct.to_pylist(), object)
                texts = []
                for k in range(len(total)):
                    a, b = words.first[k], words.first[k + 1]
                    texts.append(b" ".join(dictionary[words.code[a:b][stay[a:b]]]))
                null = piece.column("t").is_null().to_pylist()
                texts = [None if x else y.decode() for x, y in zip(null, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*piece.select(names).columns, pa.array(total.astype(np.int64)), pa.array((total - kept).astype(np.int64)), pa.array(texts, pa.string())],
                    names=[*names, "found_words", "found_removed", "found_text"])

    return cut


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = 50, max_bits: int = 30) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``clean_text`` (the kept words joined by one space).

    A word goes if a window of ``size`` words that covers it also begins in a document with a smaller id.
    Windows are judged on the input. Rows that share an id do not remove from each other; a NULL id is
    larger than any other. NULL text has no words and stays NULL; texts shorter than a window keep all.
    Rows equal in id and text get the same result. Empty tables give empty results. Input columns named
    like an added one are replaced. Windows are told apart by 96 bits of hash.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    added = ["n_words", "n_removed", "clean_text"]
    own = [c for c in docs.columns if c.lower() not in added]
    framed = docs.select(F.struct(*[F.col(c) for c in own]).alias("row"), F.col(ident).alias("i"), F.col(text).alias("t"), F.xxhash64(text).alias("d"))
    letters = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = min(max_bits, max(SLICE_BITS, int(letters // 5).bit_length()))  # about 16 counters for each of letters / 75 anchors
    shared = spark.sparkContext.broadcast(repeated_counters(framed.select("t"), "t", size, bits))
    release(spark)  # the entries of the sketch

    kind = framed.schema["i"].dataType
    fields = [T.StructField("i", kind), T.StructField("d", T.LongType()), T.StructField("one", T.LongType()), T.StructField("two", T.IntegerType()), T.StructField("begin", T.IntegerType()), T.StructField("stop", T.IntegerType())]
    windows = framed.select("i", "d", "t").mapInArrow(_candidates(shared, ["i", "d"], size, bits), T.StructType(fields))
    holders = windows.groupBy("one", "two").agg(F.min("i").alias("least")).filter(F.col("least").isNotNull())
    later = windows.join(holders, ["one", "two"]).filter(F.col("i").isNull() | (F.col("i") > F.col("least")))
    gone = cut_lineage(later.groupBy("i", "d").agg(F.collect_list(F.array("begin", "stop")).alias("gone")))
    # the windows were shuffled twice and are not read again: they leave the disks before the texts move
    del windows, holders, later
    shared.destroy()
    release(spark)

    # texts that surely lose nothing are done where they are read; only the rest move to meet their list
    touched = spark.sparkContext.broadcast(_touched(gone))
    release(spark)  # what a job has only just left is still held the first time
    schema = T.StructType([framed.schema["row"], T.StructField("found_words", T.LongType()), T.StructField("found_removed", T.LongType()), T.StructField("found_text", T.StringType())])
    whole = framed.select("row", "t", "d").mapInArrow(_cutter(["row"], touched), schema)
    may = framed.select("row", "t", "i", "d").mapInArrow(_chosen(touched), T.StructType([framed.schema[c] for c in ("row", "t", "i", "d")]))
    met = may.alias("a").join(gone.alias("b"), F.col("a.i").eqNullSafe(F.col("b.i")) & (F.col("a.d") == F.col("b.d")), "left").select("row", "t", "gone")
    cut = whole.union(met.mapInArrow(_cutter(["row"]), schema))
    return cut.select(*[F.col("row")[c].alias(c) for c in own], F.col("found_words").alias("n_words"), F.col("found_removed").alias("n_removed"), F.col("found_text").alias("clean_text"))
