"""Benchmark decontamination: an FM-index per training shard, searched for the windows of the test items.

Documents stay where they were read: each task indexes its texts shard by shard, looks every window up
and merges the places into removal spans. Words foreign to the benchmark become breaks of the index,
since no window can cross them. There is no shuffle; memory follows ``shard_bytes``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landsift.llm.fmindex import FMIndex
from landsift.llm.words import ALNUM_LOWER, Words, bounded_batches, mix, pieces, split_words
from landsift.session import cut_lineage

ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
    T.StructField("clean_text", T.StringType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())),
])
ARROW = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.string(), pa.list_(pa.int32())]


@dataclass
class Phrases:
    """Windows of a block of items: their words, and for each length the phrases and their items."""

    vocabulary: pa.Array
    by_length: dict[int, tuple[np.ndarray, list[np.ndarray]]]
    names: list[str | None]
    hashes: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by length, in order, and whose they are

    def among(self, windows: np.ndarray) -> np.ndarray:
        """Which rows of ``windows`` (codes of words) are phrases."""
        width = windows.shape[1]
        known = self.by_length[width][0]
        if width not in self.hashes:
            hashed = _row_hashes(known)
            order = np.argsort(hashed)
            self.hashes[width] = hashed[order], order
        hashed, order = self.hashes[width]
        own = _row_hashes(windows)
        found = np.zeros(len(windows), bool)
        low, high = np.searchsorted(hashed, own), np.searchsorted(hashed, own, side="right")
        for step in range(int((high - low).max(initial=0))):
            live = np.flatnonzero(low + step < high)
            found[live] |= (known[order[low[live] + step]] == windows[live]).all(1)
        return found

    @staticmethod
    def of(items: list[tuple[str | None, str]], size: int) -> Phrases:
        words = split_words(pa.array([text for _, text in items], pa.string()), ALNUM_LOWER)
        code = words.code.astype(np.int64) + 1
        found: dict[int, dict[tuple, list[int]]] = {}
        for k in range(len(items)):
            own = code[words.first[k]:words.first[k + 1]].tolist()
            width = min(size, len(own))
            for i in range(len(own) - width + 1 if width else 0):
                owners = found.setdefault(width, {}).setdefault(tuple(own[i:i + width]), [])
                if not owners or owners[-1] != k:
                    owners.append(k)
        by_length = {m: (np.array(list(x), np.int64), [np.array(o) for o in x.values()]) for m, x in found.items()}
        return Phrases(words.distinct, by_length, [name for name, _ in items])


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return total


def _cut_further(code: np.ndarray, gone: np.ndarray, phrases: Phrases) -> np.ndarray:
    """Which words of a text go if cutting is repeated until no window is left.

    A window that was not there before lies across a cut, so each round looks at the words on both sides of
    the last cuts only, by links from one word that is left to the next.
    """
    n, longest = len(code), max(phrases.by_length, default=0)
    left = np.flatnonzero(~gone)
    after, before = np.full(n + 1, n), np.full(n + 1, -1)  # n and -1: the text's ends
    after[left[:-1]], before[left[1:]] = left[1:], left[:-1]
    gone = gone.copy()
    behind = np.flatnonzero(np.diff(left) > 1)
    cuts = list(zip(left[behind].tolist(), left[behind + 1].tolist(), strict=True))
    while cuts:
        windows: dict[int, list[list[int]]] = {}
        for a, b in cuts:
            west, east = [], []
            while a >= 0 and len(west) < longest - 1:
                west.append(a)
                a = int(before[a])
            while b < n and len(east) < longest - 1:
                east.append(b)
                b = int(after[b])
            near = west[::-1] + east
            for width in phrases.by_length:
                for i in range(max(0, len(west) - width + 1), min(len(west), len(near) - width + 1)):
                    windows.setdefault(width, []).append(near[i:i + width])
        lost = set()
        for width, places in windows.items():
            rows = np.array(places)
            lost.update(rows[phrases.among(code[rows])].ravel().tolist())
        cuts = []
        for word in sorted(lost):
            gone[word] = True
        for word in sorted(lost):
            west, east = int(before[word]), int(after[word])
            if west >= 0:
                after[west] = east
            if east < n:
                before[east] = west
            if 0 <= west and east < n and not gone[west] and not gone[east]:
                cuts.append((west, east))
        cuts = [(a, b) for a, b in cuts if after[a] == b]
    return gone


def _search(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words stand inside an occurrence, the (text, item) pairs with one, and the words' codes (0: foreign to all items)."""
    known = pc.fill_null(pc.index_in(words.distinct, value_set=phrases.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    texts = len(words.first) - 1
    text_of = np.repeat(np.arange(texts), np.diff(words.first))
    indexed = np.zeros(len(words) + texts, np.int64)  # a break after each text
    indexed[np.arange(len(words)) + text_of] = known[words.code] if len(words) else 0
    index = FMIndex(indexed, len(phrases.vocabulary))
    edge, pairs = np.zeros(len(words) + 1, np.int64), []
    for width, (windows, owners) in phrases.by_length.items():
        which, place = index.find(windows)
        if not len(which):
            continue
        text = np.searchsorted(words.first + np.arange(texts + 1), place, side="right") - 1
        word = place - text
        edge += np.bincount(word, minlength=len(edge)) - np.bincount(word + width, minlength=len(edge))
        seen = np.unique(np.stack((text, which), 1), axis=0)
        sizes = np.array([len(owners[w]) for w in seen[:, 1]])
        pairs.append(np.stack((np.repeat(seen[:, 0], sizes), np.concatenate([owners[w] for w in seen[:, 1]])), 1))
    hit = np.cumsum(edge[:-1]) > 0
    return hit, np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64), known[words.code] if len(words) else np.zeros(0, np.int64)


def _runs(hit: np.ndarray) -> np.ndarray:
    """First and after-last place of each run of set values, one run per row."""
    change = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return np.stack((np.flatnonzero(change == 1), np.flatnonzero(change == -1)), 1)


def _spans(words: Words, k: int, runs: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of text ``k`` from the first to the last word of each run."""
    begins, ends = words.first[k] + runs[:, 0], words.first[k] + runs[:, 1] - 1
    at = words.text_at[k]
    return list(zip((words.start[begins] - at).tolist(), (words.stop[ends] - at).tolist(), strict=True))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    data, out, done = text.encode(), [], 0
    for start, stop in spans:
        out.append(data[done:start])
        done = stop
    return b"".join([*out, data[done:]]).decode()


def _shard(texts: pa.Array, phrases: Phrases, alone: bool, found: list[list[int]] | None = None, named: list[list[str]] | None = None) -> list[tuple]:
    """The added columns of each text. ``alone``: there is no other block, so texts are cut until no window is left.
    ``found`` and ``named``: word ranges and items of earlier blocks."""
    words = split_words(texts, ALNUM_LOWER)
    hit, pairs, code = _search(words, phrases)
    for k, ranges in enumerate(found or []):
        for begin, end in zip(ranges[::2], ranges[1::2], strict=True):
            hit[words.first[k] + begin:words.first[k] + end] = True
    counts = np.diff(words.first)
    sums = np.concatenate(([0], np.cumsum(hit)))
    n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
    items: dict[int, set] = {k: set(x) for k, x in enumerate(named or []) if x}
    for k, item in pairs.tolist():
        if phrases.names[item] is not None:
            items.setdefault(k, set()).add(phrases.names[item])
    whole = texts.to_pylist()
    runs = {k: _runs(hit[words.first[k]:words.first[k + 1]]) for k in np.flatnonzero(n_hit).tolist()}
    spans = {k: _spans(words, k, r) for k, r in runs.items()}
    clean = {k: _cut(whole[k], s) for k, s in spans.items()}
    if alone:  # what a cut brings together may be a window again
        for k in clean:
            own = slice(words.first[k], words.first[k + 1])
            clean[k] = _cut(whole[k], _spans(words, k, _runs(_cut_further(code[own], hit[own], phrases))))
    return [
        (int(counts[k]), int(n_hit[k]), sorted(items.get(k, ())), [{"start": a, "stop": b} for a, b in spans.get(k, [])],
         clean.get(k, whole[k]), runs[k].ravel().tolist() if k in runs else [])
        for k in range(len(whole))
    ]


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    block, size = [], 0
    for name, text in items.toLocalIterator():
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += len(text)
    yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    size: int = 10, shard_bytes: int = 16 << 20, block_bytes: int = 16 << 20,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items``, ``spans`` and ``clean_text``.

    A window is ``size`` words of an item, or all words of a shorter one. ``n_hit`` counts the words
    inside any occurrence of a window, ``items`` names the items with one (as strings, sorted),
    ``spans`` are the merged byte ranges of hit words, and ``clean_text`` is the text without them;
    cutting goes on until no window is left.

    NULL text has no words and stays NULL. An item without words has no windows; one without an id
    makes hits but is not named; items that share an id are one. Repeated rows are searched one by one.
    Empty tables give empty results. Input columns named like an added one are replaced. A text has no
    length limit but must fit a task several times over.

    The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text (or one item), one pass
    over the documents each; between passes the rows are written to the checkpoint folder. The hits of
    all blocks are cut together. With more than one block, texts that lost words then meet all blocks
    again, until none loses any, so the result does not depend on the blocks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = [c for c in docs.columns if c.lower() not in ADDED.names or c == text]
    items = benchmark.select(F.col(item).cast("string"), F.col(item_text)).filter(F.col(item_text).isNotNull())
    frame, blocks = _passes(docs.select(*own), text, items, size, shard_bytes, block_bytes)
    cut = F.size("found_hit_words") > 0
    while blocks > 1:
        frame = cut_lineage(frame)
        if frame.filter(cut).isEmpty():
            break
        left = frame.select(F.struct(*frame.columns).alias("row"), F.when(cut, F.col("found_clean_text")).alias("left"))
        again, _ = _passes(left, "left", items, size, shard_bytes, block_bytes)
        clean = F.coalesce("found_clean_text", F.col("row")["found_clean_text"])
        kept = [c for c in frame.columns if c not in ("found_clean_text", "found_hit_words")]
        frame = again.select(*[F.col("row")[c].alias(c) for c in kept], clean.alias("found_clean_text"), "found_hit_words")
    return frame.select(*[c for c in own if c.lower() not in ADDED.names], *[F.col(f"found_{n}").alias(n) for n in ADDED.names if n != "hit_words"])


def _passes(frame: DataFrame, text: str, items: DataFrame, size: int, shard_bytes: int, block_bytes: int) -> tuple[DataFrame, int]:
    """``frame`` with the added columns, named ``found_...``, after a pass for each block of items; the number of blocks."""
    spark, own = frame.sparkSession, frame.columns
    schema = T.StructType([*frame.schema.fields, *[T.StructField(f"found_{f.name}", f.dataType) for f in ADDED.fields]])
    blocks, done = _blocks(items, block_bytes), 0
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        if done:
            frame = cut_lineage(frame)
        shared = spark.sparkContext.broadcast(Phrases.of(block, size))
        frame = frame.mapInArrow(_searcher(shared, text, shard_bytes, own, alone=not done and following is None, later=done > 0), schema)
        block, done = following, done + 1
    return frame, done


def _searcher(shared: Broadcast, text: str, shard_bytes: int, own: list[str], alone: bool, later: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, shard_bytes):
                earlier = [piece.column(f"found_{n}").to_pylist() for n in ("hit_words", "items")] if later else []
                columns = zip(*_shard(piece.column(text), shared.value, alone, *earlier), strict=True)
                new = [pa.array(x, kind) for x, kind in zip(columns, ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in own), *new], names=[*own, *(f"found_{n}" for n in ADDED.names)])

    return search
