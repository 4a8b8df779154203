"""Periodic runs: stretches of words that repeat with a short period, and texts without the repeats.

Each piece of texts is one sequence of word numbers with a sign of its own between texts, so no run
crosses one. Whether the words at ``i`` and ``i + p`` go on alike, and how far, is asked at the grid
points ``i = 0, p, 2p, ...`` of every period: ``n log n`` points, most of which fail on their first
words. The others ask an index of longest common extensions: suffixes at the places of a difference
cover are sorted, and of any two places a few words on both are in the cover, where the least common
prefix between two ranks is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landsift.llm.words import SPACED, Words, bounded_batches, pieces, split_words

# Every difference modulo 31 is one of two of these.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)


def _shifts() -> np.ndarray:
    """shift[a, b]: fewest steps that bring places of residues a and b into the cover together."""
    shift = np.full((MODULUS, MODULUS), MODULUS, np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            shift[a, b] = min(s for s in range(MODULUS) if (a + s) % MODULUS in COVER and (b + s) % MODULUS in COVER)
    return shift


SHIFT = _shifts()


class CommonExtension:
    """How far the words from two places on are equal, for many pairs of places at once."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        # behind the end stand numbers that occur once, so nothing is compared past it
        self.codes = np.concatenate((codes, np.arange(-2 * MODULUS - 1, -1, dtype=codes.dtype)))
        residue = np.zeros(MODULUS, bool)
        residue[list(COVER)] = True
        self.sample = np.flatnonzero(residue[np.arange(n + MODULUS) % MODULUS])
        self.number = np.full(n + 2 * MODULUS, -1, np.int64)
        self.number[self.sample] = np.arange(len(self.sample))
        self._sort()

    def _sort(self) -> None:
        """Rank the sampled suffixes by their next 31, 62, 124 ... words; what lies 31 words on is sampled too."""
        blocks = self.codes[np.minimum(self.sample[:, None] + np.arange(MODULUS), len(self.codes) - 1)]
        keys = np.ascontiguousarray(blocks.astype(">u4")).view(f"V{4 * MODULUS}").ravel()
        names, rank = np.unique(keys, return_inverse=True)
        levels, ahead, m = [rank.astype(np.int64)], self.number[np.minimum(self.sample + MODULUS, len(self.number) - 1)], len(self.sample)
        steps = [ahead]
        while levels[-1].max(initial=-1) + 1 < m:
            rank, step = levels[-1], steps[-1]
            after = np.where(step >= 0, rank[step], -1)
            _, rank = np.unique(rank * (m + 1) + after + 1, return_inverse=True)
            levels.append(rank.astype(np.int64))
            steps.append(np.where(step >= 0, step[step], -1))
        self.rank = levels[-1]
        order = np.argsort(self.rank)
        self.table = [self._neighbours(order[:-1], order[1:], levels, steps)]
        while 2 << len(self.table) - 1 < m:
            last, width = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-width], last[width:]))

    def _neighbours(self, a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], steps: list[np.ndarray]) -> np.ndarray:
        """Common words of suffixes that are neighbours in order: whole levels first, then a block word by word."""
        found = np.zeros(len(a), np.int64)
        alive = np.ones(len(a), bool)
        for k in range(len(levels) - 1, -1, -1):
            go = np.flatnonzero(alive & (levels[k][a] == levels[k][b]))
            found[go] += MODULUS << k
            a, b = a.copy(), b.copy()
            a[go], b[go] = steps[k][a[go]], steps[k][b[go]]
            alive &= (a >= 0) & (b >= 0)
        rest = np.flatnonzero(alive)
        words, _ = self._walk(self.sample[a[rest]], self.sample[b[rest]], np.full(len(rest), MODULUS))
        found[rest] += words
        return found

    def _walk(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from both places on, ``most`` at the highest; whether it got that far."""
        found = np.zeros(len(i), np.int64)
        live, last = np.flatnonzero(most > 0), len(self.codes) - 1
        while len(live):
            at = found[live]
            same = self.codes[np.minimum(i[live] + at, last)] == self.codes[np.minimum(j[live] + at, last)]
            live = live[same]
            found[live] += 1
            live = live[found[live] < most[live]]
        return found, found == most

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places ``i`` and ``j`` that differ."""
        shift = SHIFT[i % MODULUS, j % MODULUS]
        found, reached = self._walk(i, j, shift)
        go = np.flatnonzero(reached)
        a, b = self.rank[self.number[i[go] + shift[go]]], self.rank[self.number[j[go] + shift[go]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        best = np.empty(len(go), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            best[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        found[go] += best
        return found


def _grid(codes: np.ndarray, longest: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points and periods whose first words are equal one period on: the places where a run may pass."""
    places, periods, n = [], [], len(codes)
    for p in range(1, longest // times + 1):
        at = np.flatnonzero(codes[:n - p:p] == codes[p::p]) * p
        for ahead in (1, 2):  # a run goes on for over 2p words behind one of its first points
            at = at[at + p + ahead < n]
            at = at[codes[at + ahead] == codes[at + p + ahead]]
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), p, np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def runs_of(codes: np.ndarray, longest: int, times: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs of a sequence, by start, then period.

    ``longest`` is the length of the longest text in it. A run has ``least`` words and ``times`` periods
    at least (``times`` is 4 or more) and cannot be made longer on either side.
    """
    none = np.zeros(0, np.int64)
    at, p = _grid(codes, longest, times)
    if not len(at):
        return none, none, none
    ahead = CommonExtension(codes)(at, at + p)
    # of the points of one stretch only the first counts: from the point before it, the words do not go on that far
    previous = np.zeros(len(at), bool)
    previous[1:] = (p[1:] == p[:-1]) & (at[1:] == at[:-1] + p[1:]) & (ahead[:-1] >= p[1:])
    enough = ahead + 2 * p - 1 >= np.maximum(least, times * p)
    pick = np.flatnonzero(~previous & enough)
    found: dict[int, list[tuple[int, int]]] = {}  # by end, as periods rise
    rows = []
    for i, q, end in zip(at[pick].tolist(), p[pick].tolist(), (at + ahead + p)[pick].tolist(), strict=True):
        if any(s <= i and q % r == 0 for s, r in found.get(end, ())):
            continue  # a multiple of the period of the same stretch
        begin = max(0, i - q)  # less than a period stands before the first point
        differ = np.flatnonzero(codes[begin:i] != codes[begin + q:i + q])
        start = begin + int(differ[-1]) + 1 if len(differ) else begin
        if end - start >= max(least, times * q):
            found.setdefault(end, []).append((start, q))
            rows.append((start, end - start, q))
    rows.sort(key=lambda r: (r[0], r[2]))
    start, length, period = np.array(rows, np.int64).reshape(-1, 3).T
    return start, length, period


def _sequence(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with a number of its own behind each text, and where each text begins."""
    n = np.diff(words.first)
    begin = words.first[:-1] + np.arange(len(n))
    codes = np.empty(len(words) + len(n), np.int64)
    codes[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words.code
    codes[begin + n] = len(words.distinct) + np.arange(len(n))
    return codes, begin


def _piece(texts: pa.Array, times: int, least: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Words, runs and collapsed text of every text."""
    words = split_words(texts, SPACED)
    codes, begin = _sequence(words)
    n = np.diff(words.first)
    start, length, period = runs_of(codes, int(n.max(initial=0)), times, least)
    text = np.searchsorted(begin, start, side="right") - 1
    inside = start - begin[text] if len(start) else start
    bounds = np.searchsorted(text, np.arange(len(n) + 1))
    rows = pa.StructArray.from_arrays([pa.array(inside), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows)
    depth = np.zeros(len(codes) + 1, np.int64)  # how many runs a word is a repeat in
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    keep = np.cumsum(depth)[:-1] == 0
    # the word before a text's end sign, and that sign, need no blank
    kept = np.flatnonzero(keep[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)])
    of = np.searchsorted(words.first, kept, side="right") - 1
    chosen = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int64)), words.distinct.cast(pa.large_string()).take(pa.array(words.code[kept])))
    return n, runs, pc.binary_join(chosen, pa.scalar(" ", pa.large_string())).cast(pa.string())


SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, clean_text string"


def collapse_runs(docs: DataFrame, text: str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``clean_text``.

    A run is a stretch of words (``[^\\x20\\x09-\\x0D]+``, numbered from 0) with smallest period ``period`` and
    at least ``max(least, times * period)`` words that no neighbouring word extends; runs stand in order
    of start, then period. ``clean_text`` holds, joined by one blank, the words that no run contains behind
    its first period. NULL and empty texts have no words, no runs and the clean text ''. An input column
    named like an added one is replaced. Every row is worked on alone, repeated ones too; an empty table
    gives an empty table. No shuffle: a task's memory follows a piece of 2 MB or the longest single text,
    which has no length limit but must fit several times over.
    """
    if times < 4:
        raise ValueError("a run has four periods at least")
    bounded_batches(docs.sparkSession)
    added = ("n_words", "runs", "clean_text")
    own = [c for c in docs.columns if c.lower() not in added]
    framed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row") if own else F.lit(None).alias("row"), F.col(text).alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "t"):
                n, runs, clean = _piece(piece.column("t"), times, least)
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(n.astype(np.int64)), runs, clean], names=["row", *added])

    out = framed.mapInArrow(work, T.StructType([framed.schema["row"], *T.StructType.fromDDL(SCHEMA).fields]))
    return out.select(*[F.col("row")[c].alias(c) for c in own], *added)
