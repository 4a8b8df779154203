"""Shuffled shards by a Feistel permutation of global row numbers.

Rows are numbered 0 to n - 1 in key order; the permutation sends number ``r`` to place ``p``, which is
slot ``p // shards`` of shard ``p % shards``. Any row's place, and the row at any place, follow from
``n``, ``shards`` and ``seed`` alone: nothing is looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift.session import cut_lineage

ROUNDS = 4
M32 = 0xFFFFFFFF


def round_keys(seed: int) -> list[int]:
    return [((seed + 1) * 2654435761 * (2 * i + 1) + 40503 * i) & M32 for i in range(ROUNDS)]


def _round(half: np.ndarray, key: int) -> np.ndarray:
    x = half ^ np.uint64(key)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & np.uint64(M32)
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & np.uint64(M32)
    return x ^ (x >> np.uint64(16))


def _once(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    """One pass of the network over ``bits`` bits; halves of unlike width change places each round."""
    right_bits = bits // 2
    widths = (bits - right_bits, right_bits)
    left, right = x >> np.uint64(right_bits), x & np.uint64((1 << right_bits) - 1)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        mask = np.uint64((1 << widths[i % 2]) - 1)
        if back:
            left, right = right ^ (_round(left, keys[i]) & mask), left
        else:
            left, right = right, left ^ (_round(right, keys[i]) & mask)
    return (left << np.uint64(right_bits)) | right


def permute(rows: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """Where rows 0 to n - 1 go, or with ``back`` which rows come to these places.

    Numbers that leave 0 to n - 1 walk on along their cycle until they return; less than half of
    the network's range lies outside, so that takes two passes on average.
    """
    bits, keys = max(2, (n - 1).bit_length()), round_keys(seed)
    if bits > 64:
        raise ValueError("row numbers take 64 bits at most")
    out = _once(rows.astype(np.uint64), bits, keys, back)
    while len(away := np.flatnonzero(out >= np.uint64(n))):
        out[away] = _once(out[away], bits, keys, back)
    return out.astype(np.int64)


def row_at(shard: int, slot: int, shards: int, n: int, seed: int = 0) -> int:
    """The global row number that stands in ``slot`` of ``shard``."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def number_rows(rows: DataFrame, keys: list[str], number: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with their global number in the order of ``keys`` (NULL first), and their count.

    Equal keys are told apart by where Spark read them, so even one key in a third of all rows is
    spread over the sorted ranges; rows equal in all columns may change places between runs. The sorted rows
    are written to the checkpoint folder once: numbering again after a lost executor gives the same.
    """
    salted = rows.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("salt"))
    order = [F.col(f"row.`{k}`").asc_nulls_first() for k in keys] + [F.col("salt")]
    ordered = cut_lineage(salted.repartitionByRange(*order).sortWithinPartitions(*order).select("row"))
    placed = ordered.select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    counts = sorted(tuple(r) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    before, n = [], 0
    for part, size in counts:
        before.append((part, n))
        n += size
    first = F.create_map(*[F.lit(v) for pair in before for v in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    index = F.col("at") - F.shiftleft(F.col("part").cast("long"), 33)
    return placed.select(*[F.col("row")[c].alias(c) for c in rows.columns if c != number], (first[F.col("part")].cast("long") + index).alias(number)), n


def shard_rows(rows: DataFrame, keys: list[str], shards: int = 40, seed: int = 0) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shards differ by one row at most. An empty table gives an empty table; fewer rows than shards
    leave the last shards empty. NULL keys sort first. Input columns named like an added one are replaced.
    """
    added = {"shard", "slot", "row_number"}
    own = [c for c in rows.columns if c.lower() not in added]
    numbered, n = number_rows(rows.select(*own), keys)

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(permute(batch.to_numpy(), n, seed))

    placed = numbered.select(*own, place("row_number").alias("slot"))
    return placed.select(*own, F.pmod("slot", F.lit(shards)).cast("int").alias("shard"), F.expr(f"slot div {shards}").alias("slot"))
