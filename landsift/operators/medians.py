"""Exact per-key medians that hold up when one key owns much of the data.

Ordinary keys go through ``median`` after one shuffle. Keys that own a large
number of rows are found first by one small global aggregate and take a
second route: histogram, pick the bucket that holds the middle rank, and look
only there. Both routes are exact, so routing never changes a result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_KEYS = 5_000
HOT_ROWS = 1_000_000
BUCKETS = 4096


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = HOT_ROWS, limit: int = HOT_KEYS) -> list[int]:
    """Hashes of the keys that hold more than ``min_rows`` rows, however large the table.

    One aggregate with a fixed-size sketch; at most ``limit`` values come back,
    the largest. A hash collision only sends one more key down the other exact route.
    """
    row = df.select(F.xxhash64(*keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {limit}, {limit * 10})").alias("top")
    ).first()
    return [item["item"] for item in (row["top"] or []) if item["count"] > min_rows]


def is_hot(keys: list[str], hot: list[int]) -> Column:
    return F.xxhash64(*keys).isin(hot)


def exact_medians(
    df: DataFrame,
    keys: list[str],
    values: list[str],
    partition_by: list[str] | None = None,
    extra: dict[str, Column] | None = None,
    hot_from: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Median of each value column per key, NULLs skipped, middle two averaged.

    ``partition_by`` (a subset of the keys) names the shuffle key, so that later
    steps on the same key need no further shuffle. ``extra`` adds plain
    aggregates. ``hot_from`` names the key columns that decide hotness.
    """
    spread = partition_by or keys
    extra = extra or {}

    def plain(rows: DataFrame) -> DataFrame:
        return rows.repartition(*spread).groupBy(*keys).agg(
            *[F.median(v).alias(v) for v in values], *[c.alias(n) for n, c in extra.items()]
        )

    routing = hot_from or keys
    hot = hot_keys(df, routing, hot_rows)
    if not hot:
        return plain(df)
    cold = plain(df.filter(~is_hot(routing, hot)))
    warm = refined_medians(df.filter(is_hot(routing, hot)), keys, values, extra)
    return cold.unionByName(warm).repartition(*spread)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with a few rows per key added; NULL keys are equal."""
    renamed = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(F.broadcast(renamed), same, how).drop(*[f"_{k}" for k in keys])


def refined_medians(rows: DataFrame, keys: list[str], values: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Medians of a few very large groups, without gathering any of them."""
    entry = F.explode(F.array(*[F.struct(F.lit(v).alias("band"), F.col(v).cast("double").alias("v")) for v in values]))
    group = [*keys, "band"]
    tall = rows.select(*keys, entry.alias("e")).select(*keys, "e.band", "e.v").filter("v IS NOT NULL")

    # One row per hot key and band: HOT_KEYS bounds them, so broadcasts are small.
    span = tall.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    width = F.col("hi") - F.col("lo")
    bucket = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width * BUCKETS), F.lit(BUCKETS - 1))).otherwise(0)
    placed = joined(tall, span, group).withColumn("bucket", bucket)

    counts = placed.groupBy(*group, "bucket").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    running = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.withColumn("upto", F.sum("c").over(running)).withColumns({
        "before": F.col("upto") - F.col("c"),
        "low_rank": F.floor((F.col("n") + 1) / 2),
        "high_rank": F.floor(F.col("n") / 2) + 1,
    })
    middle = ranked.filter("before < high_rank AND upto >= low_rank").select(
        *group, "bucket", "before", "low_rank", "high_rank"
    )

    inside = joined(placed, middle, [*group, "bucket"]).groupBy(*group, "v").agg(
        F.count("*").alias("c"), F.min("before").alias("before"),
        F.first("low_rank").alias("low_rank"), F.first("high_rank").alias("high_rank"),
    )
    by_value = W.partitionBy(*group).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed_at = inside.withColumn("rank", F.sum("c").over(by_value) + F.min("before").over(by_value))
    medians = placed_at.groupBy(*group).agg(
        ((F.min(F.when(F.col("rank") >= F.col("low_rank"), F.col("v")))
          + F.min(F.when(F.col("rank") >= F.col("high_rank"), F.col("v")))) / 2).alias("m")
    )
    wide = medians.groupBy(*keys).agg(*[F.max(F.when(F.col("band") == v, F.col("m"))).alias(v) for v in values])
    base = rows.groupBy(*keys).agg(F.count("*").alias("rows_seen"), *[c.alias(n) for n, c in (extra or {}).items()])
    return joined(base, wide, keys, "left").select(*keys, *values, *(extra or {}))
