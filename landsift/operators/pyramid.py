"""Coarser scales: means of bands, majorities of classes, and areas that count only what was seen.

Cells of a coarser level are whole numbers of finer ones and begin at a multiple of their side, so levels
can be made of each other. Sums and class counts are kept, not means and majorities, so a level made of
another equals one made of the pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift import schema as S
from landsift.session import cut_lineage

BASE_M = 10
SCALES_M = [10, 30, 50, 100]


def up(df: DataFrame, factor: int) -> DataFrame:
    return df.withColumns({c: F.floor(F.col(c) / factor).cast("long") for c in ("x", "y")})


def class_counts(classified: DataFrame) -> DataFrame:
    """Pixels of each class in each cell of the finest level; masked pixels are not counted."""
    kept = classified.filter("classification IS NOT NULL")
    return kept.select("x", "y", F.col("classification").alias("class_id")).groupBy("x", "y", "class_id").agg(F.count(F.lit(1)).alias("n"))


def coarser_counts(counts: DataFrame, factor: int) -> DataFrame:
    return up(counts, factor).groupBy("x", "y", "class_id").agg(F.sum("n").alias("n"))


def majority(counts: DataFrame) -> DataFrame:
    """x, y, classification, seen: each cell's most frequent class (ties to the least) and how many pixels were seen in it."""
    best = F.max(F.struct(F.col("n"), (-F.col("class_id")).alias("c")))
    return counts.groupBy("x", "y").agg(best.alias("best"), F.sum("n").alias("seen")).select("x", "y", (-F.col("best.c")).cast("int").alias("classification"), "seen")


def coarser_bands(pixels: DataFrame, bands: list[str], factor: int) -> DataFrame:
    """Means of the bands over the pixels that have them; ``seen`` is the share of the cell with a pixel."""
    grouped = up(pixels, factor).groupBy("x", "y").agg(*[F.avg(b).alias(b) for b in bands], (F.count(F.lit(1)) / (factor * factor)).alias("seen"))
    return grouped


def levels(classified: DataFrame, scales: list[int] | None = None, base_m: int = BASE_M) -> dict[int, DataFrame]:
    """Class counts by scale, a pass a level: each is made of the coarsest finer level that it is a multiple of."""
    out: dict[int, DataFrame] = {base_m: cut_lineage(class_counts(classified))}
    for scale in sorted(scales or SCALES_M):
        if scale not in out:
            below = max((s for s in out if scale % s == 0), default=None)
            if below is None:
                raise ValueError(f"{scale} m is no multiple of {base_m} m")
            out[scale] = cut_lineage(coarser_counts(out[below], scale // below))
    return {s: out[s] for s in sorted(scales or SCALES_M)}


def area_by_scale(classified: DataFrame, scales: list[int] | None = None, base_m: int = BASE_M) -> DataFrame:
    """scale_m, class_id, cells, area_sqm: a cell's area goes to its majority class, weighted by the part of it that was seen."""
    parts = []
    for scale, counts in levels(classified, scales, base_m).items():
        areas = majority(counts).groupBy(F.col("classification").alias("class_id")).agg(
            F.count(F.lit(1)).alias("cells"), (F.sum("seen") * float(base_m * base_m)).alias("area_sqm"))
        parts.append(areas.select(F.lit(scale).alias("scale_m"), "class_id", "cells", "area_sqm"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def resampled(classified: DataFrame, scale_m: int, base_m: int = BASE_M) -> DataFrame:
    """The class raster at a coarser scale, for export: x, y (of the coarser grid), classification, seen (share of the cell)."""
    counts = levels(classified, [scale_m], base_m)[scale_m]
    return majority(counts).withColumn("seen", F.col("seen") / (scale_m // base_m) ** 2)


def area_table(classified: DataFrame, scale_m: int) -> DataFrame:
    """Every class with its area at a scale, absent ones at zero: what an area export holds."""
    found = area_by_scale(classified, [scale_m]).drop("scale_m")
    classes = S.class_table(classified.sparkSession).select("class_id", "name")
    return classes.join(found, "class_id", "left").select("class_id", "name", F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("area_sqm", F.lit(0.0)).alias("area_sqm"))
