"""Neighbourhood work on rasters kept as one row per cell.

Cells are cut into square tiles; border cells are also sent to the tiles next
door. After that single shuffle every 3x3 operation is local to its partition:
windows and groupings lead with the tile, so Spark adds no further exchange.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TILE = ["tx", "ty"]
TILE_SIZE = 64


def tile_of(coordinate: str, size: int) -> Column:
    return F.floor(F.col(coordinate) / size)


def to_tiles(cells: DataFrame, radius: int, size: int = TILE_SIZE) -> DataFrame:
    """Each cell once per tile whose halo of ``radius`` contains it; a halo may be wider than a tile."""
    def tiles(coordinate: str) -> Column:
        c = F.col(coordinate)
        return F.explode(F.sequence(F.floor((c - radius) / size), F.floor((c + radius) / size)))

    return cells.withColumn("tx", tiles("x")).withColumn("ty", tiles("y"))


def own_cells(cells: DataFrame, size: int = TILE_SIZE) -> DataFrame:
    """Drop the halo: every cell is kept by exactly one tile."""
    mine = (F.col("tx") == tile_of("x", size)) & (F.col("ty") == tile_of("y", size))
    return cells.filter(mine).drop(*TILE)


def neighbours_3x3(tiled: DataFrame, value: Column, name: str = "cells") -> DataFrame:
    """Add the nine values around each cell, row by row from the top left.

    A neighbour that is missing or masked is NULL. Cells whose own row
    neighbours are absent give NULL too, so use this where all nine are needed.
    """
    along = W.partitionBy(*TILE, "y").orderBy("x")
    down = W.partitionBy(*TILE, "x").orderBy("y")
    row = tiled.withColumn("_v", value)
    row = row.withColumn("_row", F.struct(
        F.when(F.lag("x").over(along) == F.col("x") - 1, F.lag("_v").over(along)).alias("l"),
        F.col("_v").alias("c"),
        F.when(F.lead("x").over(along) == F.col("x") + 1, F.lead("_v").over(along)).alias("r"),
    ))
    grid = row.withColumns({
        "_up": F.when(F.lag("y").over(down) == F.col("y") - 1, F.lag("_row").over(down)),
        "_dn": F.when(F.lead("y").over(down) == F.col("y") + 1, F.lead("_row").over(down)),
    })
    cells = [F.col(r)[c] for r in ("_up", "_row", "_dn") for c in ("l", "c", "r")]
    return grid.withColumn(name, F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)])).drop("_v", "_row", "_up", "_dn")


def focal_mode_tiled(tiled: DataFrame, value: str, radius: int = 1, labels: list[int] | None = None) -> DataFrame:
    """Majority label of the square window on tiled cells, ties to the smallest.

    Masked cells do not vote and masked centres stay masked; edges use the
    neighbours that exist. Input needs a halo of ``radius``; one row per
    (tile, x, y) comes back. The input is read once: a masked cell sends only a
    marker to itself, any other cell a vote to every window it is part of.
    """
    offsets = F.array(*[F.lit(d) for d in range(-radius, radius + 1)])
    at_home = (F.col("_dx") == 0) & (F.col("_dy") == 0)
    votes = (
        tiled.select(*TILE, "x", "y", F.col(value).alias("_c"))
        .withColumn("_dx", F.explode(offsets))
        .withColumn("_dy", F.explode(offsets))
        .filter(F.col("_c").isNotNull() | at_home)
    )
    target = [*TILE, (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y")]
    home = F.when(at_home, F.when(F.col("_c").isNull(), 1).otherwise(2)).otherwise(0)  # 1 masked, 2 seen, 0 absent
    grouped = votes.select(*target, "_c", home.alias("_home")).groupBy(*TILE, "x", "y")
    if labels is None:
        counted = grouped.agg(F.max("_home").alias("_home"), F.mode("_c", deterministic=True).alias("_best"))
    else:
        # n * span + (last - label): the largest number is the most voted, then smallest, label.
        span, last = max(labels) - min(labels) + 1, max(labels)
        counts = grouped.agg(
            F.max("_home").alias("_home"), *[F.count_if(F.col("_c") == k).alias(f"_n{k}") for k in labels]
        )
        scores = [F.col(f"_n{k}") * span + (last - k) for k in labels]
        top = F.greatest(*scores) if len(scores) > 1 else scores[0]
        counted = counts.withColumn("_best", (F.lit(last) - top % span).cast("int"))
    return counted.filter("_home > 0").select(*TILE, "x", "y", F.when(F.col("_home") == 2, F.col("_best")).alias(value))


def focal_mode(image: DataFrame, value: str, radius: int = 1, labels: list[int] | None = None, size: int = TILE_SIZE) -> DataFrame:
    """Focal mode of a whole raster; masked centres come back as NULL rows."""
    tiled = to_tiles(image.select("x", "y", value), radius, size).repartition(*TILE)
    return own_cells(focal_mode_tiled(tiled, value, radius, labels), size)


# ---- Texture ----

# Cell pairs one step apart inside a 3x3 window, per direction (0, 90, 45, 135 degrees).
PAIRS = {
    "0": [(0, 1), (1, 2), (3, 4), (4, 5), (6, 7), (7, 8)],
    "90": [(0, 3), (3, 6), (1, 4), (4, 7), (2, 5), (5, 8)],
    "45": [(3, 1), (4, 2), (6, 4), (7, 5)],
    "135": [(0, 4), (1, 5), (3, 7), (4, 8)],
}
TEXTURES = ["contrast", "ent", "var", "idm", "diss", "asm"]


def glcm(grey: np.ndarray, wanted: list[str]) -> dict[str, np.ndarray]:
    """Features of many complete 3x3 windows, one row of nine grey levels each.

    Symmetric matrix per direction, feature averaged over the four directions,
    natural logarithm. A pair that occurs m times among n contributes m/n to the
    matrix, so sums over matrix entries are taken as sums over pairs.
    """
    total = {name: np.zeros(len(grey)) for name in wanted}
    for pairs in PAIRS.values():
        first, second = (grey[:, [pair[side] for pair in pairs]] for side in (0, 1))
        n = len(pairs)
        diff = first - second
        values = {}
        if "contrast" in total:
            values["contrast"] = (diff**2).mean(axis=1)
        if "diss" in total:
            values["diss"] = np.abs(diff).mean(axis=1)
        if "idm" in total:
            values["idm"] = (1 / (1 + diff**2)).mean(axis=1)
        if "var" in total:
            values["var"] = ((first**2 + second**2) / 2).mean(axis=1) - ((first + second) / 2).mean(axis=1) ** 2
        if {"asm", "ent"} & set(total):
            code = np.minimum(first, second) * 1024 + np.maximum(first, second)
            times = (code[:, :, None] == code[:, None, :]).sum(axis=2)
            share = np.where(diff == 0, times / n, times / (2 * n))
            values["asm"] = share.mean(axis=1)
            values["ent"] = -np.log(share).mean(axis=1)
        for name in total:
            total[name] += values[name] / len(PAIRS)
    return total


def texture_bands(image: DataFrame, cells: str, prefix: str, wanted: list[str]) -> DataFrame:
    """Texture bands from a struct of nine grey levels; a missing cell gives NULL.

    Spark brings the nine values together; the arithmetic runs on Arrow batches,
    because unrolled it outgrows one generated JVM method.
    """
    names = [f"{prefix}_{name}" for name in wanted]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def features(windows: pd.DataFrame) -> pd.DataFrame:
        grey = windows.to_numpy(dtype="float64", na_value=np.nan)
        complete = ~np.isnan(grey).any(axis=1)
        out = pd.DataFrame(np.nan, index=windows.index, columns=names)
        out.loc[complete, names] = np.column_stack(list(glcm(grey[complete], wanted).values()))
        return out  # NaN reaches Spark as NULL

    return image.withColumn("_t", features(F.col(cells))).withColumns({n: F.col("_t")[n] for n in names}).drop("_t")


def texture(image: DataFrame, grey: str, prefix: str, wanted: list[str] | None = None, size: int = TILE_SIZE) -> DataFrame:
    """3x3 texture of one whole-number grey band: x, y and the feature bands."""
    wanted = wanted or TEXTURES
    tiled = to_tiles(image.select("x", "y", grey).filter(F.col(grey).isNotNull()), 1, size).repartition(*TILE)
    around = neighbours_3x3(tiled, F.col(grey))
    done = texture_bands(own_cells(around, size), "cells", prefix, wanted)
    return done.select("x", "y", *[f"{prefix}_{name}" for name in wanted])
