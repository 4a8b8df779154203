"""Median composites and the feature stack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift import schema as S
from landsift.functions import spectral as X
from landsift.operators import medians
from landsift.operators import neighborhood as N

KEYS = ["x", "y"]
OPTICAL_TEXTURES = ["contrast", "ent", "var", "idm", "diss", "asm"]
RADAR_TEXTURES = ["contrast", "var", "ent"]


def median_composite(pixels: DataFrame, bands: list[str], **routing) -> DataFrame:
    """Per-pixel, per-band median over time, NULLs skipped. One shuffle."""
    return medians.exact_medians(pixels.select(*KEYS, *bands), KEYS, bands, **routing)


def stacked_pixels(optical: DataFrame, radar: DataFrame) -> DataFrame:
    """Optical and radar pixels in one table: each side is NULL in the other's bands."""
    optical_side = optical.select(
        "x", "y", *S.OPTICAL_BANDS, *[F.lit(None).cast("double").alias(b) for b in S.RADAR_BANDS], F.lit(1).alias("optical")
    )
    radar_side = radar.select(
        "x", "y", *[F.lit(None).cast("double").alias(b) for b in S.OPTICAL_BANDS], *S.RADAR_BANDS, F.lit(0).alias("optical")
    )
    return optical_side.unionByName(radar_side)


def stacked_composite(optical: DataFrame, radar: DataFrame, radius: int = 0, size: int = N.TILE_SIZE, **routing) -> DataFrame:
    """Both composites at once, on tiles with a halo of ``radius``.

    A median skips NULL, so one grouping of the union gives both composites and
    no join is needed. Only pixels with an optical scene survive; where radar
    has none, its bands are NULL.
    """
    both = N.to_tiles(stacked_pixels(optical, radar), radius, size)
    composite = medians.exact_medians(
        both, [*N.TILE, *KEYS], [*S.OPTICAL_BANDS, *S.RADAR_BANDS], partition_by=N.TILE,
        extra={"optical": F.max("optical")}, hot_from=KEYS, **routing,
    )
    return composite.filter("optical = 1").drop("optical")


def join_composites(optical: DataFrame, radar: DataFrame) -> DataFrame:
    """Put radar bands next to optical ones; optical pixels survive without radar."""
    return optical.join(radar, KEYS, "left")


def with_features(tiled: DataFrame) -> DataFrame:
    """Every band of the full stack on a tiled composite with a halo of one or more.

    Grey levels come from unscaled bands, so texture precedes the rescaling.
    """
    grey = tiled.withColumns({"_g": X.optical_grey(), "_s": X.radar_grey()})
    around = N.neighbours_3x3(grey, F.struct("_g", "_s"), "_around")
    cells = {
        f"_{k}cells": F.struct(*[F.col("_around")[f"c{i}"][f"_{k}"].alias(f"c{i}") for i in range(9)]) for k in ("g", "s")
    }
    staged = around.withColumns(cells).drop("_around")
    staged = N.texture_bands(staged, "_gcells", "g", OPTICAL_TEXTURES)
    staged = N.texture_bands(staged, "_scells", "s", RADAR_TEXTURES)
    textures = [f"g_{n}" for n in OPTICAL_TEXTURES] + [f"s_{n}" for n in RADAR_TEXTURES]
    return staged.withColumns({**X.spectral_indices(), **X.radar_bands(), **X.rescale_bands(textures)}).drop(
        "_g", "_s", "_gcells", "_scells"
    )


def feature_stack(optical: DataFrame, radar: DataFrame, bands: list[str] | None = None, size: int = N.TILE_SIZE, **routing) -> DataFrame:
    """Composite, indices, texture and radar of whole rasters: x, y and the bands."""
    tiled = with_features(stacked_composite(optical, radar, radius=1, size=size, **routing))
    return N.own_cells(tiled, size).select("x", "y", *(bands or S.BANDS))


def scene_count(scenes: DataFrame) -> DataFrame:
    return scenes.agg(F.count("*").alias("image_count"))
