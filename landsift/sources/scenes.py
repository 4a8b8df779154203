"""Scene selection and the pixels that belong to the selected scenes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift import schema as S
from landsift.functions import spectral as X


def in_window(ts: Column, start: str, end: str) -> Column:
    """Half-open: the end day is the first one left out."""
    return (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))


def boxes_overlap(west: Column, south: Column, east: Column, north: Column, box: tuple[float, float, float, float]) -> Column:
    w, s, e, n = box
    return (west <= e) & (east >= w) & (south <= n) & (north >= s)


FOOTPRINT = ["west", "south", "east", "north"]


def within(scenes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Scenes whose footprint, kept with their metadata, overlaps the box; one without a footprint may."""
    unknown = F.col("west").isNull() | F.col("south").isNull() | F.col("east").isNull() | F.col("north").isNull()
    return scenes.filter(unknown | boxes_overlap(*[F.col(c) for c in FOOTPRINT], box))


def with_fallback(wanted: DataFrame, spare: DataFrame) -> DataFrame:
    """``wanted``, or ``spare`` when it is empty. Decided inside the query."""
    return wanted.unionByName(spare.filter(~wanted.select("scene_id").exists()))


def optical_scenes(
    scenes: DataFrame,
    start: str,
    end: str,
    cloud: float = S.DEFAULT_CLOUD,
    allow_fallback: bool = False,
    fallback_window: tuple[str, str] = S.FALLBACK_WINDOW,
    fallback_cloud: float = S.FALLBACK_CLOUD,
) -> DataFrame:
    optical = scenes.filter(F.col("sensor") == "S2")

    def chosen(window: tuple[str, str], limit: float) -> DataFrame:
        return optical.filter(in_window(F.col("ts"), *window) & (F.col("cloud_pct") < limit))

    wanted = chosen((start, end), cloud)
    return with_fallback(wanted, chosen(fallback_window, fallback_cloud)) if allow_fallback else wanted


def radar_scenes(
    scenes: DataFrame,
    start: str,
    end: str,
    allow_fallback: bool = False,
    fallback_window: tuple[str, str] = S.FALLBACK_WINDOW,
) -> DataFrame:
    """Interferometric wide swath, both polarisations, one orbit direction."""
    dual = scenes.filter(
        (F.col("sensor") == "S1")
        & (F.col("instrument_mode") == S.RADAR_MODE)
        & (F.col("orbit_pass") == S.RADAR_PASS)
        & F.array_contains("polarisations", "VV")
        & F.array_contains("polarisations", "VH")
    )
    wanted = dual.filter(in_window(F.col("ts"), start, end))
    return with_fallback(wanted, dual.filter(in_window(F.col("ts"), *fallback_window))) if allow_fallback else wanted


def scene_footprints(observations: DataFrame) -> DataFrame:
    """Bounding box of every scene's pixels (needs lon, lat)."""
    return observations.groupBy("scene_id").agg(
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")
    )


def touching(scenes: DataFrame, footprints: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Scenes whose footprint overlaps the box."""
    hit = footprints.filter(boxes_overlap(F.col("west"), F.col("south"), F.col("east"), F.col("north"), box))
    return scenes.join(hit.select("scene_id"), "scene_id", "left_semi")


def observations_of(observations: DataFrame, scenes: DataFrame, columns: list[str]) -> DataFrame:
    """Pixels of the selected scenes.

    No broadcast hint: the number of scenes grows with the archive, so Spark
    picks the join from measured sizes, and splits a scene that dominates.
    """
    return observations.select("scene_id", "x", "y", *columns).join(scenes.select("scene_id"), "scene_id")


def optical_pixels(observations: DataFrame, scenes: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """Cloud-masked reflectance of the selected scenes; masked values are NULL."""
    bands = bands or S.OPTICAL_BANDS
    pixels = observations_of(observations, scenes, [*bands, "QA60"])
    return pixels.select("scene_id", "x", "y", *[X.masked_reflectance(b).alias(b) for b in bands])


def radar_pixels(observations: DataFrame, scenes: DataFrame) -> DataFrame:
    return observations_of(observations, scenes, S.RADAR_BANDS)


def merge(collections: list[DataFrame]) -> DataFrame:
    """Union of labelled collections in the given order; none at all is an error."""
    if not collections:
        raise ValueError("At least one training collection is required")
    return reduce(lambda a, b: a.unionByName(b), collections)
