"""End to end: from an area of interest to a classified raster and its areas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift import schema as S
from landsift.models.factory import make_classifier
from landsift.models.store import ModelStore, content_of, model_key
from landsift.operators import areas
from landsift.operators import neighborhood as N
from landsift.operators import regions
from landsift.operators.composite import stacked_composite, with_features
from landsift.operators.sampling import block_split
from landsift.plans.features import Archive, Request, selected_pixels, training_sample
from landsift.session import cut_plan

HALO = 2  # one cell for texture, one for smoothing


@dataclass
class ClassifyResult:
    pixels: DataFrame
    class_areas: DataFrame
    summary: DataFrame
    model: dict[str, str]


def classified_raster(archive: Archive, request: Request, model, rings: list[list[tuple[float, float]]] | None = None,
                      bands: list[str] | None = None, smoothing: bool = True) -> DataFrame:
    """Class of every pixel (x, y, lon, lat, classification).

    A pixel's tile is fixed before the median, with a halo wide enough for
    texture and smoothing, so one shuffle carries the whole chain. The composite
    is clipped first: beyond the polygon there is nothing to read.
    """
    cells = box = None
    if rings:
        lons, lats = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        box = (min(lons), min(lats), max(lons), max(lats))
        cells = archive.window_of(box)
    composite = stacked_composite(*selected_pixels(archive, request, cells, box), radius=HALO, size=archive.tile_size)
    if rings:
        composite = regions.clip(archive.with_lonlat(composite), rings).drop("lon", "lat")
    scored = model.transform(with_features(composite).select(*N.TILE, "x", "y", *(bands or S.BANDS)))
    scored = scored.select(*N.TILE, "x", "y", "classification")
    if smoothing:
        scored = N.focal_mode_tiled(scored, "classification", labels=S.CLASS_IDS)
    return archive.with_lonlat(N.own_cells(scored, archive.tile_size))


def classify_and_analyze(archive: Archive, points: DataFrame, request: Request, rings, model: str = S.DEFAULT_MODEL,
                         params: dict | None = None, smoothing: bool = True, bands: list[str] | None = None,
                         store: ModelStore | None = None) -> ClassifyResult:
    """Train or reuse the model, classify the area, add up its classes."""
    spark = archive.scenes.sparkSession
    bands = bands or S.BANDS
    key = S.normalise_model(model)
    trained = (store or ModelStore(spark)).get(
        model_key(
            key, request.start, request.end, request.cloud, request.allow_fallback, params=params, bands=bands,
            content=(content_of(points), content_of(archive.scenes)),
        ),
        make_classifier(key, params),
        lambda: cut_plan(training_sample(archive, points, request, bands)),
        bands,
    )
    pixels = cut_plan(classified_raster(archive, request, trained, rings, bands, smoothing))
    name, kind, _ = S.MODELS[key]
    return ClassifyResult(
        pixels, areas.class_area_table(pixels), areas.area_summary(pixels), {"id": key, "name": name, "type": kind}
    )


def train_and_test_samples(archive: Archive, points: DataFrame, request: Request, bands: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Block split first, then each side is sampled on the composite of its own box."""
    sided = block_split(points)
    return tuple(
        training_sample(archive, sided.filter(F.col("part") == part), request, bands) for part in ("train", "test")
    )
