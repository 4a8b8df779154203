"""Trained models kept under a key of everything that decides them."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landsift import schema as S
from landsift.models.factory import Classifier, load_model
from landsift.session import path_exists, shared_folder, touch


def content_of(table: DataFrame) -> str:
    """Fingerprint of a table's rows, whatever their order: count and sums of two row hashes."""
    columns = sorted(table.columns)
    text = F.to_json(F.struct(*columns))
    row = table.agg(
        F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)")) for seed in (1, 2)]
    ).first()
    return json.dumps([columns, *map(str, row)])


def model_key(model: str, start: str, end: str, cloud: float, fallback: bool, *, params: dict | None = None,
              bands: list[str] | None = None, content: tuple[str, ...] = ()) -> str:
    """Same request, settings, bands and training content: same model, whatever the area of interest."""
    payload = [S.normalise_model(model), start, end, float(cloud), bool(fallback), S.SCHEMA_VERSION, params, bands, list(content)]
    return hashlib.sha1(json.dumps(payload, sort_keys=True, default=str).encode()).hexdigest()[:16]


class ModelStore:
    """Models are saved in the shared folder: pipelines as such, nearest-neighbour
    models as their training rows. A model counts as saved when its marker,
    written last, is there."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or os.path.join(shared_folder(spark), "models")
        self.kept: dict[str, object] = {}

    def get(self, key: str, classifier: Classifier, sample: Callable[[], DataFrame], bands: list[str]):
        if key not in self.kept:
            path = os.path.join(self.root, key)
            rows, marker = os.path.join(path, "rows"), os.path.join(path, "complete")
            saved = path_exists(self.spark, marker)
            if classifier.model == "knn":
                if not saved:
                    sample().write.mode("overwrite").parquet(rows)
                self.kept[key] = classifier.fit(self.spark.read.parquet(rows), bands)
            elif saved:
                self.kept[key] = load_model(self.spark, os.path.join(path, "model"))
            else:
                self.kept[key] = classifier.fit(sample(), bands)
                self.kept[key].save(os.path.join(path, "model"))
            if not saved:
                touch(self.spark, marker)
        return self.kept[key]
