"""Readers of points, boundaries, result tables and uploaded areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landsift import schema as S
from landsift.functions import geo

RUNS = "runs array<struct<model:string,season:string,stage:string,accuracy:double,kappa:double>>, schema_version string"


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SCENES).parquet(path)


def read_points(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Labelled points, one path per source; the source becomes a column."""
    from landsift.sources.scenes import merge

    return merge([spark.read.parquet(p).withColumn("source", F.lit(name)) for name, p in paths.items()])


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SWEEP).csv(path, header=True)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation runs of a results document, one row per run."""
    document = spark.read.schema(RUNS).json(path, multiLine=True)
    return document.select("schema_version", F.inline("runs"))


def areas_of_interest(documents: DataFrame) -> DataFrame:
    """Uploaded GeoJSON to geometry text, bounding box and number of positions.

    What holds no polygon has a NULL geometry: it is rejected, not dropped.
    """
    parsed = documents.withColumn("geometry", geo.polygon_geometry(F.col("document")))
    points = geo.positions(F.col("geometry"))
    return parsed.withColumns({
        "accepted": F.col("geometry").isNotNull(),
        "kind": F.get_json_object("geometry", "$.type"),
        "points": F.size(points),
        "box": F.when(F.col("geometry").isNotNull(), geo.bounds(points)),
    })


def boxes(areas: DataFrame, key: str) -> DataFrame:
    return areas.filter("accepted").select(key, "box.*")


def coordinate_rows(areas: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """One row per position of each geometry, in order."""
    return areas.select(key, F.posexplode(geo.positions(F.col(geometry))).alias("pos", "p")).select(key, "pos", "p.lon", "p.lat")
