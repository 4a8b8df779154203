"""Writers of result tables, rasters, samples and reports."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from landsift import schema as S
from landsift.operators.grid import assign_tiles
from landsift.session import path_exists


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_raster(classified: DataFrame, path: str, tile_px: int = S.TILE_PX) -> None:
    """Class raster as Parquet, one directory per tile.

    Rows are brought together by tile first, so a tile is a few large files and
    not one small file per task.
    """
    tiled = assign_tiles(classified, tile_px)
    tiled.repartition("tile_y", "tile_x").write.mode("overwrite").partitionBy("tile_y", "tile_x").parquet(path)


def write_sample(sample: DataFrame, path: str) -> None:
    """Sampled points keep their position and the version they were made under."""
    from landsift.operators.quality import stamp

    stamp(sample).write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.select("value").write.mode("overwrite").text(path)


def write_once(df: DataFrame, root: str, key: str) -> str:
    """Write under the content key unless a finished result is there already.

    The rows go to a folder of this write's own, which takes the key's name in one step when all is there.
    Of two writers at once one wins, the other drops its copy, and a reader sees a whole result or none.
    The step is one only where the file system renames folders in one; an object store may not.
    """
    spark = df.sparkSession
    path = os.path.join(root, key)
    if path_exists(spark, os.path.join(path, "_SUCCESS")):
        return path
    staged = os.path.join(root, f".{key}-{uuid.uuid4().hex}")
    df.write.parquet(staged)
    if not _take_name(spark, staged, path):
        _drop(spark, staged)
    return path


def _take_name(spark: SparkSession, staged: str, path: str) -> bool:
    """Rename, unless a finished result has the name; what an older, broken write left there goes first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(hadoop.Path(staged).toUri(), spark._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    for _ in range(2):
        try:
            files.rename(hadoop.Path(staged), hadoop.Path(path), keep)
            return True
        except Py4JJavaError:
            if path_exists(spark, os.path.join(path, "_SUCCESS")):
                return False
            if not path_exists(spark, path):
                raise
            _drop(spark, path)
    raise OSError(f"{path} cannot be taken")


def _drop(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
