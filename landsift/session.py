"""Session defaults and lineage cuts."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "landsift", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Only a local session may go without it; it then gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="landsift-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    # With its scheme, so that workers which open files themselves find the same place.
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it from there.

    Used where a result feeds many later jobs (a training sample, a loop step),
    so that losing an executor never replays the whole history.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_plan(df: DataFrame) -> DataFrame:
    """``cut_lineage``, and most of what Spark knew of the rows is left behind, for loops and for tables of formulas.

    The estimated size of a join is the product of its sides', so in a loop of joins the number itself outgrows the
    driver: one that no longer fits a long says nothing and is left out. What held between columns is left out too:
    each column renamed later doubles it.
    """
    cut = cut_lineage(df)
    plan, spark = cut._jdf.queryExecution().analyzed(), df.sparkSession
    none = getattr(getattr(spark._jvm, "scala.None$"), "MODULE$")
    stats = plan.stats()
    known = spark._jvm.scala.Some(stats) if stats.sizeInBytes().bit_length() < 64 else none
    bare = spark._jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), none, spark._jsparkSession, known, none)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, bare), spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle, broadcast and checkpoint files that nothing refers to any more.

    It notices them only when the driver collects garbage, which a loop of many small jobs seldom makes it do.
    """
    gc.collect()
    spark._jvm.System.gc()


def touch(spark: SparkSession, path: str) -> None:
    """Write an empty file on whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True).close()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a file exist on whatever file system the path names?"""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
