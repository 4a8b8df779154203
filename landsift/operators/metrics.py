"""Confusion matrices and what is read off them. Rows are actual, columns predicted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landsift import schema as S
from landsift.session import cut_lineage


def class_pairs(spark: SparkSession, classes: list[int]) -> DataFrame:
    rows = [(a, b) for a in classes for b in classes]
    return spark.createDataFrame(rows, "label int, classification int")


def confusion_matrix(df: DataFrame, classes: list[int] | None = None, by: list[str] | None = None,
                     label: str = "label", predicted: str = "classification") -> DataFrame:
    """Counts per (actual, predicted). With ``classes`` the matrix is fixed k x k,
    so a class without rows is an empty row and never shifts another one."""
    by = by or []
    counts = df.groupBy(*by, F.col(label).alias("label"), F.col(predicted).alias("classification")).agg(
        F.count("*").alias("n")
    )
    if classes is None:
        return counts
    if by:
        groups = counts.select(*by).distinct()
        cells = groups.select(
            *by, F.explode(F.array(*[F.lit(c) for c in classes])).alias("label")
        ).select("*", F.explode(F.array(*[F.lit(c) for c in classes])).alias("classification"))
    else:
        cells = class_pairs(df.sparkSession, classes)
    return cells.join(counts, [*by, "label", "classification"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_matrix_filled(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Square form over the labels that occur on either side, in each group."""
    by = by or []
    seen = matrix.select(*by, F.col("label").alias("k")).union(matrix.select(*by, "classification")).distinct()
    both = seen.groupBy(*by).agg(F.array_sort(F.collect_set("k")).alias("ks"))
    cells = both.select(*by, "ks", F.explode("ks").alias("label")).select(*by, "label", F.explode("ks").alias("classification"))
    return cells.join(matrix, [*by, "label", "classification"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def overall(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy and kappa, one row per group, from the small matrix."""
    by = by or []
    rows = matrix.groupBy(*by, F.col("label").alias("k")).agg(F.sum("n").alias("row_n"))
    cols = matrix.groupBy(*by, F.col("classification").alias("k")).agg(F.sum("n").alias("col_n"))
    hits = matrix.groupBy(*by).agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("label") == F.col("classification"), F.col("n")).otherwise(0)).alias("hits")
    )
    chance = rows.join(cols, [*by, "k"]).groupBy(*by).agg(
        F.sum(F.col("row_n").cast("double") * F.col("col_n")).alias("agree")
    )
    joined = hits.join(chance, by, "left") if by else hits.select("*", chance.scalar().alias("agree"))
    observed = F.try_divide(F.col("hits").cast("double"), F.col("total"))
    expected = F.try_divide(F.coalesce("agree", F.lit(0.0)), F.col("total").cast("double") * F.col("total"))
    return joined.withColumns({"accuracy": observed, "expected": expected}).select(
        *by, "total", "accuracy", F.try_divide(F.col("accuracy") - F.col("expected"), 1 - F.col("expected")).alias("kappa")
    )


def per_class(matrix: DataFrame, classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Consumer's and producer's accuracy aligned by label; no rows gives NULL, not 0."""
    by = by or []
    hit = F.when(F.col("label") == F.col("classification"), F.col("n")).otherwise(0)
    produced = matrix.groupBy(*by, F.col("label").alias("class_id")).agg(F.sum("n").alias("row_n"), F.sum(hit).alias("hits"))
    consumed = matrix.groupBy(*by, F.col("classification").alias("class_id")).agg(F.sum("n").alias("col_n"))
    both = produced.join(consumed, [*by, "class_id"], "full")
    if not by:
        both = classes.select("class_id", "name").join(both, "class_id", "left")
    else:
        both = both.join(classes.select("class_id", "name"), "class_id", "left")
    return both.select(
        *by, "class_id", "name",
        F.try_divide(F.coalesce("hits", F.lit(0)).cast("double"), F.col("col_n")).alias("consumers"),
        F.try_divide(F.col("hits").cast("double"), F.col("row_n")).alias("producers"),
    )


def matrix_rows(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The matrix as nested arrays in label order, and as text."""
    by = by or []
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("classification", "n"))), lambda c: c["n"])
    rows = matrix.groupBy(*by, "label").agg(in_order.alias("row"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("label", "row"))), lambda r: r["row"])
    return rows.groupBy(*by).agg(whole.alias("matrix")).withColumn("confusion_matrix", F.to_json("matrix"))


def matrix_is_square(matrix: DataFrame, k: int) -> DataFrame:
    return matrix.agg(
        F.count_distinct("label").alias("rows"), F.count_distinct("classification").alias("cols"), F.count("*").alias("cells")
    ).withColumn("is_square", (F.col("rows") == k) & (F.col("cols") == k) & (F.col("cells") == k * k))


def evaluate(df: DataFrame, classes: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matrix, overall scores and per-class scores from one count over the rows.

    The matrix is written down first, so predictions are made once and not per score.
    """
    spark = df.sparkSession
    matrix = cut_lineage(confusion_matrix(df, classes or S.CLASS_IDS))
    return matrix, overall(matrix), per_class(matrix, S.class_table(spark))


def running_share(matrix: DataFrame) -> DataFrame:
    """Each cell as a share of its actual class (what a heat map shows)."""
    return matrix.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(W.partitionBy("label"))))
