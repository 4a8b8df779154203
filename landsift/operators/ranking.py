"""Ranking of experiment results. Tables may be large; groups are reduced before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landsift import schema as S


def season_order(season: Column, order: list[str] | None = None) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in order or list(S.SWEEP_SEASONS)]), season).cast("int")


def sweep_position() -> list[Column]:
    """Order in which a sweep writes its rows, for first-on-a-tie rules."""
    return [
        season_order(F.col("season")), F.col("cloud_cover"),
        F.array_position(F.array(*[F.lit(c) for c in S.SWEEP_MODELS]), F.col("classifier")),
    ]


def valid_runs(results: DataFrame, drop_perfect: bool = False) -> DataFrame:
    kept = results.filter(F.col("accuracy").isNotNull())
    return kept.filter(F.col("accuracy") < S.PERFECT_SCORE) if drop_perfect else kept


def best_rows(results: DataFrame, by: list[str], score: str, position: list[Column]) -> DataFrame:
    """The row with the highest score per group, the first written on a tie (equal to nine digits).

    An aggregate, not a window: each task keeps one candidate per group, so a
    group that owns most rows costs no more than any other.
    """
    order = F.struct((-F.round(score, 9)).alias("s"), *[p.alias(f"p{i}") for i, p in enumerate(position)])
    rest = [c for c in results.columns if c not in by]
    best = results.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("b"))
    return best.select(*by, "b.*") if by else best.filter("b IS NOT NULL").select("b.*")


def top_n(results: DataFrame, by: str, n: int, position: list[Column]) -> DataFrame:
    """Best n per group by accuracy then kappa. Spark prunes to n per task before the shuffle."""
    w = W.partitionBy(by).orderBy(F.col("accuracy").desc(), F.col("kappa").desc(), *position)
    return valid_runs(results, drop_perfect=True).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def setup_scores(results: DataFrame, drop_perfect: bool = True) -> DataFrame:
    """Mean scores and number of models per (season, cloud cover)."""
    rows = valid_runs(results, True) if drop_perfect else results
    return rows.groupBy("season", "cloud_cover").agg(
        F.avg("accuracy").alias("avg_accuracy"), F.avg("kappa").alias("avg_kappa"),
        F.count_distinct("classifier").alias("model_count"),
    )


def complete_setups(scores: DataFrame) -> DataFrame:
    """Setups that were scored by as many models as the fullest one."""
    return scores.filter(F.col("model_count") == scores.agg(F.max("model_count")).scalar())


def best_setup(results: DataFrame, drop_perfect: bool = True) -> DataFrame:
    scores = setup_scores(results, drop_perfect)
    ranked = complete_setups(scores) if drop_perfect else scores
    return ranked.orderBy(F.col("avg_accuracy").desc(), F.col("avg_kappa").desc(), "season", "cloud_cover").limit(1)


def rows_of_setup(results: DataFrame, setup: DataFrame, drop_perfect: bool = True) -> DataFrame:
    rows = valid_runs(results, True) if drop_perfect else results
    return rows.join(setup.select("season", "cloud_cover"), ["season", "cloud_cover"], "left_semi")


def accuracy_spread(results: DataFrame) -> DataFrame:
    """Five-number summary per season and classifier."""
    q = valid_runs(results, True).groupBy("season", "classifier").agg(
        F.percentile("accuracy", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q")
    )
    return q.select("season", "classifier", *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def mean_by_threshold(results: DataFrame) -> DataFrame:
    return valid_runs(results, True).groupBy("cloud_cover", "classifier").agg(F.avg("accuracy").alias("accuracy"))


def season_pivot(results: DataFrame, score: str, cloud_cover: int) -> DataFrame:
    """Classifier by season in presentation order."""
    seasons = list(S.SWEEP_SEASONS)
    wide = results.filter(F.col("cloud_cover") == cloud_cover).groupBy("classifier").pivot("season", seasons).agg(F.first(score))
    return wide.select("classifier", *[F.col(s).alias(s.lower().replace(" ", "_").replace("-", "_")) for s in seasons])


def full_sweep(grid: DataFrame, results: DataFrame) -> DataFrame:
    """Every planned run; one that failed or never ran has NULL scores, and 0 images when none was found."""
    keys = ["season", "cloud_cover", "classifier"]
    return grid.join(results, keys, "left").withColumn("image_count", F.coalesce("image_count", F.lit(0)))


# ---- Hyperparameter tables ----

def fold_summary(folds: DataFrame, params: list[str]) -> DataFrame:
    """Mean and population deviation of fold scores per parameter set, with a rank per model.

    Ranking runs on one row per parameter set, not on the folds.
    """
    per_fold = folds.groupBy("model", *params, "fold").agg(
        F.avg("test_score").alias("test"), F.avg("train_score").alias("train")
    )
    summary = per_fold.groupBy("model", *params).agg(
        F.avg("test").alias("mean_test_score"), F.stddev_pop("test").alias("std_test_score"),
        F.avg("train").alias("mean_train_score"),
    )
    return with_rank(summary.withColumn("params_str", F.to_json(F.struct(*params))))


def with_rank(summary: DataFrame) -> DataFrame:
    """Equal scores share the best rank (scores equal to nine digits count as equal)."""
    w = W.partitionBy("model").orderBy(F.round("mean_test_score", 9).desc())
    return summary.withColumn("rank_test_score", F.rank().over(w))


def numeric(column: str) -> Column:
    """Number, or NULL when the text is not one."""
    return F.col(column).try_cast("double")


def mean_score_by(summary: DataFrame, model: str, columns: dict[str, Column]) -> DataFrame:
    rows = summary.filter(F.col("model") == model).withColumns(columns)
    return rows.groupBy(*columns).agg(F.avg("mean_test_score").alias("mean_test_score"))


def top_parameter_sets(summary: DataFrame, n: int = 20) -> DataFrame:
    """Best n sets per model with the score band and the over-fit gap.

    Differences are taken between scores of nine exact digits, so the order in
    which a mean was added up never decides how they round.
    """
    w = W.partitionBy("model").orderBy("rank_test_score", "params_str")
    exact = lambda c: F.round(c, 9).cast("decimal(18,9)")
    mean, std, train = exact("mean_test_score"), exact("std_test_score"), exact("mean_train_score")
    return summary.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n).withColumns({
        "band_low": mean - std, "band_high": mean + std, "gap": train - mean
    })


def metric_deltas(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """After minus before for runs present on both sides."""
    b = before.select(*keys, F.col("accuracy").alias("before"))
    a = after.select(*keys, F.col("accuracy").alias("after"))
    return b.join(a, keys).withColumn("delta", F.col("after") - F.col("before"))
