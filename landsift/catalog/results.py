"""Experiment results: best rows, ranks, set-up scores, pivots and search tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from landsift import fixtures as fx
from landsift import schema as S
from landsift.catalog.base import query, round_sql, rounded
from landsift.operators import quality, ranking
from landsift.plans.experiments import planned_against_found, sweep_grid

_PLACE = """CASE season WHEN 'Early Summer' THEN 1 WHEN 'Post-Monsoon' THEN 2 ELSE 3 END, cloud_cover,
    CASE classifier WHEN 'CART' THEN 1 WHEN 'Random Forest' THEN 2 WHEN 'k-NN' THEN 3 WHEN 'SVM (RBF)' THEN 4 ELSE 5 END"""
_ROW = "season, cloud_cover, classifier, round(accuracy, 6) AS accuracy, round(kappa, 6) AS kappa, image_count"


def _best(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {_ROW} FROM (SELECT *, row_number() OVER ({part}ORDER BY accuracy DESC, {_PLACE}) AS rn
    FROM sweep WHERE accuracy IS NOT NULL) r WHERE rn = 1"""


def _scores(df):
    return rounded(df, ["accuracy", "kappa"])


def _best_rows(spark, d, by):
    return _scores(ranking.best_rows(fx.sweep(spark, d), by, "accuracy", ranking.sweep_position()))


@query("sweep_results", f"SELECT {_ROW} FROM sweep", ("sweep",))
def sweep_results(spark, d):
    return _scores(fx.sweep(spark, d))


@query("valid_runs", f"SELECT {_ROW} FROM valid_sweep", ("valid_sweep",))
def valid_runs(spark, d):
    return _scores(ranking.valid_runs(fx.sweep(spark, d), drop_perfect=True))


@query("best_overall", _best(""), ("sweep",))
def best_overall(spark, d):
    return _best_rows(spark, d, [])


@query("best_per_season", _best("season"), ("sweep",))
def best_per_season(spark, d):
    return _best_rows(spark, d, ["season"])


@query("best_per_threshold", _best("cloud_cover"), ("sweep",))
def best_per_threshold(spark, d):
    return _best_rows(spark, d, ["cloud_cover"])


@query("best_per_classifier", _best("classifier"), ("sweep",))
def best_per_classifier(spark, d):
    return _best_rows(spark, d, ["classifier"])


def _top(n: int) -> str:
    return f"""SELECT {_ROW}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY classifier
    ORDER BY accuracy DESC, kappa DESC, {_PLACE}) AS INT) AS rank FROM valid_sweep) r WHERE rank <= {n}"""


@query("top_five_per_classifier", _top(5), ("valid_sweep",))
def top_five_per_classifier(spark, d):
    return _scores(ranking.top_n(fx.sweep(spark, d), "classifier", 5, ranking.sweep_position()))


@query("top_three_per_classifier", _top(3), ("valid_sweep",))
def top_three_per_classifier(spark, d):
    return _scores(ranking.top_n(fx.sweep(spark, d), "classifier", 3, ranking.sweep_position()))


_SETUP = """SELECT season, cloud_cover, avg(accuracy) AS avg_accuracy, avg(kappa) AS avg_kappa,
    count(DISTINCT classifier) AS model_count FROM {rows} GROUP BY season, cloud_cover"""
_MEANS = ["avg_accuracy", "avg_kappa"]


@query("setup_scores", f"SELECT season, cloud_cover, model_count, {round_sql(_MEANS)} FROM ({_SETUP.format(rows='valid_sweep')}) s", ("valid_sweep",))
def setup_scores(spark, d):
    return rounded(ranking.setup_scores(fx.sweep(spark, d)), _MEANS)


@query("setup_scores_unfiltered", f"SELECT season, cloud_cover, model_count, {round_sql(_MEANS)} FROM ({_SETUP.format(rows='sweep')}) s", ("sweep",))
def setup_scores_unfiltered(spark, d):
    return rounded(ranking.setup_scores(fx.sweep(spark, d), drop_perfect=False), _MEANS)


_COMPLETE = f"""SELECT * FROM ({_SETUP.format(rows='valid_sweep')}) s WHERE model_count = (SELECT max(model_count) FROM ({_SETUP.format(rows='valid_sweep')}) m)"""


@query("complete_setups", f"SELECT season, cloud_cover, model_count, {round_sql(_MEANS)} FROM ({_COMPLETE}) c", ("valid_sweep",))
def complete_setups(spark, d):
    return rounded(ranking.complete_setups(ranking.setup_scores(fx.sweep(spark, d))), _MEANS)


_WINNER = f"SELECT season, cloud_cover FROM ({_COMPLETE}) c ORDER BY avg_accuracy DESC, avg_kappa DESC, season, cloud_cover LIMIT 1"


@query("best_setup", f"""SELECT season, cloud_cover, model_count, {round_sql(_MEANS)} FROM ({_COMPLETE}) c
    ORDER BY avg_accuracy DESC, avg_kappa DESC, c.season, c.cloud_cover LIMIT 1""", ("valid_sweep",))
def best_setup(spark, d):
    return rounded(ranking.best_setup(fx.sweep(spark, d)), _MEANS)


@query("best_setup_unfiltered", f"""SELECT season, cloud_cover, model_count, {round_sql(_MEANS)} FROM ({_SETUP.format(rows='sweep')}) c
    ORDER BY c.avg_accuracy DESC NULLS LAST, c.avg_kappa DESC NULLS LAST, c.season, c.cloud_cover LIMIT 1""", ("sweep",))
def best_setup_unfiltered(spark, d):
    return rounded(ranking.best_setup(fx.sweep(spark, d), drop_perfect=False), _MEANS)


@query("winning_rows", f"SELECT {_ROW} FROM valid_sweep SEMI JOIN ({_WINNER}) w USING (season, cloud_cover)", ("valid_sweep",))
def winning_rows(spark, d):
    runs = fx.sweep(spark, d)
    return _scores(ranking.rows_of_setup(runs, ranking.best_setup(runs)))


_FIVE = ["low", "q1", "median", "q3", "high"]


@query("accuracy_spread", """
    SELECT season, classifier, round(min(accuracy), 6) AS low, round(quantile_cont(accuracy, 0.25), 6) AS q1, round(median(accuracy), 6) AS median,
    round(quantile_cont(accuracy, 0.75), 6) AS q3, round(max(accuracy), 6) AS high FROM valid_sweep GROUP BY season, classifier""", ("valid_sweep",))
def accuracy_spread(spark, d):
    return rounded(ranking.accuracy_spread(fx.sweep(spark, d)), _FIVE)


@query("mean_accuracy_by_threshold", """
    SELECT cloud_cover, classifier, round(avg(accuracy), 6) AS accuracy FROM valid_sweep GROUP BY cloud_cover, classifier""", ("valid_sweep",))
def mean_accuracy_by_threshold(spark, d):
    return rounded(ranking.mean_by_threshold(fx.sweep(spark, d)), ["accuracy"])


def _pivot(score: str) -> str:
    cols = ", ".join(f"round(max(CASE WHEN season = '{s}' THEN {score} END), 6) AS {n}" for s, n in (
        ("Early Summer", "early_summer"), ("Post-Monsoon", "post_monsoon"), ("Winter", "winter")))
    return f"SELECT classifier, {cols} FROM sweep WHERE cloud_cover = 15 GROUP BY classifier"


_SEASON_COLS = ["early_summer", "post_monsoon", "winter"]


@query("accuracy_by_season", _pivot("accuracy"), ("sweep",))
def accuracy_by_season(spark, d):
    return rounded(ranking.season_pivot(fx.sweep(spark, d), "accuracy", 15), _SEASON_COLS)


@query("kappa_by_season", _pivot("kappa"), ("sweep",))
def kappa_by_season(spark, d):
    return rounded(ranking.season_pivot(fx.sweep(spark, d), "kappa", 15), _SEASON_COLS)


@query("season_order", f"SELECT season, CAST({_PLACE.split(', cloud_cover')[0]} AS INT) AS ordinal, count(*) AS runs FROM sweep GROUP BY ALL", ("sweep",))
def season_order(spark, d):
    runs = fx.sweep(spark, d).withColumn("ordinal", ranking.season_order(F.col("season")))
    return runs.groupBy("season", "ordinal").agg(F.count("*").alias("runs")).orderBy("ordinal")


@query("planned_runs", """
    SELECT g.season, g.cloud_cover, g.classifier, CAST(row_number() OVER (ORDER BY s, g.cloud_cover, c) - 1 AS INT) AS position,
    round(r.accuracy, 6) AS accuracy, round(r.kappa, 6) AS kappa, coalesce(r.image_count, 0) AS image_count FROM (
    SELECT * FROM (VALUES (1, 'Early Summer'), (2, 'Post-Monsoon'), (3, 'Winter')) AS a(s, season),
    (VALUES (5), (10), (15), (20), (30), (50)) AS b(cloud_cover),
    (VALUES (1, 'CART'), (2, 'Random Forest'), (3, 'k-NN'), (4, 'SVM (RBF)'), (5, 'XGBoost')) AS z(c, classifier)) g
    LEFT JOIN (SELECT * FROM sweep WHERE accuracy IS NOT NULL) r USING (season, cloud_cover, classifier)""", ("sweep",))
def planned_runs(spark, d):
    found = fx.sweep(spark, d).filter("accuracy IS NOT NULL")
    return _scores(planned_against_found(found, list(S.SWEEP_SEASONS), S.SWEEP_CLOUDS, list(S.SWEEP_MODELS)))


def _values(values) -> str:
    return ", ".join(f"({repr(v)})" for v in values)


@query("sweep_coverage", f"""
    SELECT season, cloud_cover, classifier, accuracy IS NOT NULL AS scored, coalesce(image_count, 0) AS images
    FROM (VALUES {_values(S.SWEEP_SEASONS)}) a(season) CROSS JOIN (VALUES {_values(S.SWEEP_CLOUDS)}) b(cloud_cover) CROSS JOIN (VALUES {_values(S.SWEEP_MODELS)}) c(classifier)
    LEFT JOIN (SELECT * FROM sweep WHERE NOT (classifier = 'SVM (RBF)' AND cloud_cover = 20)) s USING (season, cloud_cover, classifier)""", ("sweep",))
def sweep_coverage(spark, d):
    """Every planned run against the results found, of which some are missing."""
    found = fx.sweep(spark, d).filter("NOT (classifier = 'SVM (RBF)' AND cloud_cover = 20)")
    full = planned_against_found(found, list(S.SWEEP_SEASONS), S.SWEEP_CLOUDS, list(S.SWEEP_MODELS))
    return full.select("season", "cloud_cover", "classifier", F.col("accuracy").isNotNull().alias("scored"), F.coalesce("image_count", F.lit(0)).alias("images"))


@query("before_after_deltas", """
    SELECT season, classifier, round(b.accuracy, 6) AS before, round(a.accuracy, 6) AS after, round(a.accuracy - b.accuracy, 6) + 0e0 AS delta
    FROM (SELECT * FROM sweep WHERE cloud_cover = 5) b JOIN (SELECT * FROM sweep WHERE cloud_cover = 50) a USING (season, classifier)""", ("sweep",))
def before_after_deltas(spark, d):
    runs = fx.sweep(spark, d)
    deltas = ranking.metric_deltas(runs.filter("cloud_cover = 5"), runs.filter("cloud_cover = 50"), ["season", "classifier"])
    return rounded(deltas, ["before", "after", "delta"])


@query("schema_version_check", f"""
    SELECT cloud_cover, count(DISTINCT v) AS versions, max(v) AS schema_version, count(DISTINCT v) = 1 AS single,
    CAST(regexp_extract(max(v), '([0-9]+)-band', 1) AS INT) AS band_count, CAST(regexp_extract(max(v), '([0-9]+)-band', 1) AS INT) = {len(S.BANDS)} AS bands_ok FROM (
    SELECT cloud_cover, CASE WHEN cloud_cover = 20 AND classifier = 'CART' OR cloud_cover = 50 THEN 'five-class-12-band-v4' ELSE '{S.SCHEMA_VERSION}' END AS v FROM sweep) s
    GROUP BY cloud_cover""", ("sweep",))
def schema_version_check(spark, d):
    """Results by cloud limit: one limit holds two versions, which a merge must refuse, and one an older version."""
    old = F.expr("cloud_cover = 20 AND classifier = 'CART' OR cloud_cover = 50")
    runs = fx.sweep(spark, d)
    parts = [quality.stamp(runs.filter(~old)), quality.stamp(runs.filter(old), "five-class-12-band-v4")]
    try:
        quality.merge_results(parts)
    except ValueError:
        return quality.version_check(parts[0].unionByName(parts[1]), ["cloud_cover"])
    raise AssertionError("results of two versions were merged")


# ---- hyperparameter search ----

_TUNING = ["mean_test_score", "std_test_score", "mean_train_score"]
_PARAMS = ["n_estimators", "min_samples_leaf", "max_samples"]


def _summary(spark, d):
    return ranking.fold_summary(fx.tuning_folds(spark, d), _PARAMS)


@query("tuning_table", f"""
    SELECT model, params_str, {", ".join(_PARAMS)}, {round_sql(_TUNING)}, CAST(rank_test_score AS INT) AS rank_test_score FROM tuning
    ORDER BY model, rank_test_score""", ("tuning",))
def tuning_table(spark, d):
    return rounded(_summary(spark, d), _TUNING).orderBy("model", "rank_test_score")


@query("best_params_per_model", """
    SELECT model, params_str, round(mean_test_score, 6) AS mean_test_score FROM (SELECT *, row_number() OVER (PARTITION BY model
    ORDER BY round(mean_test_score, 9) DESC, params_str) AS rn FROM tuning) t WHERE rn = 1""", ("tuning",))
def best_params_per_model(spark, d):
    best = ranking.best_rows(_summary(spark, d), ["model"], "mean_test_score", [F.col("params_str")])
    return rounded(best.select("model", "params_str", "mean_test_score"), ["mean_test_score"])


@query("best_params_overall", """
    SELECT model, params_str, round(mean_test_score, 6) AS mean_test_score FROM tuning ORDER BY round(tuning.mean_test_score, 9) DESC, model, params_str LIMIT 1""", ("tuning",))
def best_params_overall(spark, d):
    best = ranking.best_rows(_summary(spark, d), [], "mean_test_score", [F.col("model"), F.col("params_str")])
    return rounded(best.select("model", "params_str", "mean_test_score"), ["mean_test_score"])


@query("score_by_trees_and_leaf", """
    SELECT TRY_CAST(n_estimators AS DOUBLE) AS n_estimators, TRY_CAST(min_samples_leaf AS DOUBLE) AS min_samples_leaf,
    round(avg(mean_test_score), 6) AS mean_test_score FROM tuning WHERE model = 'Random Forest' GROUP BY 1, 2""", ("tuning",))
def score_by_trees_and_leaf(spark, d):
    columns = {c: ranking.numeric(c) for c in ("n_estimators", "min_samples_leaf")}
    return rounded(ranking.mean_score_by(_summary(spark, d), "Random Forest", columns), ["mean_test_score"])


@query("score_by_max_samples", """
    SELECT coalesce(max_samples, 'None (all)') AS max_samples, round(avg(mean_test_score), 6) AS mean_test_score
    FROM tuning WHERE model = 'Random Forest' GROUP BY 1 ORDER BY 2 DESC""", ("tuning",))
def score_by_max_samples(spark, d):
    columns = {"max_samples": F.coalesce("max_samples", F.lit("None (all)"))}
    means = ranking.mean_score_by(_summary(spark, d), "Random Forest", columns)
    return rounded(means, ["mean_test_score"]).orderBy(F.col("mean_test_score").desc())


@query("score_by_trees", """
    SELECT TRY_CAST(n_estimators AS DOUBLE) AS n_estimators, round(avg(mean_test_score), 6) AS mean_test_score
    FROM tuning WHERE model = 'XGBoost' GROUP BY 1""", ("tuning",))
def score_by_trees(spark, d):
    means = ranking.mean_score_by(_summary(spark, d), "XGBoost", {"n_estimators": ranking.numeric("n_estimators")})
    return rounded(means, ["mean_test_score"])


_BAND = ["mean_test_score", "mean_train_score", "band_low", "band_high", "gap"]


@query("top_twenty_overfit", f"""
    SELECT model, params_str, position, {", ".join(f"CAST(round({c}, 6) AS DOUBLE) AS {c}" for c in _BAND)} FROM (
    SELECT model, params_str, position, mean AS mean_test_score, train AS mean_train_score, mean - std AS band_low, mean + std AS band_high, train - mean AS gap FROM (
    SELECT *, CAST(round(mean_test_score, 9) AS DECIMAL(18, 9)) AS mean, CAST(round(std_test_score, 9) AS DECIMAL(18, 9)) AS std,
    CAST(round(mean_train_score, 9) AS DECIMAL(18, 9)) AS train,
    CAST(row_number() OVER (PARTITION BY model ORDER BY rank_test_score, params_str) AS INT) AS position FROM tuning) s) t WHERE position <= 20""",
    ("tuning",))
def top_twenty_overfit(spark, d):
    top = ranking.top_parameter_sets(_summary(spark, d), 20)
    exact = {c: F.round(F.round(c, 9).cast("decimal(18,9)"), 6).cast("double") for c in _BAND}
    return top.select("model", "params_str", "position", *[v.alias(c) for c, v in exact.items()])
