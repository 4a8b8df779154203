"""Labelled points, splits, source checks, predictions and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from landsift import fixtures as fx
from landsift import schema as S
from landsift.catalog.base import archive, query, round_sql, rounded
from landsift.catalog.rasters import _optical
from landsift.operators import composite as C
from landsift.operators import metrics, quality, sampling
from landsift.functions import spectral as X
from landsift.plans.experiments import campus_image
from landsift.plans.features import Request, training_sample

_U = "CAST(concat('0x', substr(md5(concat({ident}, '|42')), 1, 8)) AS BIGINT) / 4294967296e0"
_BLK = "((floor(lon * 10) * 31 + floor(lat * 10) * 17) % 10)"
_BINARY_SQL = ", ".join(["B4", "B8", "(B8 - B4) / nullif(B8 + B4, 0) AS NDVI"])


@query("sample_at_points", f"""
    SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat, CAST(label AS INT) AS label, {round_sql(S.BINARY_BANDS)}
    FROM points JOIN (SELECT x, y, {_BINARY_SQL} FROM composite) c USING (x, y)
    WHERE label IS NOT NULL AND B4 IS NOT NULL AND B8 IS NOT NULL AND NDVI IS NOT NULL""", ("points", "composite"))
def sample_at_points(spark, d):
    image = C.median_composite(_optical(spark, d).select("x", "y", "B4", "B8"), ["B4", "B8"])
    image = image.withColumn("NDVI", X.normalized_difference("B8", "B4"))
    sample = sampling.sample_at_points(image, fx.points(spark, d), S.BINARY_BANDS, ["point_id", "lon", "lat", "label"])
    return rounded(sample.withColumn("label", F.col("label").cast("int")), ["lon", "lat", *S.BINARY_BANDS])


@query("points_to_cells", """
    SELECT point_id, x, y FROM points""", ("points",))
def points_to_cells(spark, d):
    located = sampling.cell_of_points(fx.points(spark, d).drop("x", "y"), fx.ORIGIN_LON, fx.ORIGIN_LAT, fx.PIXEL_DEG)
    return located.select("point_id", "x", "y")


@query("training_sample", f"""
    SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat, CAST(label AS INT) AS label, {round_sql(["B4", "B8", "NDVI", "VV", "VH", "VVVH"])}
    FROM (SELECT point_id, lon, lat, label, B4, B8, NDVI,
    least(greatest((VV + 25e0) / 30, 0e0), 1e0) AS VV, least(greatest((VH + 30e0) / 30, 0e0), 1e0) AS VH,
    least(greatest((VV - VH + 5e0) / 25, 0e0), 1e0) AS VVVH
    FROM points JOIN indices USING (x, y) JOIN radar_composite USING (x, y)
    WHERE label IS NOT NULL AND VV IS NOT NULL AND VH IS NOT NULL AND B4 IS NOT NULL AND B8 IS NOT NULL AND NDVI IS NOT NULL) s""",
    ("points", "indices", "radar_composite"))
def training_sample_query(spark, d):
    bands = ["B4", "B8", "NDVI", "VV", "VH", "VVVH"]
    sample = training_sample(archive(spark, d), fx.points(spark, d), Request(*fx.WINDOW), bands)
    return rounded(sample.withColumn("label", F.col("label").cast("int")), ["lon", "lat", *bands])


@query("full_stack_sample", None)
def full_stack_sample(spark, d):
    everything = Request("1990-01-01", "2030-01-01", 101)
    points = fx.points(spark, d).withColumn("label", F.col("label").cast("int"))
    return training_sample(archive(spark, d), points, everything, S.FULL_BANDS)


@query("point_bounds", """
    SELECT round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north FROM points""",
    ("points",))
def point_bounds(spark, d):
    box = sampling.point_bounds(fx.points(spark, d))
    return rounded(box.select("west", "south", "east", "north"), ["west", "south", "east", "north"])


@query("random_split", f"""
    SELECT point_id, round(u, 9) AS random, CASE WHEN u < 0.7e0 THEN 'train' ELSE 'test' END AS part FROM (
    SELECT point_id, {_U.format(ident="point_id")} AS u FROM points) p""", ("points",))
def random_split(spark, d):
    split = sampling.random_split(fx.points(spark, d), "point_id", 42, 0.7)
    return rounded(split.select("point_id", "random", "part"), ["random"], 9)


@query("block_split", f"""
    SELECT point_id, CAST({_BLK} AS INT) AS blk, CASE WHEN {_BLK} < 7 THEN 'train' ELSE 'test' END AS part FROM points""", ("points",))
def block_split(spark, d):
    return sampling.block_split(fx.points(spark, d)).select("point_id", "blk", "part")


@query("train_test_counts", f"""
    SELECT class_id AS label, name, count(*) FILTER (WHERE blk < 7) AS train, count(*) FILTER (WHERE blk >= 7) AS test,
    count(*) FILTER (WHERE blk >= 7) = 0 AS missing FROM classes LEFT JOIN (SELECT label, {_BLK} AS blk FROM points) p
    ON p.label = class_id GROUP BY class_id, name""", ("classes", "points"))
def train_test_counts(spark, d):
    return sampling.part_counts(sampling.block_split(fx.points(spark, d)), S.class_table(spark))


@query("label_histogram", "SELECT source, CAST(label AS INT) AS label, count(*) AS n FROM points GROUP BY ALL", ("points",))
def label_histogram(spark, d):
    return sampling.label_histogram(fx.points(spark, d)).withColumn("label", F.col("label").cast("int"))


@query("class_distribution", """
    SELECT CAST(label AS INT) AS label, count(*) AS n FROM points WHERE label IS NOT NULL GROUP BY label""", ("points",))
def class_distribution(spark, d):
    counts = fx.points(spark, d).dropna(subset=["label"]).groupBy(F.col("label").cast("int").alias("label"))
    return counts.agg(F.count("*").alias("n"))


@query("source_audit", """
    SELECT e.source, count(p.source) AS n, count(p.label) AS labelled, count(p.label) = 0 AS unlabelled,
    coalesce(min(p.label) = e.label AND max(p.label) = e.label, false) AS label_ok,
    CASE WHEN e.n IS NULL THEN true ELSE coalesce(e.n = count(p.source), false) END AS count_ok
    FROM (VALUES ('forest', 0, NULL), ('water', 1, NULL), ('buildings', 2, NULL), ('barren', 3, 1000), ('agriculture', 4, 1000)) AS e(source, label, n)
    LEFT JOIN (SELECT source, CASE WHEN source = 'water' THEN NULL ELSE label END AS label FROM points) p ON p.source = e.source
    GROUP BY e.source, e.label, e.n""", ("points",))
def source_audit(spark, d):
    lost = F.when(F.col("source") != "water", F.col("label"))
    return quality.source_audit(fx.points(spark, d).withColumn("label", lost))


@query("merged_sources", "SELECT point_id, source FROM points", ("points",))
def merged_sources(spark, d):
    from landsift.sources.scenes import merge

    points = fx.points(spark, d)
    return merge([points.filter(F.col("source") == s) for s in S.SOURCE_LABELS]).select("point_id", "source")


# ---- scores ----

_CELLS = """
    SELECT a.class_id AS label, b.class_id AS classification, count(p.label) AS n FROM classes a CROSS JOIN classes b
    LEFT JOIN predictions p ON p.label = a.class_id AND p.classification = b.class_id GROUP BY ALL"""
_TOTALS = """
    SELECT total, round(po, 9) AS accuracy, round((po - pe) / (1 - pe), 9) AS kappa FROM (SELECT count(*) AS total,
    avg(CAST(label = classification AS INT)) AS po,
    (SELECT sum(r.n * c.n) FROM (SELECT label AS k, count(*) * 1e0 AS n FROM predictions GROUP BY label) r
    JOIN (SELECT classification AS k, count(*) * 1e0 AS n FROM predictions GROUP BY classification) c USING (k))
    / (SELECT count(*) * 1e0 * count(*) FROM predictions) AS pe FROM predictions) t"""


@query("confusion_matrix", _CELLS, ("classes", "predictions"))
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(fx.predictions(spark, d), S.CLASS_IDS)


@query("confusion_matrix_unseen_class", """
    SELECT a.class_id AS label, b.class_id AS classification, count(p.label) AS n FROM classes a CROSS JOIN classes b
    LEFT JOIN (SELECT * FROM predictions WHERE label <> 2 AND classification <> 2) p
    ON p.label = a.class_id AND p.classification = b.class_id GROUP BY ALL""", ("classes", "predictions"))
def confusion_matrix_unseen_class(spark, d):
    return metrics.confusion_matrix(fx.predictions(spark, d).filter("label <> 2 AND classification <> 2"), S.CLASS_IDS)


@query("accuracy_and_kappa", _TOTALS, ("predictions",))
def accuracy_and_kappa(spark, d):
    _, total, _ = metrics.evaluate(fx.predictions(spark, d))
    return rounded(total, ["accuracy", "kappa"], 9)


_PER_CLASS = """
    SELECT class_id, name, round(sum(CAST(label = class_id AND classification = class_id AS INT))
    / nullif(sum(CAST(classification = class_id AS INT)), 0), 9) AS consumers,
    round(sum(CAST(label = class_id AND classification = class_id AS INT)) / nullif(sum(CAST(label = class_id AS INT)), 0), 9) AS producers
    FROM classes CROSS JOIN {rows} GROUP BY class_id, name"""


@query("per_class_accuracy", _PER_CLASS.format(rows="predictions"), ("classes", "predictions"))
def per_class_accuracy(spark, d):
    _, _, scores = metrics.evaluate(fx.predictions(spark, d))
    return rounded(scores, ["consumers", "producers"], 9)


@query("per_class_accuracy_missing_class", _PER_CLASS.format(
    rows="(SELECT * FROM predictions WHERE label <> 2 AND classification <> 2) p"), ("classes", "predictions"))
def per_class_accuracy_missing_class(spark, d):
    _, _, scores = metrics.evaluate(fx.predictions(spark, d).filter("label <> 2 AND classification <> 2"))
    return rounded(scores, ["consumers", "producers"], 9)


@query("scores_by_district", """
    SELECT district_id, total, round(po, 9) AS accuracy, round((po - pe) / nullif(1 - pe, 0), 9) AS kappa FROM (
    SELECT t.district_id, t.total, t.po, sum(coalesce(r.n * c.n, 0)) / (t.total * 1e0 * t.total) AS pe FROM (
    SELECT district_id, count(*) AS total, avg(CAST(label = rf AS INT)) AS po FROM assessments GROUP BY district_id) t
    LEFT JOIN (SELECT district_id, label AS k, count(*) * 1e0 AS n FROM assessments GROUP BY ALL) r USING (district_id)
    LEFT JOIN (SELECT district_id, rf AS k, count(*) * 1e0 AS n FROM assessments GROUP BY ALL) c
    ON c.district_id = t.district_id AND c.k = r.k GROUP BY t.district_id, t.total, t.po) z""", ("assessments",))
def scores_by_district(spark, d):
    matrix = metrics.confusion_matrix(fx.assessments(spark, d), by=["district_id"], predicted="rf")
    return rounded(metrics.overall(matrix, ["district_id"]), ["accuracy", "kappa"], 9)


@query("matrix_as_text", f"""
    SELECT concat('[', string_agg(row_text, ',' ORDER BY label), ']') AS confusion_matrix FROM (
    SELECT label, concat('[', string_agg(CAST(n AS VARCHAR), ',' ORDER BY classification), ']') AS row_text FROM ({_CELLS}) c GROUP BY label) r""",
    ("classes", "predictions"))
def matrix_as_text(spark, d):
    matrix = metrics.confusion_matrix(fx.predictions(spark, d), S.CLASS_IDS)
    return metrics.matrix_rows(matrix).select("confusion_matrix")


@query("matrix_is_square", """
    SELECT fixed, r AS rows, c AS cols, n AS cells, r = 5 AND c = 5 AND n = 25 AS is_square FROM (
    SELECT false AS fixed, count(DISTINCT label) AS r, count(DISTINCT classification) AS c, count(*) AS n FROM (
        SELECT DISTINCT label, classification FROM predictions WHERE label <> 2 AND classification <> 4) a
    UNION ALL SELECT true, count(DISTINCT a.class_id), count(DISTINCT b.class_id), count(*) FROM classes a CROSS JOIN classes b
        WHERE (SELECT count(*) FROM predictions WHERE label <> 2 AND classification <> 4) > 0) s""", ("classes", "predictions"))
def matrix_is_square(spark, d):
    """A class without rows: the matrix as counted has no place for it, the one over all classes has."""
    rows = fx.predictions(spark, d).filter("label <> 2 AND classification <> 4")
    shapes = [metrics.matrix_is_square(metrics.confusion_matrix(rows, classes), len(S.CLASSES)).withColumn("fixed", F.lit(classes is not None)) for classes in (None, S.CLASS_IDS)]
    return shapes[0].unionByName(shapes[1])


@query("matrix_shares", f"""
    SELECT *, round(n / nullif(sum(n) OVER (PARTITION BY label), 0), 9) AS share FROM ({_CELLS}) c""", ("classes", "predictions"))
def matrix_shares(spark, d):
    shares = metrics.running_share(metrics.confusion_matrix(fx.predictions(spark, d), S.CLASS_IDS))
    return rounded(shares, ["share"], 9)


@query("campus_image", f"""
    SELECT x, y, {round_sql(S.CAMPUS_BANDS)} FROM indices""", ("indices",))
def campus_image_query(spark, d):
    return rounded(campus_image(_optical(spark, d)), S.CAMPUS_BANDS)
