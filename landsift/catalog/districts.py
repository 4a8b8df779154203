"""District splits, consensus, uncertainty, distances and buffers."""

from __future__ import annotations

from pyspark.sql import functions as F

from landsift import fixtures as fx
from landsift import schema as S
from landsift.catalog import geometry  # noqa: F401  (registers the views used here)
from landsift.catalog.base import VIEWS, query, rounded
from landsift.catalog.rasters import _optical
from landsift.functions import geo
from landsift.operators import distances, regions
from landsift.operators import districts as D

_STEPS = " + ".join(f"CAST(u >= {s!r}e0 AS INT)" for s in D.POISSON_STEPS)
_DRAW = "CAST(concat('0x', substr(md5(concat({key}, '|42')), 1, 8)) AS BIGINT) / 4294967296e0"
_METRES = """2 * 6371008.8e0 * asin(sqrt(least(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
    + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2), 1e0)))"""
VIEWS["sites"] = (("points",), "SELECT points.* FROM points JOIN part ON p_partkey = point_id WHERE p_size = 7")
VIEWS["district_scores"] = (("assessments",), """
    SELECT season, district_id, count(*) AS total, sum(CAST(rf = label AS INT)) AS rf, sum(CAST(gtb = label AS INT)) AS gtb FROM assessments GROUP BY ALL""")
VIEWS["drawn"] = (("district_scores",), f"""
    SELECT *, {_STEPS} AS weight FROM (SELECT *, {_DRAW.format(key="concat(district_id, ':', replicate)")} AS u FROM (
    SELECT *, unnest(range(0, 200)) AS replicate FROM district_scores) a) b""")
VIEWS["stratum_cells"] = (("assessments", "mapped"), """
    SELECT c.*, m.area, sum(c.n) OVER (PARTITION BY c.district_id, c.mapped_class) AS n_stratum FROM (
    SELECT district_id, rf AS mapped_class, label, count(*) AS n FROM assessments GROUP BY ALL) c JOIN mapped m USING (district_id, mapped_class)""")
VIEWS["weighted"] = (("stratum_cells",), """
    SELECT *, area / (SELECT sum(area) FROM (SELECT DISTINCT district_id, mapped_class, area FROM stratum_cells)) * n / n_stratum AS p FROM stratum_cells""")
VIEWS["moved"] = (("points",), """
    SELECT lon + (point_id % 7 - 3) * 0.00001e0 AS lon, lat + (point_id % 5 - 2) * 0.00001e0 AS lat FROM points""")
_INTERVAL = ["low", "middle", "high"]


def _sites(spark, d):
    """Labelled sites: the points of one size of part."""
    sizes = fx.table(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("point_id"))
    return fx.points(spark, d).join(sizes, "point_id", "left_semi")


def _mapped(spark, d):
    rows = fx.table(spark, d, "lineitem").selectExpr(
        "l_suppkey AS district_id", "l_quantity",
        "CAST(CASE WHEN l_linenumber % 3 = 0 THEN (l_partkey + CAST(l_quantity AS BIGINT)) % 5 ELSE l_partkey % 5 END AS INT) AS mapped_class")
    return rows.groupBy("district_id", "mapped_class").agg(F.sum("l_quantity").alias("area"))


@query("district_split", f"""
    SELECT district_id, block, CASE WHEN held THEN 'withheld' WHEN {_DRAW.format(key="block")} < 15e0 / 44 THEN 'development' ELSE 'test' END AS role
    FROM (SELECT district_id, concat(CAST(floor((w + e) / 2 / 0.2e0) AS BIGINT), '_', CAST(floor((s + n) / 2 / 0.2e0) AS BIGINT)) AS block,
    district_id IN (SELECT district_id FROM located SEMI JOIN sites USING (point_id)) AS held FROM districts) b""", ("located", "sites", "districts"))
def district_split(spark, d):
    return D.split_districts(fx.districts(spark, d), _sites(spark, d))


@query("consensus_labels", """
    SELECT m.pixel_id, coalesce(v.votes, 0) AS votes, CASE WHEN v.votes >= 2 THEN v.label END AS consensus FROM public_maps m LEFT JOIN (
    SELECT pixel_id, label, CAST(n AS INT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY n DESC, label) AS rn FROM (
    SELECT pixel_id, label, count(*) AS n FROM (SELECT pixel_id, unnest([map_a, map_b, map_c]) AS label FROM public_maps) u
    WHERE label IS NOT NULL GROUP BY ALL) c) r WHERE rn = 1) v USING (pixel_id)""", ("public_maps",))
def consensus_labels(spark, d):
    maps = fx.public_maps(spark, d)
    return D.consensus(maps, ["map_a", "map_b", "map_c"], S.CLASS_IDS, 2).select("pixel_id", "votes", "consensus")


@query("unanimous_labels", """
    SELECT pixel_id, CASE WHEN map_a = map_b AND map_b = map_c THEN map_a END AS consensus FROM public_maps""", ("public_maps",))
def unanimous_labels(spark, d):
    return D.consensus(fx.public_maps(spark, d), ["map_a", "map_b", "map_c"], S.CLASS_IDS, 3).select("pixel_id", "consensus")


@query("accuracy_interval", """
    SELECT season, round(quantile_cont(a, 0.025), 6) AS low, round(median(a), 6) AS middle, round(quantile_cont(a, 0.975), 6) AS high FROM (
    SELECT season, replicate, sum(weight * gtb) / nullif(sum(weight * total), 0) AS a FROM drawn GROUP BY ALL) r GROUP BY season""", ("drawn",))
def accuracy_interval(spark, d):
    return rounded(D.accuracy_interval(fx.assessments(spark, d), "gtb", by=["season"]), _INTERVAL)


@query("district_differences", """
    SELECT season, district_id, round((gtb - rf) / (total * 1e0), 6) + 0e0 AS difference FROM district_scores""", ("district_scores",))
def district_differences(spark, d):
    return rounded(D.district_differences(fx.assessments(spark, d), "gtb", "rf", ["season"]), ["difference"])


@query("paired_difference_interval", """
    SELECT season, round(quantile_cont(a, 0.025), 6) + 0e0 AS low, round(median(a), 6) + 0e0 AS middle, round(quantile_cont(a, 0.975), 6) + 0e0 AS high FROM (
    SELECT season, replicate, sum(weight * (gtb - rf) / (total * 1e0)) / nullif(sum(weight), 0) AS a FROM drawn GROUP BY ALL) r GROUP BY season""", ("drawn",))
def paired_difference_interval(spark, d):
    return rounded(D.paired_interval(fx.assessments(spark, d), "gtb", "rf", by=["season"]), _INTERVAL)


@query("area_adjusted_accuracy", """
    SELECT round(sum(w * p), 6) AS accuracy, round(sqrt(sum(w * w * coalesce(p * (1 - p) / nullif(n - 1, 0), 0))), 6) AS standard_error, count(*) AS strata FROM (
    SELECT district_id, mapped_class, area / sum(area) OVER () AS w, n, hits / n AS p FROM (
    SELECT district_id, mapped_class, max(area) AS area, max(n_stratum) AS n, sum(CASE WHEN label = mapped_class THEN n ELSE 0 END) AS hits
    FROM stratum_cells GROUP BY ALL) a) b""", ("stratum_cells",))
def area_adjusted_accuracy(spark, d):
    return rounded(D.area_adjusted(fx.assessments(spark, d), _mapped(spark, d), "rf"), ["accuracy", "standard_error"])


@query("area_adjusted_classes", """
    SELECT label AS class_id, round(share, 6) AS area_share, round(hits / mapped_share, 6) AS users, round(hits / share, 6) AS producers FROM (
    SELECT label, sum(p) AS share, sum(CASE WHEN label = mapped_class THEN p ELSE 0 END) AS hits FROM weighted GROUP BY label) t
    LEFT JOIN (SELECT mapped_class AS label, sum(p) AS mapped_share FROM weighted GROUP BY mapped_class) m USING (label)""", ("weighted",))
def area_adjusted_classes(spark, d):
    classes = D.area_adjusted_classes(fx.assessments(spark, d), _mapped(spark, d), "rf")
    return rounded(classes, ["area_share", "users", "producers"])


@query("class_spacing", f"""
    SELECT CAST(label AS INT) AS label, count(*) AS points, count(*) FILTER (WHERE m <= 2500) AS near_points, round(median(m), 3) AS median_m, round(max(m), 3) AS max_m
    FROM (SELECT a.label, a.point_id, min({_METRES.format(a="a", b="b")}) AS m FROM points a JOIN points b
    ON a.label = b.label AND a.point_id <> b.point_id GROUP BY a.label, a.point_id) n GROUP BY label""", ("points",))
def class_spacing(spark, d):
    labelled = fx.points(spark, d).dropna(subset=["label"]).withColumn("label", F.col("label").cast("int"))
    return rounded(distances.within_class_spacing(labelled, 2500.0, 2500.0), ["median_m", "max_m"], 3)


@query("table_displacement", f"""
    SELECT count(*) AS points, round(max(m), 3) AS max_m, round(avg(m), 3) AS mean_m FROM (
    SELECT a.point_id, min({_METRES.format(a="a", b="b")}) AS m FROM points a JOIN moved b
    ON b.lat BETWEEN a.lat - 0.001e0 AND a.lat + 0.001e0 AND b.lon BETWEEN a.lon - 0.001e0 AND a.lon + 0.001e0 GROUP BY a.point_id) n""", ("points", "moved"))
def table_displacement(spark, d):
    points = fx.points(spark, d)
    moved = points.selectExpr("lon + (point_id % 7 - 3) * 0.00001D AS lon", "lat + (point_id % 5 - 2) * 0.00001D AS lat")
    return rounded(distances.displacement(points, moved, []), ["max_m", "mean_m"], 3)


@query("outside_training_buffer", f"""
    SELECT point_id FROM points a WHERE NOT EXISTS (SELECT 1 FROM sites b WHERE {_METRES.format(a="a", b="b")} <= 3000)""", ("points", "sites"))
def outside_training_buffer(spark, d):
    return distances.outside_buffer(fx.points(spark, d), _sites(spark, d), 3000.0).select("point_id")


@query("composite_depth", """
    SELECT district_id, count(*) AS pixels, CAST(sum(valid) AS BIGINT) AS valid, round(avg(valid), 6) AS mean_depth, min(valid) AS min_depth, max(valid) AS max_depth
    FROM located JOIN (SELECT x, y, count(B4) AS valid FROM optical_pixels GROUP BY x, y) o USING (x, y) GROUP BY district_id""",
    ("located", "optical_pixels"))
def composite_depth(spark, d):
    pixels = fx.with_lonlat(_optical(spark, d).select("x", "y", "B4"))
    return rounded(D.composite_depth(pixels, fx.districts(spark, d), "B4"), ["mean_depth"])


@query("recall_by_distance", f"""
    SELECT label, count(*) AS districts, round(regr_slope(recall, km / 100), 6) + 0e0 AS slope_per_100km, round(avg(recall), 6) AS mean_recall FROM (
    SELECT district_id, label, avg(CAST(rf = label AS INT)) AS recall FROM assessments GROUP BY ALL) r
    JOIN (SELECT a.district_id, {_METRES.format(a="a", b="b")} / 1000 AS km FROM
    (SELECT district_id, (w + e) / 2 AS lon, (s + n) / 2 AS lat FROM districts) a, (SELECT 79.5e0 AS lon, 22.8e0 AS lat) b) k USING (district_id)
    GROUP BY label""", ("assessments", "districts"))
def recall_by_distance(spark, d):
    boxes = regions.prepared(fx.districts(spark, d), ["district_id"])
    lon, lat = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    away = boxes.select("district_id", (geo.haversine_m(lon, lat, F.lit(79.5), F.lit(22.8)) / 1000).alias("km"))
    per = D.recall_by_distance(fx.assessments(spark, d).join(away, "district_id"), "rf", F.col("km"))
    return rounded(per, ["slope_per_100km", "mean_recall"])
