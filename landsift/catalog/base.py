"""Registry of queries with the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landsift import fixtures as fx
from landsift.plans.features import Archive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

# ---- The fixture views in SQL, by name, with the views they read ----

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "scenes": ((), """
        SELECT o_orderkey AS scene_id, CASE WHEN o_orderkey % 4 = 0 THEN 'S1' ELSE 'S2' END AS sensor, o_orderdate AS ts,
        CAST(o_custkey % 100 AS DOUBLE) AS cloud_pct,
        CASE WHEN o_orderstatus = 'P' THEN 'EW' ELSE 'IW' END AS instrument_mode,
        CASE WHEN o_custkey % 2 = 0 THEN 'DESCENDING' ELSE 'ASCENDING' END AS orbit_pass,
        o_orderpriority <> '5-LOW' AS dual FROM orders"""),
    "observations": ((), """
        SELECT l_orderkey AS scene_id, l_partkey % 50 AS x, CAST(floor(l_partkey / 50) AS BIGINT) AS y,
        CAST(300 + (l_suppkey*37 + l_linenumber*11) % 1500 AS DOUBLE) AS B2,
        CAST(400 + (l_suppkey*53 + l_partkey*7) % 1800 AS DOUBLE) AS B3,
        CAST(300 + (l_partkey*29 + l_linenumber*101) % 2600 AS DOUBLE) AS B4,
        CAST(800 + (l_partkey*17 + l_suppkey*3) % 4200 AS DOUBLE) AS B8,
        CAST(900 + (l_partkey*13 + CAST(l_quantity AS BIGINT)*31) % 3600 AS DOUBLE) AS B11,
        CAST(500 + (l_partkey*23 + CAST(l_quantity AS BIGINT)*19) % 3000 AS DOUBLE) AS B12,
        CASE WHEN l_linenumber = 7 THEN 1024 WHEN l_linenumber = 6 THEN 2048 ELSE 0 END AS QA60,
        CAST(-25 + (l_partkey*5 + l_suppkey*7) % 30 AS DOUBLE) AS VV,
        CAST(-30 + (l_partkey*11 + l_suppkey*3) % 30 AS DOUBLE) AS VH FROM lineitem"""),
    "points": ((), """
        SELECT p_partkey AS point_id, p_partkey % 50 AS x, CAST(floor(p_partkey / 50) AS BIGINT) AS y,
        79e0 + (p_partkey % 50) * 0.02e0 + 0.01e0 AS lon, 22.8e0 + CAST(floor(p_partkey / 50) AS BIGINT) * 0.02e0 + 0.01e0 AS lat,
        CASE p_size % 5 WHEN 0 THEN 'forest' WHEN 1 THEN 'water' WHEN 2 THEN 'buildings'
        WHEN 3 THEN 'barren' ELSE 'agriculture' END AS source,
        CASE WHEN p_brand = 'Brand#2' THEN NULL ELSE p_size % 5 END AS label FROM part"""),
    "class_map": ((), """
        SELECT p_partkey % 50 AS x, CAST(floor(p_partkey / 50) AS BIGINT) AS y,
        CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST((p_size + p_partkey) % 5 AS INT) END AS classification FROM part"""),
    "predictions": ((), """
        SELECT vec_id, CAST(label % 5 AS INT) AS label,
        CAST(CASE WHEN vec_id % 4 = 0 THEN (label + vec_id) % 5 ELSE label % 5 END AS INT) AS classification FROM embeddings"""),
    "sweep": ((), """
        SELECT season, cloud_cover, classifier,
        CASE WHEN k % 10 = 0 THEN NULL WHEN k % 17 = 0 THEN 1e0 ELSE 0.5e0 + (event_id * 37 % 499) / 1000e0 END AS accuracy,
        CASE WHEN k % 10 = 0 THEN NULL ELSE 0.3e0 + (event_id * 53 % 697) / 1000e0 END AS kappa, k AS image_count FROM (
        SELECT *, row_number() OVER (PARTITION BY season, cloud_cover, classifier ORDER BY event_id) AS rn FROM (
        SELECT event_id, k,
        CASE WHEN day(ts) <= 10 THEN 'Early Summer' WHEN day(ts) <= 20 THEN 'Post-Monsoon' ELSE 'Winter' END AS season,
        CASE k % 6 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 15 WHEN 3 THEN 20 WHEN 4 THEN 30 ELSE 50 END AS cloud_cover,
        CASE event_type WHEN 'click' THEN 'CART' WHEN 'view' THEN 'Random Forest' WHEN 'error' THEN 'k-NN'
        WHEN 'signup' THEN 'SVM (RBF)' ELSE 'XGBoost' END AS classifier
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e) s) r WHERE rn = 1"""),
    "valid_sweep": (("sweep",), "SELECT * FROM sweep WHERE accuracy < 0.9999e0"),
    "tuning_folds": ((), """
        SELECT CASE event_type WHEN 'click' THEN 'SVM' WHEN 'view' THEN 'XGBoost' ELSE 'Random Forest' END AS model,
        CASE user_id % 4 WHEN 0 THEN '10' WHEN 1 THEN '50' WHEN 2 THEN '100' ELSE 'auto' END AS n_estimators,
        CASE user_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '3' ELSE '5' END AS min_samples_leaf,
        CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id % 5 AS VARCHAR) END AS max_samples,
        CAST(event_id % 5 AS INT) AS fold, (500 + (event_id * 37) % 401) / 1000e0 AS test_score,
        (600 + (event_id * 53) % 397) / 1000e0 AS train_score FROM events"""),
    "tuning": (("tuning_folds",), """
        SELECT *, rank() OVER (PARTITION BY model ORDER BY round(mean_test_score, 9) DESC) AS rank_test_score FROM (
        SELECT model, n_estimators, min_samples_leaf, max_samples,
        concat('{"n_estimators":"', n_estimators, '","min_samples_leaf":"', min_samples_leaf, '"',
        CASE WHEN max_samples IS NULL THEN '' ELSE concat(',"max_samples":"', max_samples, '"') END, '}') AS params_str,
        avg(test) AS mean_test_score, stddev_pop(test) AS std_test_score, avg(train) AS mean_train_score FROM (
        SELECT model, n_estimators, min_samples_leaf, max_samples, fold, avg(test_score) AS test, avg(train_score) AS train
        FROM tuning_folds GROUP BY ALL) f GROUP BY ALL) t"""),
    "geojson": ((), """
        SELECT aoi_id, CASE kind WHEN 0 THEN polygon WHEN 1 THEN multi
        WHEN 2 THEN concat('{"type":"Feature","properties":{},"geometry":', polygon, '}')
        WHEN 3 THEN concat('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":', point,
        '},{"type":"Feature","geometry":', multi, '},{"type":"Feature","geometry":', polygon, '}]}')
        WHEN 4 THEN point ELSE concat('{"type":"Feature","geometry":', point, '}') END AS document, kind, w, e, s, n, polygon, multi
        FROM (SELECT *, concat('{"type":"Polygon","coordinates":[', ring, ']}') AS polygon,
        concat('{"type":"MultiPolygon","coordinates":[[', ring, ']]}') AS multi,
        concat('{"type":"Point","coordinates":[', w, ',', s, ']}') AS point
        FROM (SELECT *, concat('[[', w, ',', s, '],[', e, ',', s, '],[', e, ',', n, '],[', w, ',', n, '],[', w, ',', s, ']]') AS ring
        FROM (SELECT c_custkey AS aoi_id, c_custkey % 6 AS kind,
        concat('79.', lpad(CAST(c_custkey % 90 AS VARCHAR), 2, '0')) AS w, concat('80.', lpad(CAST(c_custkey % 90 AS VARCHAR), 2, '0')) AS e,
        concat('22.', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS s, concat('23.', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS n
        FROM customer) a) b) c"""),
    "boxes": (("geojson",), """
        SELECT aoi_id, CAST(w AS DOUBLE) AS west, CAST(s AS DOUBLE) AS south, CAST(e AS DOUBLE) AS east, CAST(n AS DOUBLE) AS north
        FROM geojson WHERE kind < 4"""),
    "districts": ((), """
        SELECT s_suppkey AS district_id, s_name AS name, 79e0 + (s_suppkey % 5) * 0.2e0 AS w, 79e0 + (s_suppkey % 5 + 1) * 0.2e0 AS e,
        22.8e0 + floor(s_suppkey / 5) * 0.04e0 AS s, 22.8e0 + floor(s_suppkey / 5) * 0.04e0 + 0.02e0 AS m,
        22.8e0 + (floor(s_suppkey / 5) + 1) * 0.04e0 AS n FROM supplier"""),
    "district_edges": (("districts",), """
        SELECT district_id, name, w AS x1, s AS y1, e AS x2, s AS y2 FROM districts
        UNION ALL SELECT district_id, name, e, s, e, m FROM districts
        UNION ALL SELECT district_id, name, e, m, (w + e) / 2, n FROM districts
        UNION ALL SELECT district_id, name, (w + e) / 2, n, w, m FROM districts
        UNION ALL SELECT district_id, name, w, m, w, s FROM districts"""),
    "assessments": ((), """
        SELECT l_suppkey AS district_id, CASE WHEN l_returnflag = 'A' THEN 'summer' ELSE 'winter' END AS season,
        CAST(l_partkey % 5 AS INT) AS label,
        CAST(CASE WHEN l_linenumber % 3 = 0 THEN (l_partkey + CAST(l_quantity AS BIGINT)) % 5 ELSE l_partkey % 5 END AS INT) AS rf,
        CAST(CASE WHEN l_linenumber % 4 = 0 THEN (l_partkey + CAST(l_quantity AS BIGINT)) % 5 ELSE l_partkey % 5 END AS INT) AS gtb
        FROM lineitem"""),
    "mapped": (("assessments",), """
        SELECT l_suppkey AS district_id,
        CAST(CASE WHEN l_linenumber % 3 = 0 THEN (l_partkey + CAST(l_quantity AS BIGINT)) % 5 ELSE l_partkey % 5 END AS INT) AS mapped_class,
        sum(l_quantity) AS area FROM lineitem GROUP BY ALL"""),
    "public_maps": ((), """
        SELECT p_partkey AS pixel_id, CAST(p_size % 5 AS INT) AS map_a,
        CAST(CASE WHEN p_partkey % 3 = 0 THEN (p_size + 1) % 5 ELSE p_size % 5 END AS INT) AS map_b,
        CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN CAST((p_size + 2) % 5 AS INT)
        ELSE CAST(p_size % 5 AS INT) END AS map_c FROM part"""),
    "requests": ((), """
        SELECT c_custkey AS request_id, CASE c_custkey % 8 WHEN 0 THEN 'RF' WHEN 1 THEN 'svm' WHEN 2 THEN 'XGB' WHEN 3 THEN 'gtb'
        WHEN 4 THEN 'Cart' WHEN 5 THEN 'KNN' WHEN 6 THEN 'xgb' ELSE 'lightgbm' END AS model,
        concat('1996-0', CAST(c_nationkey % 9 + 1 AS VARCHAR), '-01') AS start_day,
        concat('1997-0', CAST(c_nationkey % 9 + 1 AS VARCHAR), '-01') AS end_day, c_custkey % 50 + 1 AS cloud,
        c_custkey % 2 = 0 AS smoothing, c_custkey % 3 = 0 AS fallback FROM customer"""),
    "classes": ((), """
        SELECT * FROM (VALUES (0, 'Vegetation', '#006400', 'Trees, forest, plantations & other green cover'),
        (1, 'Water', '#0000FF', 'Lakes, rivers, ponds & water bodies'),
        (2, 'Built Area', '#FF0000', 'Built-up structures, concrete & urban infrastructure'),
        (3, 'Open Land', '#D2B48C', 'Bare rock, exposed soil & unvegetated open ground'),
        (4, 'Agriculture', '#90EE90', 'Cultivated fields, seasonal crops & fallow agricultural land'))
        AS c(class_id, name, color, description)"""),
    # ---- selections and composites ----
    "optical_scenes": (("scenes",), """
        SELECT * FROM scenes WHERE sensor = 'S2' AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1999-01-01' AND cloud_pct < 15"""),
    "dual_radar": (("scenes",), """
        SELECT * FROM scenes WHERE sensor = 'S1' AND instrument_mode = 'IW' AND orbit_pass = 'DESCENDING' AND dual"""),
    "radar_scenes": (("dual_radar",), """
        SELECT * FROM dual_radar WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1999-01-01'"""),
    "optical_pixels": (("observations", "optical_scenes"), """
        SELECT scene_id, x, y, """ + ", ".join(
        f"CASE WHEN QA60 & 1024 = 0 AND QA60 & 2048 = 0 THEN {b} / 10000 END AS {b}" for b in ("B2", "B3", "B4", "B8", "B11", "B12")
    ) + " FROM observations SEMI JOIN optical_scenes USING (scene_id)"),
    "composite": (("optical_pixels",), "SELECT x, y, " + ", ".join(
        f"median({b}) AS {b}" for b in ("B2", "B3", "B4", "B8", "B11", "B12")) + " FROM optical_pixels GROUP BY x, y"),
    "radar_composite": (("observations", "radar_scenes"), """
        SELECT x, y, median(VV) AS VV, median(VH) AS VH FROM observations SEMI JOIN radar_scenes USING (scene_id) GROUP BY x, y"""),
    # every optical scene, cloudy or not: a composite dense enough for neighbourhoods
    "dense": (("observations", "scenes"), "SELECT x, y, " + ", ".join(
        f"median(CASE WHEN QA60 & 1024 = 0 AND QA60 & 2048 = 0 THEN {b} / 10000 END) AS {b}" for b in ("B2", "B3", "B4", "B8", "B11", "B12"))
        + " FROM observations SEMI JOIN (SELECT scene_id FROM scenes WHERE sensor = 'S2') USING (scene_id) GROUP BY x, y"),
    "dense_radar": (("observations", "scenes"), """
        SELECT x, y, median(VV) AS VV, median(VH) AS VH FROM observations
        SEMI JOIN (SELECT scene_id FROM scenes WHERE sensor = 'S1') USING (scene_id) GROUP BY x, y"""),
    "indices": (("composite",), "SELECT *, {indices} FROM composite"),
    "dense_indices": (("dense",), "SELECT *, {indices} FROM dense"),
}


def unit(value: str, low: float, high: float) -> str:
    return f"CASE WHEN ({value}) IS NOT NULL THEN least(greatest((({value}) - ({low}e0)) / ({high}e0 - ({low}e0)), 0e0), 1e0) END"


def nd(a: str, b: str) -> str:
    return f"({a} - {b}) / nullif({a} + {b}, 0)"


_T1 = "2 * B11 / nullif(B11 + B8, 0)"
_T2 = "(B8 / nullif(B8 + B4, 0) + B3 / nullif(B3 + B11, 0))"
INDEX_SQL = {
    "NDVI": nd("B8", "B4"), "NDWI": nd("B3", "B8"), "NDBI": nd("B11", "B8"),
    "SAVI": "1.5e0 * (B8 - B4) / nullif(B8 + B4 + 0.5e0, 0)",
    "BSI": "((B11 + B4) - (B8 + B2)) / nullif(B11 + B4 + B8 + B2, 0)",
    "UI": nd("B12", "B8"), "IBI": f"({_T1} - {_T2}) / nullif({_T1} + {_T2}, 0)",
    "SWIRratio": unit("B11 / nullif(B12 + 1e-6, 0)", 0.0, 2.5),
    "BAEI": unit("(B4 + 0.3e0) / nullif(B3 + B11 + 1e-6, 0)", 0.0, 9.0),
}
_INDICES = ", ".join(f"{e} AS {n}" for n, e in INDEX_SQL.items())
for _name in ("indices", "dense_indices"):
    VIEWS[_name] = (VIEWS[_name][0], VIEWS[_name][1].replace("{indices}", _INDICES))

_GREY = {
    "g": ("dense", f"CAST(trunc({unit('B8', 0.0, 0.5)} * 31) AS INT)"),
    "s": ("dense_radar", f"CAST(trunc({unit('VV', -25.0, 5.0)} * 31) AS INT)"),
}
_PAIRS = [
    (d, i + 1, j + 1) for d, pairs in {
        0: [(0, 1), (1, 2), (3, 4), (4, 5), (6, 7), (7, 8)], 90: [(0, 3), (3, 6), (1, 4), (4, 7), (2, 5), (5, 8)],
        45: [(3, 1), (4, 2), (6, 4), (7, 5)], 135: [(0, 4), (1, 5), (3, 7), (4, 8)],
    }.items() for i, j in pairs
]
for _p, (_source, _expr) in _GREY.items():
    VIEWS[f"grey_{_p}"] = ((_source,), f"SELECT x, y, {_expr} AS v FROM {_source}")
    VIEWS[f"windows_{_p}"] = ((f"grey_{_p}",), f"""
        SELECT c.x, c.y, list(n.v ORDER BY n.y, n.x) AS a FROM grey_{_p} c
        JOIN grey_{_p} n ON n.x BETWEEN c.x - 1 AND c.x + 1 AND n.y BETWEEN c.y - 1 AND c.y + 1
        WHERE n.v IS NOT NULL GROUP BY c.x, c.y HAVING count(*) = 9""")
    VIEWS[f"entries_{_p}"] = ((f"windows_{_p}",), f"""
        SELECT x, y, d, i, j, sum(w) / sum(sum(w)) OVER (PARTITION BY x, y, d) AS p FROM (
        SELECT x, y, d, a[f] AS i, a[t] AS j, 1e0 AS w FROM windows_{_p}, (VALUES {", ".join(map(str, _PAIRS))}) AS pr(d, f, t)
        UNION ALL
        SELECT x, y, d, a[t] AS i, a[f] AS j, 1e0 AS w FROM windows_{_p}, (VALUES {", ".join(map(str, _PAIRS))}) AS pr(d, f, t)
        ) z GROUP BY x, y, d, i, j""")
    VIEWS[f"texture_{_p}"] = ((f"entries_{_p}",), f"""
        SELECT x, y, avg(contrast) AS {_p}_contrast, avg(ent) AS {_p}_ent, avg(var) AS {_p}_var, avg(idm) AS {_p}_idm,
        avg(diss) AS {_p}_diss, avg(asm) AS {_p}_asm FROM (
        SELECT x, y, d, sum(p * (i - j) * (i - j)) AS contrast, -sum(p * ln(p)) AS ent,
        sum(p * i * i) - sum(p * i) * sum(p * i) AS var, sum(p / (1 + (i - j) * (i - j))) AS idm,
        sum(p * abs(i - j)) AS diss, sum(p * p) AS asm FROM entries_{_p} GROUP BY x, y, d) f GROUP BY x, y""")


VIEWS["raw_bands"] = (("texture_g", "texture_s"), """
    SELECT g_contrast, g_ent, g_var, g_diss, NULL AS s_contrast, NULL AS s_var, NULL AS s_ent FROM texture_g
    UNION ALL SELECT NULL, NULL, NULL, NULL, s_contrast, s_var, s_ent FROM texture_s""")


def with_views(names: tuple[str, ...], body: str) -> str:
    """``body`` behind a WITH clause holding the named views and all they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    views = ", ".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in ordered)
    return f"WITH {views} {body.strip()}" if views else body.strip()


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = with_views(views, sql)
        return fn

    return add


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Float columns to a fixed number of digits; zero loses its sign."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def round_sql(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0e0 AS {c}" for c in columns)


def archive(spark: SparkSession, sf_dir: str) -> Archive:
    return Archive(
        fx.scenes(spark, sf_dir), fx.observations(spark, sf_dir), (fx.ORIGIN_LON, fx.ORIGIN_LAT), fx.PIXEL_DEG, fx.FALLBACK, fx.TILE
    )


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")
