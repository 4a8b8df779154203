"""Uploaded areas, grids, tiles, keys, dimensions and polygon joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from landsift import fixtures as fx
from landsift import schema as S
from landsift.catalog.base import VIEWS, query, round_sql, rounded
from landsift.functions import geo
from landsift.functions import keys as K
from landsift.operators import grid, quality, regions
from landsift.sources import tables

_POSITION = r"\[\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*,\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
VIEWS["parsed"] = (("geojson",), f"""
    SELECT aoi_id, geometry, json_extract_string(geometry, '$.type') AS kind,
    CAST(regexp_extract_all(CAST(json_extract(geometry, '$.coordinates') AS VARCHAR), '{_POSITION}', 1) AS DOUBLE[]) AS lons,
    CAST(regexp_extract_all(CAST(json_extract(geometry, '$.coordinates') AS VARCHAR), '{_POSITION}', 2) AS DOUBLE[]) AS lats
    FROM (SELECT aoi_id, CASE WHEN json_extract_string(g, '$.type') IN ('Polygon', 'MultiPolygon') THEN g END AS geometry FROM (
    SELECT aoi_id, CASE json_extract_string(document, '$.type')
    WHEN 'FeatureCollection' THEN list_filter(json_extract(document, '$.features[*].geometry'),
    lambda f: json_extract_string(f, '$.type') IN ('Polygon', 'MultiPolygon'))[1]
    WHEN 'Feature' THEN json_extract(document, '$.geometry') ELSE CAST(document AS JSON) END AS g FROM geojson) a) b""")
VIEWS["aoi_boxes"] = (("parsed",), """
    SELECT aoi_id, list_min(lons) AS west, list_min(lats) AS south, list_max(lons) AS east, list_max(lats) AS north
    FROM parsed WHERE geometry IS NOT NULL""")
_R = "6378137e0"
VIEWS["grids"] = (("aoi_boxes",), f"""
    SELECT aoi_id, west, north, merc_scale, x0, y1, width, height, degrees((x0 + width * merc_scale) / {_R}) AS east,
    degrees(2 * atan(exp((y1 - height * merc_scale) / {_R})) - pi() / 2) AS south FROM (
    SELECT *, greatest(1, CAST(round((x1 - x0) / merc_scale) AS INT)) AS width, greatest(1, CAST(round((y1 - y0) / merc_scale) AS INT)) AS height
    FROM (SELECT *, 10e0 / cos(radians((north + south) / 2)) AS merc_scale, radians(west) * {_R} AS x0, radians(east) * {_R} AS x1,
    ln(tan(pi() / 4 + radians(south) / 2)) * {_R} AS y0, ln(tan(pi() / 4 + radians(north) / 2)) * {_R} AS y1 FROM aoi_boxes) a) b""")
VIEWS["tiles"] = (("grids",), f"""
    SELECT *, tile_west - pad_x AS pad_west, tile_east + pad_x AS pad_east, tile_south - pad_y AS pad_south, tile_north + pad_y AS pad_north
    FROM (SELECT *, (tile_east - tile_west) * 24 / greatest(1, "right" - "left") AS pad_x,
    (tile_north - tile_south) * 24 / greatest(1, bottom - top) AS pad_y FROM (
    SELECT *, degrees((x0 + "left" * merc_scale) / {_R}) AS tile_west, degrees((x0 + "right" * merc_scale) / {_R}) AS tile_east,
    degrees(2 * atan(exp((y1 - bottom * merc_scale) / {_R})) - pi() / 2) AS tile_south,
    degrees(2 * atan(exp((y1 - top * merc_scale) / {_R})) - pi() / 2) AS tile_north FROM (
    SELECT *, least("left" + 1792, width) AS "right", least(top + 1792, height) AS bottom FROM (
    SELECT *, unnest(range(0, width, 1792)) AS "left" FROM (SELECT *, unnest(range(0, height, 1792)) AS top FROM grids) a) b) c) d) e""")
VIEWS["located"] = (("points", "district_edges"), """
    SELECT p.point_id, p.x, p.y, e.district_id, e.name FROM points p JOIN (SELECT *, min(x1) OVER w AS west, max(x1) OVER w AS east,
    min(y1) OVER w AS south, max(y1) OVER w AS north FROM district_edges WINDOW w AS (PARTITION BY district_id)) e
    ON p.lon BETWEEN e.west AND e.east AND p.lat BETWEEN e.south AND e.north GROUP BY p.point_id, p.x, p.y, e.district_id, e.name
    HAVING sum(CAST(((e.y1 > p.lat) <> (e.y2 > p.lat)) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1 AS INT)) % 2 = 1""")
_BOX = ["west", "south", "east", "north"]


def _areas(spark, d):
    return tables.areas_of_interest(fx.documents_geojson(spark, d))


def _grids(spark, d):
    return grid.render_grid(tables.boxes(_areas(spark, d), "aoi_id"))


@query("uploaded_areas", """
    SELECT aoi_id, geometry IS NOT NULL AS accepted, kind, CASE WHEN geometry IS NOT NULL THEN len(lons) END AS points,
    round(list_min(lons), 6) AS west, round(list_min(lats), 6) AS south, round(list_max(lons), 6) AS east, round(list_max(lats), 6) AS north
    FROM parsed""", ("parsed",))
def uploaded_areas(spark, d):
    areas = _areas(spark, d).select("aoi_id", "accepted", "kind", "points", *[F.col("box")[b].alias(b) for b in _BOX])
    return rounded(areas, _BOX)


@query("area_positions", """
    SELECT aoi_id, CAST(i - 1 AS INT) AS pos, lons[i] AS lon, lats[i] AS lat FROM (
    SELECT *, unnest(range(1, len(lons) + 1)) AS i FROM parsed WHERE geometry IS NOT NULL) u""", ("parsed",))
def area_positions(spark, d):
    return tables.coordinate_rows(_areas(spark, d), "aoi_id")


@query("render_grids", f"""
    SELECT aoi_id, width, height, {round_sql(["merc_scale", "x0", "y1"], 3)}, {round_sql(_BOX)} FROM grids""", ("grids",))
def render_grids(spark, d):
    grids = _grids(spark, d).select("aoi_id", "width", "height", "merc_scale", "x0", "y1", *_BOX)
    return rounded(rounded(grids, ["merc_scale", "x0", "y1"], 3), _BOX)


_TILE_EDGES = [f"{p}_{s}" for p in ("tile", "pad") for s in _BOX]


@query("tile_boxes", f"""
    SELECT aoi_id, "left", top, "right", bottom, {round_sql(_TILE_EDGES)} FROM tiles""", ("tiles",))
def tile_boxes(spark, d):
    tiles = grid.tile_boxes(_grids(spark, d))
    return rounded(tiles.select("aoi_id", "left", "top", "right", "bottom", *_TILE_EDGES), _TILE_EDGES)


@query("tile_invariants", """
    SELECT aoi_id, count(*) AS tiles, CAST(sum(("right" - "left") * (bottom - top)) AS BIGINT) AS tile_pixels,
    CAST(max(CAST(width AS BIGINT) * height) AS BIGINT) AS grid_pixels, max("right") = max(width) AS reaches_right,
    max(bottom) = max(height) AS reaches_bottom, count(DISTINCT ("left", top)) AS corners,
    sum(("right" - "left") * (bottom - top)) = max(CAST(width AS BIGINT) * height) AS exact FROM tiles GROUP BY aoi_id""", ("tiles",))
def tile_invariants(spark, d):
    return grid.tile_invariants(grid.tile_boxes(_grids(spark, d), by=["aoi_id"]), "aoi_id")


@query("preview_sizes", """
    SELECT aoi_id, round(w, 3) AS width_m, greatest(256, least(2048, CAST(trunc(w / 10) AS INT))) AS px FROM (
    SELECT aoi_id, (east - west) * 111320e0 * cos(radians((north + south) / 2)) AS w FROM aoi_boxes) a""", ("aoi_boxes",))
def preview_sizes(spark, d):
    boxes = tables.boxes(_areas(spark, d), "aoi_id")
    width = geo.ground_width_m(*[F.col(c) for c in ("west", "east", "south", "north")])
    sized = boxes.select("aoi_id", width.alias("width_m")).withColumn("px", geo.preview_pixels(F.col("width_m")))
    return rounded(sized, ["width_m"], 3)


@query("mercator_points", """
    SELECT point_id, round(radians(lon) * 6378137e0, 3) AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137e0, 3) AS my,
    round(lon, 6) AS lon, round(lat, 6) AS lat FROM points""", ("points",))
def mercator_points(spark, d):
    p = fx.points(spark, d).select("point_id", geo.mercator_x(F.col("lon")).alias("mx"), geo.mercator_y(F.col("lat")).alias("my"))
    back = p.withColumns({"lon": geo.inverse_mercator_x(F.col("mx")), "lat": geo.inverse_mercator_y(F.col("my"))})
    return rounded(rounded(back, ["mx", "my"], 3), ["lon", "lat"])


# ---- keys and dimensions ----

@query("overlay_keys", """
    SELECT aoi_id, substr(sha1(CAST(to_json({'cloud': cloud, 'end': end_day, 'geometry': document, 'model': lower(model),
    'schema': 'five-class-19-band-v5-drop-summer', 'smoothing': smoothing, 'start': start_day}) AS VARCHAR)), 1, 16) AS overlay_key
    FROM geojson JOIN requests ON aoi_id = request_id""", ("geojson", "requests"))
def overlay_keys(spark, d):
    asked = fx.documents_geojson(spark, d).join(fx.requests(spark, d).withColumnRenamed("request_id", "aoi_id"), "aoi_id")
    columns = [F.col(c) for c in ("document", "model", "start", "end", "cloud", "smoothing")]
    return asked.select("aoi_id", K.overlay_key(*columns).alias("overlay_key"))


@query("model_keys", """
    SELECT CASE lower(model) WHEN 'xgb' THEN 'gtb' ELSE lower(model) END AS model, start_day, end_day, cloud, fallback,
    'five-class-19-band-v5-drop-summer' AS schema_version, count(*) AS requests FROM requests GROUP BY ALL""", ("requests",))
def model_keys(spark, d):
    columns = [F.col(c) for c in ("model", "start", "end", "cloud", "fallback")]
    keyed = fx.requests(spark, d).groupBy(K.model_key(*columns).alias("k")).agg(F.count("*").alias("requests"))
    return keyed.select(
        "k.model", F.col("k.start").alias("start_day"), F.col("k.end").alias("end_day"), "k.cloud", "k.fallback", "k.schema_version", "requests")


@query("rejected_models", """
    SELECT request_id, model FROM requests WHERE lower(model) NOT IN ('rf', 'svm', 'gtb', 'xgb', 'cart', 'knn')""", ("requests",))
def rejected_models(spark, d):
    asked = fx.requests(spark, d).withColumn("model_id", K.normalised_model(F.col("model")))
    return asked.join(S.model_table(spark), "model_id", "left_anti").select("request_id", "model")


@query("model_benchmarks", """
    SELECT request_id, m.model_id, m.model_name, round(m.winter, 6) AS winter_pct, round(m.summer, 6) AS summer_pct FROM requests r JOIN (VALUES
    ('rf', 'Random Forest', 86.44827586206897e0, 71.84249628528974e0), ('svm', 'Support Vector Machine (SVM)', 86.37931034482759e0, 68.61069836552748e0),
    ('gtb', 'Smile Gradient Tree Boosting (GTB)', 87.41379310344828e0, 73.84843982169392e0),
    ('cart', 'Decision Tree (CART)', 80.55172413793103e0, 61.32986627043091e0),
    ('knn', 'K-Nearest Neighbors (KNN)', 85.27586206896551e0, 69.65081723625556e0)) AS m(model_id, model_name, winter, summer)
    ON m.model_id = CASE lower(r.model) WHEN 'xgb' THEN 'gtb' ELSE lower(r.model) END""", ("requests",))
def model_benchmarks(spark, d):
    asked = fx.requests(spark, d).select("request_id", K.normalised_model(F.col("model")).alias("model_id"))
    joined = asked.join(S.model_table(spark), "model_id")
    return rounded(joined.select("request_id", "model_id", "model_name", "winter_pct", "summer_pct"), ["winter_pct", "summer_pct"])


@query("request_windows", """
    SELECT request_id, date_diff('day', CAST(start_day AS DATE), CAST(end_day AS DATE)) AS days,
    date_diff('day', CAST(start_day AS DATE), CAST(end_day AS DATE)) = 365 AS ok FROM requests""", ("requests",))
def request_windows(spark, d):
    windows = fx.requests(spark, d).select(
        "request_id", F.col("start").cast("date").alias("start_date"), F.col("end").cast("date").alias("end_date"))
    return quality.window_check(windows, 365).select("request_id", "days", "ok")


@query("display_names", """
    SELECT CASE source WHEN 'forest' THEN 'Vegetation' WHEN 'buildings' THEN 'Built Area' WHEN 'barren' THEN 'Open Land'
    WHEN 'water' THEN 'Water' ELSE 'Agriculture' END AS name, count(*) AS n FROM points GROUP BY 1""", ("points",))
def display_names(spark, d):
    old = F.when(F.col("source") == "barren", "Barren Land").otherwise(F.initcap("source"))
    return fx.points(spark, d).groupBy(K.display_name(old).alias("name")).agg(F.count("*").alias("n"))


@query("class_colours", """
    SELECT c.class_id, CAST(concat('0x', substr(color, 2, 2)) AS INT) AS red, CAST(concat('0x', substr(color, 4, 2)) AS INT) AS green,
    CAST(concat('0x', substr(color, 6, 2)) AS INT) AS blue, count(*) AS n FROM class_map m JOIN classes c ON m.classification = c.class_id GROUP BY ALL""",
    ("class_map", "classes"))
def class_colours(spark, d):
    counts = fx.class_map(spark, d).groupBy(F.col("classification").alias("class_id")).agg(F.count("*").alias("n"))
    palette = S.class_table(spark).select("class_id", *[c.alias(n) for n, c in K.rgb(F.col("color")).items()])
    return counts.join(palette, "class_id").select("class_id", "red", "green", "blue", "n")


# ---- polygons ----

@query("points_in_districts", "SELECT point_id, district_id FROM located", ("located",))
def points_in_districts(spark, d):
    return regions.locate(fx.points(spark, d), fx.districts(spark, d), ["district_id"]).select("point_id", "district_id")


@query("points_in_named_district", "SELECT point_id, x, y FROM located WHERE name = 'Supplier#000000007'", ("located",))
def points_in_named_district(spark, d):
    boundary = regions.named_boundary(fx.districts(spark, d), "Supplier#000000007")
    return regions.locate(fx.points(spark, d), boundary, ["district_id"]).select("point_id", "x", "y")
