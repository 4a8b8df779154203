"""Scenes, composites, indices, texture, smoothing and areas."""

from __future__ import annotations

import math
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landsift import fixtures as fx
from landsift import schema as S
from landsift.catalog.base import INDEX_SQL, day, query, round_sql, rounded, unit
from landsift.functions import spectral as X
from landsift.operators import areas, grid, pyramid, quality, regions
from landsift.operators import composite as C
from landsift.operators import neighborhood as N
from landsift.session import shared_folder
from landsift.sources import scenes as SC
from landsift.sources import sinks, store

INDICES = list(INDEX_SQL)
ALL_SCENES = ("1990-01-01", "2030-01-01")


def _optical(spark, d) -> DataFrame:
    return SC.optical_pixels(fx.observations(spark, d), SC.optical_scenes(fx.scenes(spark, d), *fx.WINDOW))


def _radar(spark, d) -> DataFrame:
    return SC.radar_pixels(fx.observations(spark, d), SC.radar_scenes(fx.scenes(spark, d), *fx.WINDOW))


def _dense(spark, d) -> DataFrame:
    return SC.optical_pixels(fx.observations(spark, d), SC.optical_scenes(fx.scenes(spark, d), *ALL_SCENES, cloud=101))


def _dense_radar(spark, d) -> DataFrame:
    return SC.radar_pixels(fx.observations(spark, d), fx.scenes(spark, d).filter("sensor = 'S1'"))


# ---- scenes ----

@query("optical_scenes", "SELECT scene_id, cloud_pct, strftime(ts, '%Y-%m-%d') AS taken FROM optical_scenes", ("optical_scenes",))
def optical_scenes(spark, d):
    return SC.optical_scenes(fx.scenes(spark, d), *fx.WINDOW).select("scene_id", "cloud_pct", day("ts").alias("taken"))


@query("radar_scenes", "SELECT scene_id, strftime(ts, '%Y-%m-%d') AS taken FROM radar_scenes", ("radar_scenes",))
def radar_scenes(spark, d):
    return SC.radar_scenes(fx.scenes(spark, d), *fx.WINDOW).select("scene_id", day("ts").alias("taken"))


@query("scene_count_by_threshold", """
    SELECT t.cloud_cover, count(s.scene_id) AS image_count FROM (VALUES (5), (10), (15), (20), (30), (50)) AS t(cloud_cover)
    LEFT JOIN (SELECT * FROM scenes WHERE sensor = 'S2' AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1999-01-01') s
    ON s.cloud_pct < t.cloud_cover GROUP BY t.cloud_cover""", ("scenes",))
def scene_count_by_threshold(spark, d):
    scenes = SC.optical_scenes(fx.scenes(spark, d), *fx.WINDOW, cloud=max(S.SWEEP_CLOUDS))
    counts = scenes.agg(*[F.count_if(F.col("cloud_pct") < c).alias(f"c{c}") for c in S.SWEEP_CLOUDS])
    rows = F.array(*[F.struct(F.lit(c).alias("cloud_cover"), F.col(f"c{c}").alias("image_count")) for c in S.SWEEP_CLOUDS])
    return counts.select(F.inline(rows))


@query("optical_fallback", """
    SELECT scene_id, cloud_pct FROM scenes WHERE sensor = 'S2' AND ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '2002-01-01'
    AND cloud_pct < 30 AND NOT EXISTS (SELECT 1 FROM scenes WHERE sensor = 'S2' AND ts >= TIMESTAMP '1980-01-01'
    AND ts < TIMESTAMP '1981-01-01' AND cloud_pct < 15)""", ("scenes",))
def optical_fallback(spark, d):
    scenes = SC.optical_scenes(fx.scenes(spark, d), *fx.EMPTY_WINDOW, allow_fallback=True, fallback_window=fx.FALLBACK)
    return scenes.select("scene_id", "cloud_pct")


_PLACED = """(SELECT *, 79e0 + (scene_id % 10) * 0.1e0 AS west, 79.1e0 + (scene_id % 10) * 0.1e0 AS east, 22.8e0 AS south, 23.2e0 AS north FROM scenes
    WHERE scene_id % 10 <> 3 OR ts >= TIMESTAMP '1996-02-01')"""


def _areas_sql(name: str, box: tuple[float, float, float, float]) -> str:
    west, south, east, north = box
    touching = f"SELECT * FROM {_PLACED} p WHERE sensor = 'S2' AND west <= {east}e0 AND east >= {west}e0 AND south <= {north}e0 AND north >= {south}e0"
    wanted = "ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1996-02-01' AND cloud_pct < 15"
    spare = "ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '2002-01-01' AND cloud_pct < 30"
    return f"""SELECT '{name}' AS area, scene_id FROM ({touching}) a WHERE {wanted} OR ({spare} AND NOT EXISTS (SELECT 1 FROM ({touching}) b WHERE {wanted}))"""


_FAR_AREAS = {"seen": (79.0, 22.8, 79.95, 23.1), "unseen": (79.33, 22.9, 79.37, 23.0)}


@query("fallback_by_area", " UNION ALL ".join(_areas_sql(n, b) for n, b in _FAR_AREAS.items()), ("scenes",))
def fallback_by_area(spark, d):
    """Two areas under one request: one has scenes of its own, the other falls back, whatever the first has."""
    column = F.col("scene_id") % 10
    placed = fx.scenes(spark, d).withColumns({
        "west": 79.0 + column * 0.1, "east": 79.1 + column * 0.1, "south": F.lit(22.8), "north": F.lit(23.2)})
    placed = placed.filter((column != 3) | (F.col("ts") >= F.lit("1996-02-01").cast("timestamp")))
    found = [SC.optical_scenes(SC.within(placed, box), "1996-01-01", "1996-02-01", allow_fallback=True, fallback_window=fx.FALLBACK)
             .select(F.lit(name).alias("area"), "scene_id") for name, box in _FAR_AREAS.items()]
    return found[0].union(found[1])


def _many_vertices() -> list[list[tuple[float, float]]]:
    """A star of 5,000 corners around the middle of the grid, with a hole of 1,000."""
    def ring(n: int, radius: float) -> list[tuple[float, float]]:
        return [(79.5 + radius * (1 + (k * 7919 % 101) / 250) * math.cos(2 * math.pi * k / n),
                 22.84 + radius * (1 + (k * 7919 % 101) / 250) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [ring(5000, 0.3), ring(1000, 0.1)]


_VERTEX_ROWS = ", ".join(
    f"({x1!r}e0, {y1!r}e0, {x2!r}e0, {y2!r}e0)" for r in _many_vertices() for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]]))


@query("clip_many_vertices", f"""
    SELECT x, y FROM (SELECT DISTINCT x, y, 79e0 + x * 0.02e0 + 0.01e0 AS lon, 22.8e0 + y * 0.02e0 + 0.01e0 AS lat FROM observations) c,
    (VALUES {_VERTEX_ROWS}) e(x1, y1, x2, y2)
    GROUP BY x, y HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1""", ("observations",))
def clip_many_vertices(spark, d):
    cells = fx.with_lonlat(fx.observations(spark, d).select("x", "y").distinct())
    return regions.clip(cells, _many_vertices()).select("x", "y")


@query("optical_fallback_not_needed", "SELECT scene_id, cloud_pct FROM optical_scenes", ("optical_scenes",))
def optical_fallback_not_needed(spark, d):
    scenes = SC.optical_scenes(fx.scenes(spark, d), *fx.WINDOW, allow_fallback=True, fallback_window=fx.FALLBACK)
    return scenes.select("scene_id", "cloud_pct")


@query("radar_fallback", """
    SELECT scene_id FROM dual_radar WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '2002-01-01'""", ("dual_radar",))
def radar_fallback(spark, d):
    scenes = SC.radar_scenes(fx.scenes(spark, d), *fx.EMPTY_WINDOW, allow_fallback=True, fallback_window=fx.FALLBACK)
    return scenes.select("scene_id")


@query("scenes_touching_area", """
    SELECT scene_id FROM optical_scenes SEMI JOIN (SELECT scene_id FROM (
    SELECT scene_id, 79e0 + x * 0.02e0 + 0.01e0 AS lon, 22.8e0 + y * 0.02e0 + 0.01e0 AS lat FROM observations) o
    GROUP BY scene_id HAVING min(lon) <= 79.9e0 AND max(lon) >= 79.1e0 AND min(lat) <= 23.5e0 AND max(lat) >= 22.85e0) f
    USING (scene_id)""", ("optical_scenes", "observations"))
def scenes_touching_area(spark, d):
    footprints = SC.scene_footprints(fx.with_lonlat(fx.observations(spark, d).select("scene_id", "x", "y")))
    scenes = SC.optical_scenes(fx.scenes(spark, d), *fx.WINDOW)
    return SC.touching(scenes, footprints, (79.1, 22.85, 79.9, 23.5)).select("scene_id")


@query("clear_observations", """
    SELECT scene_id, count(*) AS pixels, count(B4) AS clear, round(sum(B4), 6) + 0e0 AS red_sum FROM optical_pixels GROUP BY scene_id""",
    ("optical_pixels",))
def clear_observations(spark, d):
    per = _optical(spark, d).groupBy("scene_id").agg(
        F.count("*").alias("pixels"), F.count("B4").alias("clear"), F.sum("B4").alias("red_sum"))
    return rounded(per, ["red_sum"])


# ---- composites ----

@query("ndvi_composite", f"""
    SELECT x, y, round({INDEX_SQL["NDVI"]}, 6) + 0e0 AS ndvi FROM composite""", ("composite",))
def ndvi_composite(spark, d):
    pixels = SC.optical_pixels(
        fx.observations(spark, d), SC.optical_scenes(fx.scenes(spark, d), *fx.WINDOW), ["B4", "B8"])
    image = C.median_composite(pixels, ["B4", "B8"])
    return rounded(image.select("x", "y", X.normalized_difference("B8", "B4").alias("ndvi")), ["ndvi"])


@query("median_composite", f"SELECT x, y, {round_sql(S.OPTICAL_BANDS)} FROM composite", ("composite",))
def median_composite(spark, d):
    return rounded(C.median_composite(_optical(spark, d), S.OPTICAL_BANDS), S.OPTICAL_BANDS)


@query("spectral_indices", f"SELECT x, y, {round_sql(INDICES)} FROM indices", ("indices",))
def spectral_indices(spark, d):
    image = X.add_bands(C.median_composite(_optical(spark, d), S.OPTICAL_BANDS), X.spectral_indices())
    return rounded(image.select("x", "y", *INDICES), INDICES)


@query("expression_band", f"SELECT x, y, round({INDEX_SQL['SAVI']}, 6) + 0e0 AS savi FROM composite", ("composite",))
def expression_band(spark, d):
    image = C.median_composite(_optical(spark, d).select("x", "y", "B4", "B8"), ["B4", "B8"])
    image = X.add_expression(image, "savi", "1.5D * (NIR - RED) / (NIR + RED + 0.5D)", {"NIR": "B8", "RED": "B4"})
    return rounded(image.select("x", "y", "savi"), ["savi"])


_RADAR_SQL = {
    "VV": unit("VV", -25.0, 5.0), "VH": unit("VH", -30.0, 0.0), "VVVH": unit("VV - VH", -5.0, 20.0)
}


@query("radar_composite", "SELECT x, y, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _RADAR_SQL.items())
       + " FROM radar_composite", ("radar_composite",))
def radar_composite(spark, d):
    image = X.add_bands(C.median_composite(_radar(spark, d), S.RADAR_BANDS), X.radar_bands())
    return rounded(image.select("x", "y", *_RADAR_SQL), list(_RADAR_SQL))


@query("optical_radar_stack", f"""
    SELECT x, y, {round_sql([*S.OPTICAL_BANDS, *S.RADAR_BANDS])} FROM composite LEFT JOIN radar_composite USING (x, y)""",
    ("composite", "radar_composite"))
def optical_radar_stack(spark, d):
    bands = [*S.OPTICAL_BANDS, *S.RADAR_BANDS]
    stack = C.stacked_composite(_optical(spark, d), _radar(spark, d), size=fx.TILE)
    return rounded(N.own_cells(stack, fx.TILE).select("x", "y", *bands), bands)


@query("joined_composites", f"""
    SELECT x, y, {round_sql(["B8", *S.RADAR_BANDS])} FROM composite LEFT JOIN radar_composite USING (x, y)""",
    ("composite", "radar_composite"))
def joined_composites(spark, d):
    optical = C.median_composite(_optical(spark, d), ["B8"])
    return rounded(C.join_composites(optical, C.median_composite(_radar(spark, d), S.RADAR_BANDS)), ["B8", *S.RADAR_BANDS])


@query("masked_radar_stand_in", """
    SELECT x, y, round(B8, 6) AS B8, CAST(NULL AS DOUBLE) AS VV, CAST(NULL AS DOUBLE) AS VH FROM composite""", ("composite",))
def masked_radar_stand_in(spark, d):
    empty = SC.radar_pixels(fx.observations(spark, d), SC.radar_scenes(fx.scenes(spark, d), *fx.EMPTY_WINDOW))
    stack = N.own_cells(C.stacked_composite(_optical(spark, d), empty, size=fx.TILE), fx.TILE)
    return rounded(stack.select("x", "y", "B8", "VV", "VH"), ["B8", "VV", "VH"])


@query("constant_image", """
    SELECT DISTINCT x, y, 0e0 AS B4, 1e0 AS B8, CAST(NULL AS DOUBLE) AS VV FROM observations""", ("observations",))
def constant_image(spark, d):
    cells = fx.observations(spark, d).select("x", "y").distinct()
    return cells.select("x", "y", *[c.alias(n) for n, c in X.constant_bands({"B4": 0.0, "B8": 1.0, "VV": None}).items()])


@query("true_colour", "SELECT x, y, " + ", ".join(
    f"CAST(trunc({unit(b, 0.0, 0.3)} * 255) AS INT) AS {n}" for n, b in (("red", "B4"), ("green", "B3"), ("blue", "B2")))
    + " FROM composite", ("composite",))
def true_colour(spark, d):
    image = C.median_composite(_optical(spark, d), ["B2", "B3", "B4"])
    return image.select("x", "y", *[c.alias(n) for n, c in X.true_colour().items()])


@query("grey_levels", """
    SELECT x, y, g.v AS g, s.v AS s FROM grey_g g JOIN grey_s s USING (x, y)""", ("grey_g", "grey_s"))
def grey_levels(spark, d):
    stack = N.own_cells(C.stacked_composite(_dense(spark, d), _dense_radar(spark, d), size=fx.TILE), fx.TILE)
    return stack.filter("VV IS NOT NULL OR VH IS NOT NULL").select("x", "y", X.optical_grey().alias("g"), X.radar_grey().alias("s"))


# ---- neighbourhoods ----

_TEXTURES = [f"g_{n}" for n in C.OPTICAL_TEXTURES]


@query("optical_texture", f"""
    SELECT x, y, {round_sql(_TEXTURES, 10)} FROM (SELECT x, y FROM grey_g WHERE v IS NOT NULL) c LEFT JOIN texture_g USING (x, y)""",
    ("texture_g",))
def optical_texture(spark, d):
    image = C.median_composite(_dense(spark, d), ["B8"]).withColumn("grey", X.optical_grey())
    return rounded(N.texture(image, "grey", "g", size=fx.TILE), _TEXTURES, 10)


@query("radar_texture", f"""
    SELECT x, y, {round_sql(["s_contrast", "s_var", "s_ent"], 10)} FROM grey_s LEFT JOIN texture_s USING (x, y)""", ("texture_s",))
def radar_texture(spark, d):
    image = C.median_composite(_dense_radar(spark, d), ["VV"]).withColumn("grey", X.radar_grey())
    return rounded(N.texture(image, "grey", "s", C.RADAR_TEXTURES, fx.TILE), ["s_contrast", "s_var", "s_ent"], 10)


def _scaled(name: str) -> str:
    if name in _RADAR_SQL:
        return f"{_RADAR_SQL[name]} AS {name}"
    if name in S.FEATURE_RANGES and name not in INDICES:
        return f"{unit(name, *S.FEATURE_RANGES[name])} AS {name}"
    return name


@query("feature_stack", f"""
    SELECT x, y, {round_sql(S.FULL_BANDS)} FROM (SELECT x, y, {", ".join(_scaled(b) for b in S.FULL_BANDS)}
    FROM dense_indices LEFT JOIN dense_radar USING (x, y) LEFT JOIN texture_g USING (x, y) LEFT JOIN texture_s USING (x, y)) f""",
    ("dense_indices", "dense_radar", "texture_g", "texture_s"))
def feature_stack(spark, d):
    return rounded(C.feature_stack(_dense(spark, d), _dense_radar(spark, d), S.FULL_BANDS, fx.TILE), S.FULL_BANDS)


@query("band_saturation", "SELECT band, round(avg(hit), 6) AS saturated, count(hit) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{b}' AS band, CASE WHEN {b} IS NOT NULL THEN CAST({b} <= {lo}e0 OR {b} >= {hi}e0 AS INT) END AS hit FROM raw_bands"
    for b, (lo, hi) in S.FEATURE_RANGES.items() if b[:2] in ("g_", "s_")) + ") u GROUP BY band", ("raw_bands",))
def band_saturation(spark, d):
    ranges = {b: r for b, r in S.FEATURE_RANGES.items() if b[:2] in ("g_", "s_")}
    optical = C.median_composite(_dense(spark, d), ["B8"]).withColumn("grey", X.optical_grey())
    radar = C.median_composite(_dense_radar(spark, d), ["VV"]).withColumn("grey", X.radar_grey())
    g = N.texture(optical, "grey", "g", ["contrast", "ent", "var", "diss"], fx.TILE)
    s = N.texture(radar, "grey", "s", C.RADAR_TEXTURES, fx.TILE)
    raw = g.unionByName(s, allowMissingColumns=True)
    return rounded(quality.saturation(raw, ranges), ["saturated"])


_FOCAL = """
    SELECT x, y, classification FROM (SELECT c.x, c.y, n.classification,
    row_number() OVER (PARTITION BY c.x, c.y ORDER BY count(*) DESC, n.classification) AS rn FROM class_map c
    JOIN class_map n ON n.x BETWEEN c.x - 1 AND c.x + 1 AND n.y BETWEEN c.y - 1 AND c.y + 1
    WHERE c.classification IS NOT NULL AND n.classification IS NOT NULL GROUP BY c.x, c.y, n.classification) r WHERE rn = 1
    UNION ALL SELECT x, y, classification FROM class_map WHERE classification IS NULL"""


@query("focal_mode", _FOCAL, ("class_map",))
def focal_mode(spark, d):
    return N.focal_mode(fx.class_map(spark, d), "classification", labels=S.CLASS_IDS, size=fx.TILE)


@query("focal_mode_any_labels", _FOCAL, ("class_map",))
def focal_mode_any_labels(spark, d):
    return N.focal_mode(fx.class_map(spark, d), "classification", size=fx.TILE)


@query("tile_halo", """
    SELECT tx, ty, count(*) AS cells, count(*) FILTER (WHERE floor(x / 64) = tx AND floor(y / 64) = ty) AS own FROM (
    SELECT DISTINCT x, y, CAST(floor((x + dx) / 64) AS BIGINT) AS tx, CAST(floor((y + dy) / 64) AS BIGINT) AS ty FROM class_map,
    (VALUES (-24), (0), (24)) AS a(dx), (VALUES (-24), (0), (24)) AS b(dy)) t GROUP BY tx, ty""", ("class_map",))
def tile_halo(spark, d):
    tiled = N.to_tiles(fx.class_map(spark, d), S.EDGE_PAD_PX)
    mine = (F.col("tx") == N.tile_of("x", N.TILE_SIZE)) & (F.col("ty") == N.tile_of("y", N.TILE_SIZE))
    return tiled.groupBy("tx", "ty").agg(F.count("*").alias("cells"), F.count_if(mine).alias("own"))


# ---- clip and areas ----

def _inside_sql(lon: str, lat: str) -> str:
    ring = fx.AOI[0]
    hits = [
        f"CAST((({y1}e0 > {lat}) <> ({y2}e0 > {lat})) AND {lon} < ({x2}e0 - {x1}e0) * ({lat} - {y1}e0) / ({y2}e0 - {y1}e0) + {x1}e0 AS INT)"
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]])
    ]
    return f"({' + '.join(hits)}) % 2 = 1"


@query("clip_to_area", f"""
    SELECT x, y, round(B8, 6) AS B8 FROM (SELECT *, 79e0 + x * 0.02e0 + 0.01e0 AS lon, 22.8e0 + y * 0.02e0 + 0.01e0 AS lat FROM composite) c
    WHERE {_inside_sql("lon", "lat")}""", ("composite",))
def clip_to_area(spark, d):
    image = fx.with_lonlat(C.median_composite(_optical(spark, d), ["B8"]))
    return rounded(regions.clip(image, fx.AOI).select("x", "y", "B8"), ["B8"])


@query("class_histogram", """
    SELECT classification, count(*) AS pixel_count FROM class_map WHERE classification IS NOT NULL GROUP BY classification""", ("class_map",))
def class_histogram(spark, d):
    return areas.class_histogram(fx.class_map(spark, d))


_SCALED = """
    SELECT {scale} AS scale_m, class_id, count(*) AS cells, sum(seen) * 100e0 AS area_sqm FROM (
    SELECT CAST(floor(x / {f}) AS BIGINT) AS cx, CAST(floor(y / {f}) AS BIGINT) AS cy, sum(n) AS seen, CAST(arg_max(class_id, n * 100 - class_id) AS INT) AS class_id FROM (
    SELECT CAST(floor(x / {f}) AS BIGINT) * {f} AS x, CAST(floor(y / {f}) AS BIGINT) * {f} AS y, classification AS class_id, count(*) AS n
    FROM class_map WHERE classification IS NOT NULL GROUP BY ALL) a GROUP BY ALL) b GROUP BY class_id"""


@query("grouped_area", f"SELECT class_id, area_sqm FROM ({_SCALED.format(scale=30, f=3)}) s", ("class_map",))
def grouped_area(spark, d):
    return areas.grouped_area(fx.class_map(spark, d), 30)


@query("area_by_scale", " UNION ALL ".join(_SCALED.format(scale=s, f=s // 10) for s in pyramid.SCALES_M), ("class_map",))
def area_by_scale(spark, d):
    return pyramid.area_by_scale(fx.class_map(spark, d))


@query("bands_at_30_m", """
    SELECT CAST(floor(x / 3) AS BIGINT) AS x, CAST(floor(y / 3) AS BIGINT) AS y, round(avg(B4) + 1e-9, 6) AS B4, round(avg(B8) + 1e-9, 6) AS B8, round(count(*) / 9e0, 6) AS seen
    FROM composite GROUP BY ALL""", ("composite",))
def bands_at_30_m(spark, d):
    coarse = pyramid.coarser_bands(C.median_composite(_optical(spark, d), ["B4", "B8"]), ["B4", "B8"], 3)
    # a mean that lies halfway between two roundings goes up on both sides
    return rounded(coarse.withColumns({b: F.col(b) + 1e-9 for b in ("B4", "B8")}), ["B4", "B8", "seen"])


@query("area_table_written", f"""
    SELECT c.class_id, c.name, CAST(coalesce(s.cells, 0) AS BIGINT) AS cells, coalesce(s.area_sqm, 0e0) AS area_sqm FROM classes c LEFT JOIN ({_SCALED.format(scale=100, f=10)}) s USING (class_id)""",
    ("classes", "class_map"))
def area_table_written(spark, d):
    """The area export at 100 m, written as CSV and read back."""
    path = f"{shared_folder(spark)}/areas-{uuid.uuid4().hex}"
    sinks.write_csv(pyramid.area_table(fx.class_map(spark, d), 100), path)
    return spark.read.schema("class_id int, name string, cells long, area_sqm double").csv(path, header=True)


@query("observations_from_store", f"""
    SELECT scene_id, x, y, B4 FROM observations JOIN scenes USING (scene_id) WHERE sensor = 'S2' AND x BETWEEN 10 AND 25 AND y BETWEEN 1 AND 9
    AND ts >= '{fx.WINDOW[0]}' AND ts < '{fx.WINDOW[1]}' AND cloud_pct < 60""", ("observations", "scenes"))
def observations_from_store(spark, d):
    """A small area and window read from an archive in tile order."""
    scenes, path = fx.scenes(spark, d), f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    store.write_observations(fx.observations(spark, d), scenes, path, tile=8)
    seen = store.pruned(store.read_observations(spark, path).filter("sensor = 'S2'"), (10, 1, 25, 9), [fx.WINDOW])
    return SC.observations_of(seen, SC.optical_scenes(scenes, *fx.WINDOW, cloud=60), ["B4"])


@query("result_written_once", """
    SELECT x, y, classification, 1 AS results FROM class_map""", ("class_map",))
def result_written_once(spark, d):
    """Two writers of one content key, side by side; what a reader finds."""
    root = f"{shared_folder(spark)}/once-{uuid.uuid4().hex}"
    image = fx.class_map(spark, d)
    with ThreadPoolExecutor(2) as pool:
        paths = set(pool.map(inheritable_thread_target(spark)(lambda _: sinks.write_once(image, root, "result")), range(2)))
    return spark.read.parquet(*sorted(paths)).withColumn("results", F.lit(len(paths)))


_AREAS = """
    SELECT class_id, name, color, description, n AS pixel_count, round(n * 100e0, 2) AS area_sqm, round(n * 100e0 / 10000, 4) AS area_ha,
    round(n * 100e0 / 4046.856e0, 4) AS area_acres, CASE WHEN total > 0 THEN round(n * 100e0 / (total * 100e0) * 100, 2) ELSE 0e0 END AS percentage
    FROM (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total FROM (
    SELECT c.*, count(m.classification) AS n FROM classes c LEFT JOIN class_map m ON m.classification = c.class_id {where} GROUP BY ALL) a) b"""


@query("class_area_table", _AREAS.format(where=""), ("classes", "class_map"))
def class_area_table(spark, d):
    return areas.class_area_table(fx.class_map(spark, d))


@query("class_area_missing_class", _AREAS.format(where="AND m.classification <> 3"), ("classes", "class_map"))
def class_area_missing_class(spark, d):
    return areas.class_area_table(fx.class_map(spark, d).filter("classification <> 3"))


@query("area_summary", """
    SELECT count(classification) AS total_pixels, round(count(classification) * 100e0, 2) AS total_area_sqm,
    round(count(classification) * 100e0 / 10000, 4) AS total_area_ha,
    round(count(classification) * 100e0 / 4046.856e0, 4) AS total_area_acres FROM class_map""", ("class_map",))
def area_summary(spark, d):
    return areas.area_summary(fx.class_map(spark, d))


@query("dominant_class", "SELECT name, percentage FROM (" + _AREAS.format(where="") + ") t ORDER BY percentage DESC, class_id LIMIT 1",
       ("classes", "class_map"))
def dominant_class(spark, d):
    return areas.dominant_class(areas.class_area_table(fx.class_map(spark, d)))


@query("area_report", f"""
    SELECT 'Feature' AS kind, 'Polygon' AS shape, 'gtb' AS model, (SELECT count(classification) FROM class_map) AS total_pixels,
    class_id, name, pixel_count, area_ha, percentage FROM ({_AREAS.format(where="")}) a""", ("classes", "class_map"))
def area_report(spark, d):
    """The report as it is written to a file, with every area row of it."""
    image = fx.class_map(spark, d)
    geometry = '{"type":"Polygon","coordinates":[[[79.1,22.9],[79.7,22.85],[79.9,23.3],[79.3,23.5],[79.1,22.9]]]}'
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    sinks.write_report(areas.geojson_report(geometry, "gtb", areas.area_summary(image), areas.class_area_table(image)), path)
    field = lambda at: F.get_json_object("value", at)
    rows = "array<struct<class_id: int, name: string, pixel_count: long, area_ha: double, percentage: double>>"
    return spark.read.text(path).select(
        field("$.type").alias("kind"), field("$.geometry.type").alias("shape"), field("$.properties.model.id").alias("model"),
        field("$.properties.summary.total_pixels").cast("long").alias("total_pixels"),
        F.explode(F.from_json(field("$.properties.individual_class_areas"), rows)).alias("a"),
    ).select("kind", "shape", "model", "total_pixels", "a.*")


@query("raster_tiles", """
    SELECT CAST(floor(x / 16) AS BIGINT) AS tile_x, CAST(floor(y / 16) AS BIGINT) AS tile_y, count(*) AS pixels FROM class_map GROUP BY ALL""",
    ("class_map",))
def raster_tiles(spark, d):
    return grid.assign_tiles(fx.class_map(spark, d), 16).groupBy("tile_x", "tile_y").agg(F.count("*").alias("pixels"))
