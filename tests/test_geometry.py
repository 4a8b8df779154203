import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landsift import schema as S
from landsift.functions import geo
from landsift.functions import keys as K
from landsift.models.store import model_key
from landsift.operators import distances as D
from landsift.operators import districts as DI
from landsift.operators import grid, regions
from landsift.operators.sampling import block_split, random_split
from landsift.session import cut_lineage
from landsift.sources import tables

BOX = (10.25, 45.5, 10.75, 45.75)  # half a degree by a quarter


def polygon(*rings):
    return json.dumps({"type": "Polygon", "coordinates": rings})


SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]


def test_positions_at_any_depth(spark):
    shapes = [
        ({"type": "Point", "coordinates": [-4.5, 51.25]}, 1),
        ({"type": "LineString", "coordinates": [[-4.5, 51.25], [-4, 51.5], [-3.5, 51]]}, 3),
        ({"type": "MultiPolygon", "coordinates": [[[[2, 1], [6, 1], [2, 3], [2, 1]]], [[[-7, 8], [-5, 8], [-7, 9.5], [-6, 9], [-7, 8]]]]}, 9),
        ({"type": "Polygon", "coordinates": [[[-1.5e-3, 2.0, 9.0], [1, -2, 9.0], [0, 0, 9.0]]]}, 3),
    ]
    df = spark.createDataFrame([(json.dumps(g), n) for g, n in shapes], "g string, n int")
    rows = df.select("n", geo.positions(F.col("g")).alias("p")).collect()
    assert all(len(r["p"]) == r["n"] for r in rows)
    assert rows[3]["p"][0]["lon"] == -0.0015
    box = df.select(geo.bounds(geo.positions(F.col("g"))).alias("b")).collect()[2]["b"]
    assert (box["west"], box["east"], box["south"], box["north"]) == (-7.0, 6.0, 1.0, 9.5)


def test_uploads_take_the_first_polygon_or_are_rejected(spark):
    point = {"type": "Point", "coordinates": [1, 2]}
    square = {"type": "Polygon", "coordinates": [SQUARE]}
    docs = [square, {"type": "Feature", "geometry": square}, {"type": "Feature", "geometry": point}, point,
            {"type": "FeatureCollection", "features": [{"geometry": point}, {"geometry": square}]},
            {"type": "FeatureCollection", "features": []}]
    df = spark.createDataFrame([(i, json.dumps(g)) for i, g in enumerate(docs)], "id int, document string")
    rows = {r["id"]: r for r in tables.areas_of_interest(df).collect()}
    assert [rows[i]["accepted"] for i in range(6)] == [True, True, False, False, True, False]
    assert json.loads(rows[4]["geometry"]) == square and rows[2]["box"] is None


def test_polygon_with_hole_and_open_ring(spark):
    inside, hole, outside = (0.5, 0.5), (2.0, 2.0), (5.0, 1.0)
    pts = spark.createDataFrame([inside, hole, outside], "lon double, lat double")
    for text in (polygon(SQUARE, HOLE), polygon(SQUARE[:-1], HOLE[:-1])):
        edges = geo.edges(geo.rings(F.lit(text)))
        assert [r[0] for r in pts.select(geo.inside(F.col("lon"), F.col("lat"), edges)).collect()] == [True, False, False]
    fixed = geo.inside_fixed(F.col("lon"), F.col("lat"), [SQUARE, HOLE])
    assert [r[0] for r in pts.select(fixed).collect()] == [True, False, False]


def test_location_by_cell_equals_testing_every_polygon(spark):
    draw = random.Random(3)
    shapes = [(i, [[[x, y], [x + 2.5, y + 0.3], [x + 1.7, y + 2.1], [x + 0.2, y + 1.4]]])
              for i, (x, y) in enumerate((draw.uniform(-3, 3), draw.uniform(-3, 3)) for _ in range(12))]
    regs = spark.createDataFrame(shapes, "district_id long, rings array<array<array<double>>>")
    pts = spark.createDataFrame([(i, draw.uniform(-4, 6), draw.uniform(-4, 6)) for i in range(400)], "pid long, lon double, lat double")
    everything = pts.join(F.broadcast(regions.prepared(regs, ["district_id"])), geo.inside(F.col("lon"), F.col("lat"), F.col("edges")))
    want = sorted(map(tuple, everything.select("pid", "district_id").collect()))
    for cell in (0.3, 1.0, 20.0):
        assert sorted(map(tuple, regions.locate(pts, regs, ["district_id"], cell).select("pid", "district_id").collect())) == want


def test_grid_and_tiles_of_a_box(spark):
    boxes = spark.createDataFrame([(1, *BOX)], "id int, west double, south double, east double, north double")
    g = grid.render_grid(boxes).first()
    # ten metres on the ground at the middle latitude, worked out on the sphere by hand
    shrink = math.cos(math.radians((BOX[1] + BOX[3]) / 2))
    merc = [math.log(math.tan(math.pi / 4 + math.radians(v) / 2)) for v in (BOX[1], BOX[3])]
    wide, high = math.radians(BOX[2] - BOX[0]) * S.EARTH_RADIUS_M * shrink / 10, (merc[1] - merc[0]) * S.EARTH_RADIUS_M * shrink / 10
    assert (g["width"], g["height"]) == (round(wide), round(high))
    tiles = grid.tile_boxes(grid.render_grid(boxes))
    across, down = math.ceil(round(wide) / S.TILE_PX), math.ceil(round(high) / S.TILE_PX)
    assert tiles.count() == across * down and grid.tile_invariants(tiles, "id").first()["exact"]
    cells = [(r["left"], r["top"], r["right"], r["bottom"]) for r in tiles.collect()]
    assert sum((r - l) * (b - t) for l, t, r, b in cells) == round(wide) * round(high)
    rights = {(r["right"], r["top"]): r["tile_east"] for r in tiles.collect()}
    for r in tiles.collect():
        if (r["left"], r["top"]) in rights:
            assert rights[r["left"], r["top"]] == pytest.approx(r["tile_west"], abs=1e-12)


def test_tiles_of_one_small_table_are_dealt_over_tasks(spark, monkeypatch):
    rows = [(k % 5, 79.0, 22.0, 79.0 + 0.1 * k, 22.5) for k in range(1, 21)]
    grids = grid.render_grid(spark.createDataFrame(rows, "id int, west double, south double, east double, north double").coalesce(1))
    monkeypatch.setattr(grid, "TILES_A_TASK", 20)
    at = F.spark_partition_id().alias("at")
    loose = grid.tile_boxes(grids).select(at).groupBy("at").count().collect()
    assert len(loose) > 1 and max(r["count"] for r in loose) < sum(r["count"] for r in loose) / 2
    kept = grid.tile_boxes(grids, by=["id"])
    homes = kept.select("id", at).groupBy("id").agg(F.count_distinct("at").alias("n"), F.min("at").alias("at")).collect()
    assert [r["n"] for r in homes] == [1] * 5 and len({r["at"] for r in homes}) > 1
    assert grid.tile_invariants(kept, "id")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_preview_sizes(spark):
    df = spark.createDataFrame([(5.0, 5.1), (5.0, 9.0), (5.0, 5.0)], "w double, e double")
    px = df.select(geo.preview_pixels(geo.ground_width_m(F.col("w"), F.col("e"), F.lit(60.0), F.lit(60.0)))).collect()
    assert [r[0] for r in px] == [556, 2048, 256]  # 0.1 degree at 60 degrees north is 5566 m


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(-179, 178), st.floats(-70, 69), st.floats(0.001, 0.9), st.floats(0.001, 0.9)), min_size=1, max_size=20))
def test_tiles_always_cover_exactly(spark, drawn):
    rows = [(i, w, s, w + dw, s + dh) for i, (w, s, dw, dh) in enumerate(drawn)]
    boxes = spark.createDataFrame(rows, "id int, west double, south double, east double, north double")
    checks = grid.tile_invariants(grid.tile_boxes(grid.render_grid(boxes)), "id").collect()
    assert len(checks) == len(rows) and all(c["exact"] and c["reaches_right"] and c["reaches_bottom"] for c in checks)


def brute_metres(a, b):
    p1, p2 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * geo.SPHERE_M * math.asin(math.sqrt(min(1, h)))


def clustered(n, seed):
    """A third of the points in one tiny cluster, copies among them, the rest wide apart."""
    draw = random.Random(seed)
    tight = [(80 + draw.gauss(0, 1e-4), 23 + draw.gauss(0, 1e-4)) for _ in range(n // 3 - 5)]
    return tight + tight[:5] + [(draw.uniform(79, 81), draw.uniform(22, 24)) for _ in range(n - n // 3)]


def test_nearest_equals_brute_force(spark):
    pts = clustered(150, 4)
    df = spark.createDataFrame([(i % 2, *p) for i, p in enumerate(pts)], "label int, lon double, lat double")
    got = {(r["label"], r["lon"], r["lat"]): r["distance_m"] for r in D.nearest(df, df, ["label"], 5.0, skip_self=True).collect()}
    for i, p in enumerate(pts):
        same = [q for j, q in enumerate(pts) if j != i and j % 2 == i % 2]
        assert got[i % 2, *p] == pytest.approx(min(brute_metres(p, q) for q in same), abs=1e-6)
    assert sum(r["points"] for r in D.within_class_spacing(df, 100.0, 50.0).collect()) == 150


def test_lonely_point_has_no_neighbour(spark):
    df = spark.createDataFrame([(0, 80.0, 23.0), (1, 80.0, 23.0)], "label int, lon double, lat double")
    assert [r["distance_m"] for r in D.nearest(df, df, ["label"], skip_self=True).collect()] == [None, None]


def test_no_positions_are_broadcast(spark, monkeypatch):
    rows = [(k % 2, 79.0 + 0.01 * k, 22.0) for k in range(40)]
    points = spark.createDataFrame(rows, "label int, lon double, lat double")
    plans = []

    def noting(df):
        plans.append(df)
        return cut_lineage(df)

    monkeypatch.setattr(D, "cut_lineage", noting)
    spaced = D.within_class_spacing(points, first_cell_m=2500.0)
    moved = D.displacement(points, points.withColumn("lon", F.col("lon") + 1e-5), [])
    plans += [spaced, moved, D.outside_buffer(points, points.filter("label = 0"), 300.0)]
    assert not [p for p in plans if "Broadcast" in p._jdf.queryExecution().executedPlan().toString()]
    assert [r["points"] for r in spaced.collect()] == [20, 20]


def test_displacement_and_buffer(spark):
    a, b = clustered(60, 5), clustered(60, 6)
    da, db = (spark.createDataFrame(p, "lon double, lat double") for p in (a, b))
    moved = D.displacement(da, db, [], 20.0).first()
    assert moved["max_m"] == pytest.approx(max(min(brute_metres(p, q) for q in b) for p in a), abs=1e-6)
    for radius in (30.0, 5000.0):
        left = {(r["lon"], r["lat"]) for r in D.outside_buffer(da, db, radius).collect()}
        assert left == {p for p in a if min(brute_metres(p, q) for q in b) > radius}


def test_splits_survive_repartitioning(spark):
    df = spark.range(500).selectExpr("id", "79 + id * 0.013 AS lon", "22 + id * 0.007 AS lat")
    one = sorted(map(tuple, random_split(df, "id").select("id", "random", "part").collect()))
    assert one == sorted(map(tuple, random_split(df.repartition(7, "lat"), "id").select("id", "random", "part").collect()))
    assert 0.6 < sum(r[2] == "train" for r in one) / 500 < 0.8
    blocks = block_split(df).collect()
    sides = {}
    for r in blocks:
        sides.setdefault((math.floor(r["lon"] * 10), math.floor(r["lat"] * 10)), set()).add(r["part"])
    assert all(len(s) == 1 for s in sides.values()) and {r["part"] for r in blocks} == {"train", "test"}


def test_known_random_value(spark):
    row = spark.range(1).select(K.random_column(F.lit(7), 42).alias("u")).first()
    assert row["u"] == 0.5283959391526878


def test_keys_change_with_every_input(spark):
    base = ("{}", "rf", "2025-01-01", "2025-03-01", 15.0, True)
    variants = [base, ("[]", *base[1:]), ("{}", "svm", *base[2:]), (*base[:2], "2025-01-02", *base[3:]),
                (*base[:3], "2025-03-02", *base[4:]), (*base[:4], 20.0, True), (*base[:5], False), ("{}", "RF", *base[2:])]
    df = spark.createDataFrame(variants, "g string, m string, s string, e string, c double, k boolean")
    keys = [r[0] for r in df.select(K.overlay_key(*[F.col(c) for c in "gmseck"])).collect()]
    assert len(set(keys)) == 7 and keys[0] == keys[7] and len(keys[0]) == 16
    args = ("gtb", "a", "b", 15, False)
    assert model_key(*args) == model_key("XGB", "a", "b", 15.0, False) != model_key("gtb", "a", "b", 15, True)


def test_resampling_weights_are_stable_and_average_one(spark):
    districts = spark.range(40).withColumnRenamed("id", "district_id")
    drawn = DI.resampled(districts, 100, 1)
    assert drawn.count() == 4000
    assert drawn.agg(F.avg("weight")).first()[0] == pytest.approx(1, abs=0.06)
    assert sorted(drawn.collect()) == sorted(DI.resampled(districts.repartition(5), 100, 1).collect())


def test_consensus_needs_enough_votes(spark):
    maps = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (None, None, 4), (2, 2, 2)], "a int, b int, c int")
    rows = DI.consensus(maps, ["a", "b", "c"], S.CLASS_IDS, 2).collect()
    assert [r["consensus"] for r in rows] == [1, None, None, 2] and [r["votes"] for r in rows] == [2, 1, 1, 3]


def star(n, seed=1):
    """A jagged outline of n vertices around (10, 20), with a hole."""
    draw = np.random.default_rng(seed)
    turn = np.sort(draw.uniform(0, 2 * np.pi, n))
    far = draw.uniform(0.7, 1.0, n)
    outer = np.column_stack((10 + far * np.cos(turn), 20 + far * np.sin(turn)))
    inner = np.array([[9.9, 19.9], [10.1, 19.9], [10.1, 20.1], [9.9, 20.1]])
    return [np.column_stack((ring, np.roll(ring, -1, 0))) for ring in (outer, inner)]


def by_hand(x, y, edges):
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = ((edges[:, 1] > y) != (edges[:, 3] > y)) & (x < (edges[:, 2] - edges[:, 0]) * (y - edges[:, 1]) / (edges[:, 3] - edges[:, 1]) + edges[:, 0])
    return crossed.sum() % 2 == 1


@pytest.mark.parametrize(("edges", "n"), [(np.concatenate(star(100_000)), 112), (np.concatenate(star(60)), 7), (np.array([[0, 0, 4, 0], [4, 0, 4, 4], [4, 4, 0, 4], [0, 4, 0, 0]], float), 4)])
def test_cells_of_a_cover_decide_like_the_whole_outline(edges, n):
    cells = {(fx, fy): rest for fx, fy, *rest in regions.cover(edges, n)}
    assert len(cells) <= n * n and (len(edges) < 1000 or sum(c[0] for c in cells.values()) > 4000)
    west, south = edges[:, 0].min(), edges[:, 1].min()
    width, height = (edges[:, 0].max() - west) / n, (edges[:, 1].max() - south) / n
    draw = np.random.default_rng(5)
    points = [(west + draw.random() * width * n, south + draw.random() * height * n) for _ in range(1500)]
    points += [(x, y) for x, y in edges[:100, :2]] + [(west + i * width, south + j * height) for i in range(n + 1) for j in range(min(n, 6))]
    for x, y in points:
        cell = cells.get((min(n - 1, int((x - west) // width)), min(n - 1, int((y - south) // height))))
        found = cell is not None and (cell[0] or (sum([by_hand(x, y, np.array(cell[2]).reshape(-1, 4)), sum(f <= y for f in cell[3]) % 2, cell[1]]) % 2 == 1))
        assert found == by_hand(x, y, edges)
    assert max(len(c[2]) for c in cells.values()) < max(10, len(edges) / 50)  # border cells hold what comes near them


def test_points_in_a_region_of_many_vertices(spark):
    rings = star(20_000)
    regs = spark.createDataFrame([(7, [r[:, :2].tolist() for r in rings])], "district_id long, rings array<array<array<double>>>")
    draw = np.random.default_rng(8)
    pts = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(draw.uniform(8.9, 11.1, 3000), draw.uniform(18.9, 21.1, 3000)))]
    got = {r.pid for r in regions.locate(spark.createDataFrame(pts, "pid long, lon double, lat double"), regs, ["district_id"], 0.5).collect()}
    assert got == {k for k, x, y in pts if by_hand(x, y, np.concatenate(rings))}


def test_crowded_cells_are_made_finer(spark):
    """Very many positions within one cell of 10 m, and some far away, against brute force on a sample."""
    n = 200_000
    crowd = spark.range(n).select(F.lit(1).alias("label"), (F.lit(80.0) + F.rand(3) * 9e-5).alias("lon"), (F.lit(23.0) + F.rand(4) * 9e-5).alias("lat"))
    crowd = cut_lineage(crowd.unionByName(spark.createDataFrame([(1, 80.01, 23.0), (1, 80.02, 23.0)], "label int, lon double, lat double")))
    assert D.uncrowded_cell(crowd, ["label"], 10.0, 4, 23.1) < 1
    found = {(r.lon, r.lat): r.distance_m for r in D.nearest(crowd, crowd, ["label"], skip_self=True).collect()}
    rows = np.array([(r.lon, r.lat) for r in crowd.select("lon", "lat").collect()])
    assert len(found) == len(rows)
    radians = np.radians(rows)
    for k in [*range(0, n, n // 40), n, n + 1]:
        half = np.sin((radians[:, 1] - radians[k, 1]) / 2) ** 2 + np.cos(radians[:, 1]) * np.cos(radians[k, 1]) * np.sin((radians[:, 0] - radians[k, 0]) / 2) ** 2
        half[k] = 9
        want = 2 * geo.SPHERE_M * np.arcsin(np.sqrt(half.min()))
        assert abs(found[tuple(rows[k])] - want) < 1e-6 * max(1, want)
