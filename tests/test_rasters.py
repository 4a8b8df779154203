import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from landsift import schema as S
from landsift.functions import spectral as X
from landsift.operators import composite as C
from landsift.operators import medians as M
from landsift.operators import neighborhood as N


def raster(spark, values, column="v"):
    return spark.createDataFrame([(x, y, v) for (x, y), v in values.items()], f"x long, y long, {column} int")


def random_raster(seed, w, h, top, holes=0.1, gaps=0.05):
    draw = random.Random(seed)
    return {
        (x, y): None if draw.random() < holes else draw.randrange(top)
        for x in range(w) for y in range(h) if draw.random() > gaps
    }


def window(values, x, y):
    return [[values.get((x + dx, y + dy)) for dx in (-1, 0, 1)] for dy in (-1, 0, 1)]


def brute_texture(grid):
    """Co-occurrence features from the definition: build every matrix in full."""
    totals = Counter()
    for step_x, step_y in ((1, 0), (0, 1), (1, -1), (1, 1)):
        counts = Counter()
        for y in range(3):
            for x in range(3):
                if 0 <= x + step_x < 3 and 0 <= y + step_y < 3:
                    a, b = grid[y][x], grid[y + step_y][x + step_x]
                    counts[a, b] += 1
                    counts[b, a] += 1
        p = {k: v / sum(counts.values()) for k, v in counts.items()}
        mean = sum(i * v for (i, _), v in p.items())
        totals["contrast"] += sum(v * (i - j) ** 2 for (i, j), v in p.items()) / 4
        totals["ent"] += -sum(v * math.log(v) for v in p.values()) / 4
        totals["var"] += sum(v * (i - mean) ** 2 for (i, _), v in p.items()) / 4
        totals["idm"] += sum(v / (1 + (i - j) ** 2) for (i, j), v in p.items()) / 4
        totals["diss"] += sum(v * abs(i - j) for (i, j), v in p.items()) / 4
        totals["asm"] += sum(v * v for v in p.values()) / 4
    return totals


@pytest.mark.parametrize("size", [3, 64])
def test_texture_equals_the_definition(spark, size):
    values = random_raster(1, 12, 9, 5)
    got = {(r["x"], r["y"]): r for r in N.texture(raster(spark, values), "v", "t", size=size).collect()}
    assert set(got) == {k for k, v in values.items() if v is not None}
    full = 0
    for (x, y), row in got.items():
        around = window(values, x, y)
        if any(v is None for line in around for v in line):
            assert all(row[f"t_{n}"] is None for n in N.TEXTURES)
        else:
            full += 1
            for name, value in brute_texture(around).items():
                assert row[f"t_{name}"] == pytest.approx(value, abs=1e-9)
    assert full > 5


def test_flat_window_has_no_texture(spark):
    flat = raster(spark, {(x, y): 7 for x in range(3) for y in range(3)})
    row = N.texture(flat, "v", "t").filter("x = 1 AND y = 1").first()
    assert (row["t_contrast"], row["t_var"], row["t_diss"], row["t_ent"]) == (0, 0, 0, 0)
    assert (row["t_idm"], row["t_asm"]) == (1, 1)


@pytest.mark.parametrize("size,labels", [(2, S.CLASS_IDS), (64, S.CLASS_IDS), (5, None)])
def test_focal_mode_ties_masks_and_edges(spark, size, labels):
    values = random_raster(2, 11, 8, 5, holes=0.25, gaps=0.2)
    got = {(r["x"], r["y"]): r["v"] for r in N.focal_mode(raster(spark, values), "v", labels=labels, size=size).collect()}
    assert set(got) == set(values)
    for (x, y), centre in values.items():
        votes = Counter(v for line in window(values, x, y) for v in line if v is not None)
        best = None if centre is None else min(k for k, n in votes.items() if n == max(votes.values()))
        assert got[x, y] == best


def test_focal_mode_larger_radius(spark):
    values = random_raster(3, 9, 9, 3, holes=0, gaps=0)
    got = {(r["x"], r["y"]): r["v"] for r in N.focal_mode(raster(spark, values), "v", radius=2, labels=[0, 1, 2], size=4).collect()}
    for x, y in values:
        votes = Counter(values[a, b] for a in range(x - 2, x + 3) for b in range(y - 2, y + 3) if (a, b) in values)
        assert got[x, y] == min(k for k, n in votes.items() if n == max(votes.values()))


def test_each_cell_has_one_own_tile(spark):
    cells = raster(spark, random_raster(4, 20, 20, 3, 0, 0))
    assert N.own_cells(N.to_tiles(cells, 2, 7), 7).count() == 400


def skewed(spark, n=6000):
    """One key owns a third of all rows; other keys are small; some values are NULL."""
    draw = random.Random(5)
    rows = [(0 if i % 3 == 0 else i % 97 + 1, draw.choice([None, draw.gauss(0, 1), float(draw.randrange(5))]),
             None if i % 3 == 0 else draw.random(), 4.0) for i in range(n)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double")


def test_hot_key_is_found_and_its_median_is_the_same(spark):
    df = skewed(spark)
    assert len(M.hot_keys(df, ["k"], min_rows=100)) == 1
    assert M.hot_keys(df, ["k"]) == []
    plain = M.exact_medians(df, ["k"], ["a", "b", "c"], extra={"n": F.count("*")})
    split = M.exact_medians(df, ["k"], ["a", "b", "c"], extra={"n": F.count("*")}, hot_rows=100)
    all_hot = M.refined_medians(df, ["k"], ["a", "b", "c"], {"n": F.count("*")})
    want = sorted(plain.collect())
    for other in (split, all_hot):
        got = sorted(other.collect())
        assert [r["k"] for r in got] == [r["k"] for r in want]
        for g, w in zip(got, want):
            assert g["n"] == w["n"]
            for c in "abc":
                assert (g[c] is None and w[c] is None) or g[c] == pytest.approx(w[c], abs=1e-12)


def test_median_rule(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 4.0, 10.0, None)], "k long, v double")
    assert M.exact_medians(df, ["k"], ["v"]).first()["v"] == 3.0
    assert M.refined_medians(df, ["k"], ["v"]).first()["v"] == 3.0


def pixels(spark, seed, bands, n=900):
    draw = random.Random(seed)
    rows = [(draw.randrange(12), draw.randrange(12), *[draw.random() for _ in bands]) for _ in range(n)]
    return spark.createDataFrame(rows, ", ".join(["x long", "y long", *[f"{b} double" for b in bands]]))


def test_features_do_not_depend_on_tiles_or_partitions(spark):
    optical = pixels(spark, 6, S.OPTICAL_BANDS)
    radar = pixels(spark, 7, S.RADAR_BANDS, 500).withColumns({"VV": F.col("VV") * 30 - 25, "VH": F.col("VH") * 30 - 30})
    one = sorted(C.feature_stack(optical, radar, S.FULL_BANDS, size=64).collect())
    two = sorted(C.feature_stack(optical.repartition(13), radar.repartition(3), S.FULL_BANDS, size=3).collect())
    hot = sorted(C.feature_stack(optical, radar, S.FULL_BANDS, size=5, hot_rows=1).collect())
    assert len(one) == len(two) == len(hot) == optical.select("x", "y").distinct().count()
    for a, b, c in zip(one, two, hot):
        for band in S.FULL_BANDS:
            assert (a[band] is None) == (b[band] is None) == (c[band] is None)
            if a[band] is not None:
                assert a[band] == pytest.approx(b[band], abs=1e-9) and a[band] == pytest.approx(c[band], abs=1e-9)
    ranged = ["NDVI", "SWIRratio", "BAEI", "g_contrast", "g_idm", "g_asm", "VV", "VH", "VVVH", "s_ent"]
    assert all(-1 <= r[b] <= 1 for r in one for b in ranged if r[b] is not None)


def test_stack_equals_joined_composites(spark):
    optical, radar = pixels(spark, 8, S.OPTICAL_BANDS, 100), pixels(spark, 9, S.RADAR_BANDS, 100)
    bands = [*S.OPTICAL_BANDS, *S.RADAR_BANDS]
    stacked = N.own_cells(C.stacked_composite(optical, radar, 1)).select("x", "y", *bands)
    joined = C.join_composites(C.median_composite(optical, S.OPTICAL_BANDS), C.median_composite(radar, S.RADAR_BANDS))
    assert sorted(map(tuple, stacked.collect()), key=repr) == sorted(map(tuple, joined.select("x", "y", *bands).collect()), key=repr)


def test_clouds_mask_and_masks_survive_arithmetic(spark):
    df = spark.createDataFrame([(1000, 0), (1000, 1 << 10), (1000, 1 << 11), (1000, 1 << 9)], "B4 int, QA60 int")
    assert [r[0] for r in df.select(X.masked_reflectance("B4")).collect()] == [0.1, None, None, 0.1]
    nothing = spark.createDataFrame([(None, 0.0)], "a double, b double")
    row = nothing.select(X.clamp(F.col("a"), 0, 1).alias("c"), X.normalized_difference("b", "b").alias("d")).first()
    assert row["c"] is None and row["d"] is None


def test_bands_are_not_overwritten_by_accident(spark):
    df = spark.createDataFrame([(1.0,)], "B4 double")
    with pytest.raises(ValueError):
        X.add_bands(df, {"B4": F.lit(2.0)}, overwrite=False)
    assert X.add_bands(df, {"B4": F.lit(2.0)}).first()["B4"] == 2.0


def test_row_expressions_also_run_on_a_stream_of_pixels(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    pixels(spark, 10, ["B4", "B8"], 50).write.parquet(source)
    stream = spark.readStream.schema("x long, y long, B4 double, B8 double").parquet(source)
    ndvi = stream.withColumn("NDVI", X.normalized_difference("B8", "B4"))
    run = ndvi.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(sink)
    run.awaitTermination(120)
    assert spark.read.parquet(sink).filter("NDVI IS NOT NULL").count() == 50


def test_halo_wider_than_a_tile(spark):
    image = raster(spark, random_raster(11, 14, 13, 4))
    small, large = (sorted(map(str, N.focal_mode(image, "v", 9, size=size).select("x", "y", "v").collect())) for size in (4, 64))
    assert small == large


def test_hot_key_with_a_null_part(spark):
    rows = [(1, None, 2.0), (1, None, 4.0), (1, None, None), (None, None, 7.0), (1, 3, 5.0)]
    df = spark.createDataFrame(rows, "a long, b long, v double")
    plain = sorted(map(str, M.exact_medians(df, ["a", "b"], ["v"]).collect()))
    assert plain == sorted(map(str, M.exact_medians(df, ["a", "b"], ["v"], hot_rows=0).collect()))
    assert len(plain) == 3 and sum("3.0" in r for r in plain) == 1
