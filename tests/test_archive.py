"""The archive in tile order, coarser scales, results written in one step, and sweeps that go on where they stopped."""

import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from landsift import schema as S
from landsift.operators import pyramid
from landsift.plans import experiments
from landsift.plans.features import Archive, Request, selected_pixels
from landsift.sources import sinks, store


def test_curve_numbers_in_columns_and_ranges(spark):
    draw = random.Random(1)
    cells = [(draw.randrange(-900, 900), draw.randrange(-900, 900)) for _ in range(400)]
    rows = spark.createDataFrame(cells, "x long, y long").withColumn("z", store.z_column(F.col("x"), F.col("y"), 8)).collect()
    assert all(r.z == store.z_number(r.x // 8, r.y // 8) for r in rows)
    for _ in range(40):
        x0, y0 = draw.randrange(-500, 400), draw.randrange(-500, 400)
        box = (x0, y0, x0 + draw.randrange(300), y0 + draw.randrange(300))
        for most in (1, 4, 24):
            ranges = store.z_ranges(box, 8, most)
            assert len(ranges) <= most and all(a <= b for a, b in ranges)
            for r in rows:
                if box[0] <= r.x <= box[2] and box[1] <= r.y <= box[3]:
                    assert any(a <= r.z <= b for a, b in ranges)
    tight = store.z_ranges((0, 0, 63, 63), 8)
    assert sum(b - a + 1 for a, b in tight) == 64  # an aligned square is one range without anything else


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive"))
    scenes = spark.createDataFrame([(k, "S2" if k % 3 else "S1", f"2025-{1 + k % 6:02d}-{1 + k % 28:02d} 23:30:00", 5.0) for k in range(60)], "scene_id long, sensor string, ts string, cloud_pct double")
    scenes = scenes.withColumn("ts", F.col("ts").cast("timestamp"))
    seen = spark.range(40 * 40).selectExpr("id % 40 - 20 AS x", "CAST(floor(id / 40) AS BIGINT) AS y").crossJoin(spark.range(60).selectExpr("id AS scene_id"))
    bands = {b: (F.col("x") + F.col("y") + 50).cast("double") for b in [*S.OPTICAL_BANDS, *S.RADAR_BANDS]}
    seen = seen.withColumns({**bands, "QA60": F.lit(0)})
    store.write_observations(seen, scenes, path, tile=4, rows_per_file=2_000)
    return scenes, seen, path


def test_area_and_window_prune_folders_and_files(spark, kept):
    scenes, seen, path = kept
    stored = store.read_observations(spark, path)
    assert stored.drop("z", "sensor", "month", "day").count() == seen.count()
    few = store.pruned(stored.select("*", F.col("_metadata.file_path").alias("file")), (-3, 5, 4, 11), [("2025-02-01", "2025-03-01")])
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = few._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(z," in plan and "GreaterThanOrEqual(day" in plan
    every = stored.select("_metadata.file_path").distinct().count()
    read = stored.filter("month = '2025-02'").select("_metadata.file_path").distinct().count()
    assert few.select("file").distinct().count() < read < every
    dated = seen.join(scenes, "scene_id").filter("x BETWEEN -3 AND 4 AND y BETWEEN 5 AND 11 AND ts >= '2025-02-01' AND ts < '2025-03-02'")
    assert few.count() == dated.count() > 0


def test_a_request_reads_the_same_from_the_store(spark, kept):
    scenes, seen, path = kept
    plain, ordered = Archive(scenes, seen), Archive(scenes, store.read_observations(spark, path))
    scenes_ = scenes.withColumns({"instrument_mode": F.lit("IW"), "orbit_pass": F.lit("DESCENDING"), "polarisations": F.array(F.lit("VV"), F.lit("VH"))})
    for request in (Request("2025-02-01", "2025-04-01", 10), Request("2030-01-01", "2030-02-01", 10, True)):
        both = [selected_pixels(Archive(scenes_, a.observations), request, (-20, 0, 5, 9)) for a in (plain, ordered)]
        for a, b in zip(*both):
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_coarser_levels_equal_counting_pixels(spark):
    draw = random.Random(3)
    pixels = [(x, y, draw.choice([None, 0, 0, 1, 2, 3])) for x in range(-7, 40) for y in range(23) if draw.random() < 0.8]
    image = spark.createDataFrame(pixels, "x long, y long, classification int")
    found = {(r.scale_m, r.class_id): (r.cells, r.area_sqm) for r in pyramid.area_by_scale(image).collect()}
    want = Counter()
    for scale in (10, 30, 50, 100):
        cells = {}
        for x, y, c in pixels:
            if c is not None:
                cells.setdefault((x // (scale // 10), y // (scale // 10)), Counter())[c] += 1
        for counts in cells.values():
            best = min(counts, key=lambda c: (-counts[c], c))
            want[scale, best, "cells"] += 1
            want[scale, best, "area"] += 100 * sum(counts.values())
    assert found == {(s, c): (want[s, c, "cells"], want[s, c, "area"]) for s, c, kind in want if kind == "cells"}
    assert sum(a for (s, _), (_, a) in found.items() if s == 100) == 100 * sum(c is not None for *_, c in pixels)
    with pytest.raises(ValueError):
        pyramid.levels(image, [25])
    assert pyramid.area_table(image.filter("x < -100"), 30).filter("area_sqm = 0").count() == 5


def test_writers_at_once_leave_one_whole_result(spark, tmp_path):
    root = str(tmp_path)
    frames = [spark.range(1000).withColumn("who", F.lit(k)) for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        paths = set(pool.map(lambda f: sinks.write_once(f, root, "key"), frames))
    (path,) = paths
    rows = spark.read.parquet(path)
    assert rows.count() == 1000 and rows.select("who").distinct().count() == 1
    assert [p.name for p in tmp_path.iterdir()] == ["key"]


def test_a_broken_sweep_does_only_what_is_missing(spark, tmp_path, monkeypatch):
    scenes = spark.createDataFrame([(k, "S2", f"2025-01-{k + 2:02d}", 10.0 * k) for k in range(4)], "scene_id long, sensor string, ts string, cloud_pct double").withColumn("ts", F.col("ts").cast("timestamp"))
    cells = spark.range(12 * 12).selectExpr("id % 12 AS x", "CAST(floor(id / 12) AS BIGINT) AS y")
    bands = {b: F.col("x") * 200.0 + F.col("scene_id") + (k + 1) * 100 for k, b in enumerate(S.OPTICAL_BANDS)}
    seen = cells.crossJoin(scenes.select("scene_id")).withColumns({**bands, "QA60": F.lit(0)})
    points = cells.selectExpr("x * 12 + y AS point_id", "x", "y", "CAST(x / 6 AS INT) AS label")
    models = {"CART": ("cart", {"maxNodes": 4}), "k-NN": ("knn", {"k": 3})}
    args = (Archive(scenes, seen), points, {"winter": ("2025-01-01", "2025-02-01"), "none": ("2020-01-01", "2020-02-01")}, [15, 50], models)
    ledger, real, asked = str(tmp_path / "ledger"), experiments.predicted, []

    def counted(train, test, jobs):
        asked.append(len(jobs))
        if len(asked) == 2 and len(asked) <= limit[0]:
            raise RuntimeError("an executor is gone")
        return real(train, test, jobs)

    limit = [2]
    monkeypatch.setattr(experiments, "predicted", counted)
    monkeypatch.setattr(experiments, "SIDE_BY_SIDE", 1)
    with pytest.raises(RuntimeError):
        experiments.run_sweep(*args, ledger=ledger)
    done = experiments.ledger_rows(spark, ledger).count()
    assert 0 < done < 8
    limit[0], asked[:] = 0, []
    rows = experiments.run_sweep(*args, ledger=ledger).collect()
    assert len(rows) == 8 and sum(asked) == 2  # one setup of two models was missing
    assert {(r.season, r.cloud_cover, r.image_count) for r in rows} == {("winter", 15, 2), ("winter", 50, 4), ("none", 15, 0), ("none", 50, 0)}
    assert all((r.accuracy is None) == (r.season == "none") and r.error is None for r in rows)
    asked[:] = []
    assert experiments.run_sweep(*args, ledger=ledger).count() == 8 and asked == []
