import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landsift import schema as S
from landsift.models import knn
from landsift.models.factory import Classifier, make_classifier
from landsift.models.store import ModelStore, content_of, model_key
from landsift.models.tuning import expand, grid_search
from landsift.operators import metrics
from landsift.plans.classify import classified_raster, classify_and_analyze
from landsift.plans.experiments import compare_stacks, run_sweep
from landsift.plans.features import Archive, Request
from landsift.sources import scenes as SC
from landsift.sources import sinks, tables


def blobs(spark, n=240, seed=0, classes=3):
    draw = np.random.default_rng(seed)
    rows = [(i, *map(float, draw.normal(i % classes * 3.0, 0.6, 2)), i % classes) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, label int")


def hit_rate(df):
    return df.agg(F.avg((F.col("label") == F.col("classification")).cast("double"))).first()[0]


@pytest.mark.parametrize("model,params", [
    ("rf", {"numberOfTrees": 10, "minLeafPopulation": 1, "bagFraction": 0.5, "maxNodes": None}),
    ("gtb", {"numberOfTrees": 3, "shrinkage": 0.1, "maxNodes": 10}),
    ("cart", {"maxNodes": 20}), ("knn", {"k": 9}),
    ("svm", {"kernelType": "RBF", "gamma": 0.1, "cost": 10.0}),
])
def test_every_model_learns_and_keeps_masks(spark, model, params):
    fitted = make_classifier(model, params).fit(blobs(spark), ["a", "b"])
    test = blobs(spark, 60, 1)
    scored = fitted.transform(test)
    assert scored.columns == [*test.columns, "classification"] and hit_rate(scored) > 0.9
    masked = test.withColumn("a", F.when(F.col("id") > 10, F.col("a")))
    rows = fitted.transform(masked).collect()
    assert len(rows) == 60 and all((r["classification"] is None) == (r["a"] is None) for r in rows)


def test_kernel_machine_separates_a_ring(spark):
    draw = np.random.default_rng(2)
    angle, radius = draw.uniform(0, 6.28, 300), np.where(np.arange(300) % 2 == 0, 0.5, 3.0)
    rows = [(i, float(r * np.cos(t)), float(r * np.sin(t)), i % 2) for i, (t, r) in enumerate(zip(angle, radius))]
    ring = spark.createDataFrame(rows, "id long, a double, b double, label int")
    assert hit_rate(make_classifier("svm", {"kernelType": "RBF", "gamma": 1.0, "cost": 100.0}).fit(ring, ["a", "b"]).transform(ring)) > 0.97


def test_factory_settings():
    assert make_classifier("XGB") == Classifier("gtb", {"numberOfTrees": 300, "shrinkage": 0.1, "maxNodes": 10})
    assert "maxNodes" not in make_classifier("rf").settings
    with pytest.raises(ValueError):
        make_classifier("perceptron")


def test_search_grids_have_the_published_sizes():
    assert {n: len(expand(g)) for n, g in S.TUNING_GRIDS.items()} == {"Random Forest": 108, "SVM": 12, "XGBoost": 48}


def brute_vote(train, labels, row, k):
    order = sorted(range(len(train)), key=lambda i: (((train[i] - row) ** 2).sum(), i))[:k]
    counts = np.bincount(labels[order])
    return int(counts.argmax())


@pytest.mark.parametrize("streamed", [False, True])
def test_neighbours_equal_brute_force(spark, monkeypatch, streamed):
    if streamed:
        monkeypatch.setattr(knn, "BROADCAST_VALUES", 0)
        monkeypatch.setattr(knn, "TRAIN_ROWS", 37)
    draw = np.random.default_rng(3)
    train = draw.integers(0, 4, (300, 3)).astype(float)  # many equal distances and copies
    labels = draw.integers(0, 5, 300)
    query = draw.integers(0, 4, (80, 3)).astype(float)
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(i, *map(float, r), int(l)) for i, (r, l) in enumerate(zip(train, labels))], "id long, a double, b double, c double, label int")
    q = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(query)], "id long, a double, b double, c double")
    got = {r["id"]: r["classification"] for r in knn.KNearest(names, 5, ident="id").fit(df.repartition(7)).transform(q).collect()}
    assert got == {i: brute_vote(train, labels, r, 5) for i, r in enumerate(query)}


def test_saved_model_is_used_again(spark, tmp_path):
    key = model_key("cart", "a", "b", 15, False)
    calls = []

    def sample():
        calls.append(1)
        return blobs(spark)

    first = ModelStore(spark, str(tmp_path)).get(key, make_classifier("cart"), sample, ["a", "b"])
    again = ModelStore(spark, str(tmp_path)).get(key, make_classifier("cart"), sample, ["a", "b"])
    assert calls == [1]
    test = blobs(spark, 50, 4)
    assert sorted(first.transform(test).collect()) == sorted(again.transform(test).collect())


def test_kernel_model_survives_saving(spark, tmp_path):
    fitted = make_classifier("svm").fit(blobs(spark, 90), ["a", "b"])
    fitted.save(str(tmp_path / "svm"))
    test = blobs(spark, 30, 5)
    assert sorted(type(fitted).load(str(tmp_path / "svm")).transform(test).collect()) == sorted(fitted.transform(test).collect())


def test_grid_search_ranks_and_scores_both_sides(spark):
    table = grid_search(blobs(spark, 120), ["a", "b"], "id", {"Random Forest": [{"n_estimators": [3], "min_samples_leaf": [1, 40], "max_samples": [None]}]}, 2)
    rows = sorted(table.collect(), key=lambda r: r["rank_test_score"])
    assert rows[0]["rank_test_score"] == 1 and rows[0]["mean_test_score"] >= rows[1]["mean_test_score"]
    assert all(0 <= r["mean_train_score"] <= 1 and r["std_test_score"] >= 0 for r in rows)


def test_scores_of_a_known_matrix(spark):
    cells = {(0, 0): 20, (0, 1): 5, (1, 0): 10, (1, 1): 15}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "label int, classification int")
    matrix, total, per = metrics.evaluate(df)
    assert matrix.count() == 25
    row = total.first()
    assert row["accuracy"] == pytest.approx(0.7) and row["kappa"] == pytest.approx(0.4)
    by_class = {r["class_id"]: r for r in per.collect()}
    assert by_class[0]["consumers"] == pytest.approx(20 / 30) and by_class[0]["producers"] == pytest.approx(20 / 25)
    assert by_class[3]["consumers"] is None and by_class[3]["producers"] is None
    assert json.loads(metrics.matrix_rows(matrix).first()["confusion_matrix"])[0][:2] == [20, 5]


# ---- a small archive on a 12 x 12 grid ----

@pytest.fixture(scope="module")
def archive(spark):
    draw = random.Random(11)
    scenes = [(i, "S2", f"2025-01-{1 + i:02d}", float(5 * i), "IW", "DESCENDING", ["VV"]) for i in range(6)]
    scenes += [(100 + i, "S1", f"2025-01-{1 + i:02d}", 0.0, "IW", "DESCENDING", ["VV", "VH"]) for i in range(3)]
    rows = []
    for scene in scenes:
        for x in range(12):
            for y in range(12):
                base = 800 * (1 + (x // 4 + y // 4) % 3)
                bands = [float(base + k * 150 + draw.randrange(120)) for k in range(6)]
                rows.append((scene[0], x, y, *bands, 1024 if draw.random() < 0.1 else 0, draw.uniform(-25, 5), draw.uniform(-30, 0)))
    frame = spark.createDataFrame(scenes, "scene_id long, sensor string, t string, cloud_pct double, instrument_mode string, orbit_pass string, polarisations array<string>")
    frame = frame.withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    obs = spark.createDataFrame(rows, "scene_id long, x long, y long, B2 double, B3 double, B4 double, B8 double, B11 double, B12 double, QA60 int, VV double, VH double")
    return Archive(frame, obs, (80.0, 23.0), 0.01, tile_size=64)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, i % 12, i // 12, 80 + (i % 12) * 0.01 + 0.005, 23 + (i // 12) * 0.01 + 0.005, (i % 12 // 4 + i // 12 // 4) % 3) for i in range(144)]
    return spark.createDataFrame(rows, "point_id long, x long, y long, lon double, lat double, label int")


WINTER = Request("2025-01-01", "2025-03-01", 50)


def test_end_date_is_excluded_and_cloud_limit_is_strict(archive):
    assert SC.optical_scenes(archive.scenes, "2025-01-01", "2025-01-03", 100).count() == 2
    assert SC.optical_scenes(archive.scenes, "2025-01-01", "2025-02-01", 10).count() == 2


def test_fallback_only_when_allowed_and_empty(archive):
    empty = ("2020-01-01", "2020-02-01")
    assert SC.optical_scenes(archive.scenes, *empty).count() == 0
    assert SC.optical_scenes(archive.scenes, *empty, allow_fallback=True).count() == 6
    assert SC.radar_scenes(archive.scenes, *empty, allow_fallback=True).count() == 3
    assert SC.optical_scenes(archive.scenes, "2025-01-01", "2025-01-02", allow_fallback=True).count() == 1


def test_merging_nothing_is_an_error(archive):
    with pytest.raises(ValueError):
        SC.merge([])


def test_classified_area_does_not_depend_on_tiles(spark, archive, points):
    from dataclasses import replace

    from landsift.plans.features import training_sample

    model = make_classifier("knn", {"k": 3}).fit(training_sample(archive, points, WINTER), S.BANDS)
    area = [[(80.012, 23.011), (80.105, 23.02), (80.095, 23.1), (80.02, 23.09)]]
    runs = [sorted(map(tuple, classified_raster(replace(archive, tile_size=size), WINTER, model, area).select("x", "y", "classification").collect()), key=repr) for size in (3, 64)]
    assert runs[0] == runs[1] and len(runs[0]) > 40


def test_end_to_end(spark, archive, points, tmp_path):
    area = [[(80.0, 23.0), (80.12, 23.0), (80.12, 23.12), (80.0, 23.12)]]
    store = ModelStore(spark, str(tmp_path / "models"))
    result = classify_and_analyze(archive, points, WINTER, area, "cart", store=store)
    table = result.class_areas.collect()
    assert len(table) == 5 and sum(r["percentage"] for r in table) == pytest.approx(100, abs=0.05)
    total = result.summary.first()["total_pixels"]
    assert sum(r["pixel_count"] for r in table) == total > 60
    assert result.pixels.count() == 144
    path = str(tmp_path / "raster")
    sinks.write_raster(result.pixels, path, 8)
    back = spark.read.parquet(path)
    assert back.count() == 144 and back.select("tile_x", "tile_y").distinct().count() == 4


def test_sweep_keeps_going(spark, archive, points):
    models = {"CART": ("cart", {"maxNodes": 10, "minLeafPopulation": 1}), "broken": ("svm", {"kernelType": "RBF"})}
    rows = run_sweep(archive, points, {"none": ("2020-01-01", "2020-02-01"), "winter": ("2025-01-01", "2025-03-01")}, [15], models).collect()
    by = {(r["season"], r["classifier"]): r for r in rows}
    assert by["none", "CART"]["image_count"] == 0 and by["none", "CART"]["accuracy"] is None
    assert by["winter", "broken"]["accuracy"] is None and by["winter", "broken"]["image_count"] == 3
    assert by["winter", "CART"]["accuracy"] > 0.5 and by["winter", "CART"]["confusion_matrix"].startswith("[[")


def test_a_sweep_keeps_narrow_columns_and_lets_go_of_its_shuffles(spark, archive, points, monkeypatch):
    from landsift.plans import experiments
    from landsift.session import cut_lineage

    wide, let_go = [], []
    monkeypatch.setattr(experiments, "cut_lineage", lambda df: wide.append(set(df.columns)) or cut_lineage(df))
    monkeypatch.setattr(experiments, "release", let_go.append, raising=False)
    models = {"CART": ("cart", {"maxNodes": 10, "minLeafPopulation": 1})}
    rows = run_sweep(archive, points, {"none": ("2020-01-01", "2020-02-01"), "winter": ("2025-01-01", "2025-03-01")}, [15], models).collect()
    assert len(rows) == 2 and len(let_go) == 2
    assert not [c for c in wide if "scene_id" in c]


def test_stacks_share_rows(spark):
    scores = compare_stacks(blobs(spark), blobs(spark, 60, 6), {"both": ["a", "b"], "one": ["a"]}, "knn", {"k": 3}).collect()
    assert {r["stack"]: r["bands"] for r in scores} == {"both": 2, "one": 1} and all(r["accuracy"] > 0.8 for r in scores)


# ---- sinks and sources ----

def test_result_tables_round_trip(spark, tmp_path):
    rows = [("Winter", 5, "CART", 0.9, 0.8, "[[1]]", 3), ("Winter", 5, "k-NN", None, None, None, 0)]
    df = spark.createDataFrame(rows, S.SWEEP)
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert sorted(tables.read_sweep(spark, str(tmp_path / "csv")).collect(), key=repr) == sorted(df.collect(), key=repr)
    document = {"schema_version": "v", "runs": [{"model": "rf", "season": "winter", "stage": "after", "accuracy": 0.8, "kappa": 0.7}]}
    (tmp_path / "runs.json").write_text(json.dumps(document, indent=1))
    assert tables.read_runs(spark, str(tmp_path / "runs.json")).first()["accuracy"] == 0.8


def test_points_and_samples_keep_geometry(spark, points, tmp_path):
    for name in ("water", "forest"):
        points.limit(5).write.parquet(str(tmp_path / name))
    both = tables.read_points(spark, {n: str(tmp_path / n) for n in ("water", "forest")})
    assert {(r["source"], r["n"]) for r in both.groupBy("source").agg(F.count("*").alias("n")).collect()} == {("water", 5), ("forest", 5)}
    sinks.write_sample(points, str(tmp_path / "sample"))
    assert {"lon", "lat", "schema_version"} <= set(spark.read.parquet(str(tmp_path / "sample")).columns)


def test_finished_results_are_not_written_twice(spark, tmp_path):
    root = str(tmp_path)
    path = sinks.write_once(spark.range(3), root, "k1")
    assert sinks.write_once(spark.range(9), root, "k1") == path and spark.read.parquet(path).count() == 3
    os.remove(os.path.join(path, "_SUCCESS"))  # a write that never finished
    sinks.write_once(spark.range(9), root, "k1")
    assert spark.read.parquet(path).count() == 9


def test_report_is_valid_geojson(spark, tmp_path):
    from landsift.operators import areas

    image = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 4), (1, 1, None)], "x long, y long, classification int")
    shape = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'
    report = areas.geojson_report(shape, "rf", areas.area_summary(image), areas.class_area_table(image))
    sinks.write_report(report, str(tmp_path / "report"))
    body = json.loads(spark.read.text(str(tmp_path / "report")).first()["value"])
    assert body["geometry"] == json.loads(shape) and body["properties"]["summary"]["total_pixels"] == 3
    assert [a["pixel_count"] for a in body["properties"]["individual_class_areas"]] == [0, 2, 0, 0, 1]
    assert areas.dominant_class(areas.class_area_table(image)).first()["name"] == "Water"


def test_equal_rows_vote_alike_in_any_order(spark):
    rows = [(0.0, 0.0, 2), (0.0, 0.0, 0), (0.0, 0.0, 1), (5.0, 5.0, 1)]
    answers = set()
    for order in ([0, 1, 2, 3], [2, 1, 0, 3], [1, 2, 3, 0]):
        train = spark.createDataFrame([rows[k] for k in order], "a double, b double, label int")
        model = knn.KNearest(["a", "b"], 1).fit(train)
        answers.add(model.transform(spark.createDataFrame([(0.1, 0.0)], "a double, b double")).first()["classification"])
    assert answers == {0}


def test_model_key_follows_training_content(spark):
    points = blobs(spark, 30)
    same = points.repartition(3, "a")
    other = points.withColumn("label", 2 - F.col("label"))
    assert content_of(points) == content_of(same) != content_of(other)
    args = ("gtb", "a", "b", 15, False)
    keys = [model_key(*args, params=p, bands=b, content=(c,)) for p, b, c in (
        (None, ["a"], content_of(points)), (None, ["a"], content_of(other)), ({"k": 1}, ["a"], content_of(points)), (None, ["b"], content_of(points)))]
    assert len(set(keys)) == 4


def test_neighbour_models_are_saved_and_half_saved_ones_are_not_used(spark, tmp_path):
    calls = []

    def sample():
        calls.append(1)
        return blobs(spark)

    for _ in range(2):
        ModelStore(spark, str(tmp_path)).get("k", make_classifier("knn"), sample, ["a", "b"])
    assert calls == [1]
    os.remove(tmp_path / "k" / "complete")
    ModelStore(spark, str(tmp_path)).get("k", make_classifier("knn"), sample, ["a", "b"])
    assert calls == [1, 1]


def test_the_search_query_covers_the_whole_grid(spark, monkeypatch):
    from landsift.catalog import learning

    asked = {}

    def search(sample, bands, ident, grids, folds=5):
        asked.update(bands=bands, grids=grids, folds=folds)
        raise InterruptedError

    monkeypatch.setattr(learning, "_sides", lambda spark, d: (None, None))
    monkeypatch.setattr(learning, "grid_search", search)
    with pytest.raises(InterruptedError):
        learning.search_tree_settings(spark, "")
    assert asked == {"bands": learning.FEATURES, "grids": S.TUNING_GRIDS, "folds": 5}


def test_the_sweep_query_covers_every_limit_season_and_model(spark, monkeypatch):
    from landsift.catalog import learning

    asked = {}
    monkeypatch.setattr(learning, "archive", lambda spark, d: None)
    monkeypatch.setattr(learning.fx, "points", lambda spark, d: spark.createDataFrame([(1, 2)], "point_id int, label int"))
    monkeypatch.setattr(learning, "run_sweep", lambda archive, points, seasons, clouds, models=None: asked.update(seasons=seasons, clouds=clouds, models=models))
    learning.sweep_runs(spark, "")
    assert asked["clouds"] == S.SWEEP_CLOUDS and asked["models"] in (None, S.SWEEP_MODELS) and set(S.SWEEP_SEASONS) <= set(asked["seasons"])


def test_queries_use_the_shipped_models(spark, monkeypatch):
    from landsift.catalog import learning

    asked = []

    def note(model, params=None):
        asked.append((S.normalise_model(model), params))
        raise InterruptedError

    monkeypatch.setattr(learning, "_sides", lambda spark, d: (None, None))
    monkeypatch.setattr(learning, "_stack_sides", lambda spark, d: (None, None))
    monkeypatch.setattr(learning, "archive", lambda spark, d: None)
    monkeypatch.setattr(learning.fx, "points", lambda spark, d: spark.createDataFrame([(1, 2)], "point_id int, label int"))
    monkeypatch.setattr(learning, "make_classifier", note)
    monkeypatch.setattr(learning, "compare_stacks", lambda train, test, stacks, model, params=None: note(model, params))
    monkeypatch.setattr(learning, "leave_one_out", lambda train, test, bands, model, params=None: note(model, params))
    monkeypatch.setattr(learning, "classify_and_analyze", lambda archive, points, request, rings, model=S.DEFAULT_MODEL, params=None, smoothing=True: note(model, params))
    for name in ("random_forest", "boosted_trees", "feature_stacks_compared", "band_left_out", "classified_area", "classified_area_table"):
        with pytest.raises(InterruptedError):
            getattr(learning, name)(spark, "")
    assert asked == [("rf", None), *[(S.DEFAULT_MODEL, None)] * 5]
