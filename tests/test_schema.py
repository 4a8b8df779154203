import pytest

from landsift import schema as S
from landsift.functions import keys as K
from landsift.operators import quality
from pyspark.sql import functions as F


def test_five_classes_in_order():
    assert [(r[0], r[1]) for r in S.CLASSES] == [
        (0, "Vegetation"), (1, "Water"), (2, "Built Area"), (3, "Open Land"), (4, "Agriculture")]


def test_stacks_are_unique_and_inside_the_full_inventory():
    assert {n: len(S.band_stack(n)) for n in S.BAND_STACKS} == {"b27": 27, "b22": 22, "b19": 19, "production": 19}


def test_version_names_the_band_count(spark):
    row = spark.range(1).select(K.version_band_count(F.lit(S.SCHEMA_VERSION)).alias("n")).first()
    assert row["n"] == len(S.BANDS)


def test_seasons_are_exact_and_equal(spark):
    rows = quality.window_check(S.season_table(spark)).collect()
    assert {r["season"]: (str(r["start_date"]), str(r["end_date"]), r["ok"]) for r in rows} == {
        "winter": ("2025-01-01", "2025-03-01", True), "summer": ("2025-04-01", "2025-05-30", True)}


def test_model_ids():
    assert S.normalise_model("XGB") == "gtb" and S.DEFAULT_MODEL == "gtb"
    with pytest.raises(ValueError):
        S.normalise_model("lightgbm")


def test_mixed_versions_are_refused(spark):
    df = spark.range(2).toDF("v")
    assert quality.merge_results([quality.stamp(df), quality.stamp(df)]).count() == 4
    with pytest.raises(ValueError):
        quality.merge_results([quality.stamp(df), quality.stamp(df, "other-10-band")])


def test_unlabelled_source_is_an_error(spark):
    good = spark.createDataFrame([("water", 1), ("forest", 0)], "source string, label int")
    assert quality.require_labels(good).count() == 2
    with pytest.raises(ValueError, match="barren"):
        quality.require_labels(good.union(spark.createDataFrame([("barren", None)], "source string, label int")))
