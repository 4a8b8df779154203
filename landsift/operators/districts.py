"""District splits, consensus labels and district-level uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift.functions.keys import random_column
from landsift.operators import regions as R

# Cumulative Poisson(1) probabilities: fixed values of the resampling weight.
POISSON_STEPS = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
]


def split_districts(districts: DataFrame, training: DataFrame, block_deg: float = 0.2, dev_share: float = 15 / 44, seed: int = 42) -> DataFrame:
    """Role of each district: withheld when a training point lies in it, else
    development or test, a whole spatial block going to one side."""
    holds = R.locate(training, districts, ["district_id"]).select("district_id").distinct()
    boxes = R.prepared(districts, ["district_id"]).select(
        "district_id",
        F.floor((F.col("west") + F.col("east")) / 2 / block_deg).alias("bx"),
        F.floor((F.col("south") + F.col("north")) / 2 / block_deg).alias("by"),
    )
    block = F.concat_ws("_", F.col("bx"), F.col("by"))
    drawn = random_column(block, seed)
    role = F.when(F.col("held"), "withheld").when(drawn < dev_share, "development").otherwise("test")
    return boxes.join(holds.withColumn("held", F.lit(True)), "district_id", "left").select(
        "district_id", block.alias("block"), role.alias("role")
    )


def consensus(maps: DataFrame, columns: list[str], labels: list[int], min_votes: int) -> DataFrame:
    """Label on which at least ``min_votes`` maps agree, else NULL; ties to the smallest.

    Counting happens inside the row, so nothing is shuffled.
    """
    votes = [sum((F.coalesce((F.col(c) == k).cast("int"), F.lit(0)) for c in columns), F.lit(0)) for k in labels]
    most = F.greatest(*votes)
    winner = F.coalesce(*[F.when(v == most, F.lit(k)) for v, k in zip(votes, labels)])
    return maps.withColumn("votes", most).withColumn("consensus", F.when(F.col("votes") >= min_votes, winner))


def district_hits(assessed: DataFrame, models: list[str], by: list[str]) -> DataFrame:
    return assessed.groupBy(*by).agg(
        F.count("*").alias("total"), *[F.sum((F.col(m) == F.col("label")).cast("long")).alias(m) for m in models]
    )


def resampled(districts: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Districts repeated once per replicate with a Poisson(1) weight.

    The weight depends only on district, replicate and seed, so any task can
    draw it and a rerun gives the same replicates.
    """
    spread = districts.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = random_column(F.concat_ws(":", "district_id", "replicate"), seed)
    weight = sum(((F.col("u") >= step).cast("int") for step in POISSON_STEPS), F.lit(0))
    return spread.withColumn("u", u).withColumn("weight", weight).drop("u")


def interval(values: DataFrame, column: str, by: list[str], level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    q = F.percentile(column, F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)))
    return values.groupBy(*by).agg(q.alias("q")).select(
        *by, F.col("q")[0].alias("low"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("high")
    )


def accuracy_interval(assessed: DataFrame, model: str, replicates: int = 200, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Accuracy with an interval from resampling whole districts."""
    by = by or []
    hits = district_hits(assessed, [model], [*by, "district_id"])
    drawn = resampled(hits, replicates, seed)
    scores = drawn.groupBy(*by, "replicate").agg(
        F.try_divide(F.sum(F.col("weight") * F.col(model)).cast("double"), F.sum(F.col("weight") * F.col("total"))).alias("accuracy")
    )
    return interval(scores, "accuracy", by)


def district_differences(assessed: DataFrame, first: str, second: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    hits = district_hits(assessed, [first, second], [*by, "district_id"])
    return hits.select(*by, "district_id", ((F.col(first) - F.col(second)).cast("double") / F.col("total")).alias("difference"))


def paired_interval(assessed: DataFrame, first: str, second: str, replicates: int = 200, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Mean per-district difference of two models with its interval."""
    by = by or []
    drawn = resampled(district_differences(assessed, first, second, by), replicates, seed)
    means = drawn.groupBy(*by, "replicate").agg(
        F.try_divide(F.sum(F.col("weight") * F.col("difference")), F.sum("weight").cast("double")).alias("difference")
    )
    return interval(means, "difference", by)


def strata(assessed: DataFrame, mapped: DataFrame, model: str) -> DataFrame:
    """(district, mapped class) strata by reference label with the area weight."""
    cells = assessed.groupBy("district_id", F.col(model).alias("mapped_class"), "label").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("district_id", "mapped_class").agg(F.sum("n").alias("n_stratum"))
    sampled = mapped.join(sizes, ["district_id", "mapped_class"])
    weight = F.col("area") / sampled.agg(F.sum("area")).scalar()
    return cells.join(sampled.withColumn("weight", weight), ["district_id", "mapped_class"])


def area_adjusted(assessed: DataFrame, mapped: DataFrame, model: str) -> DataFrame:
    """Overall accuracy reweighted by mapped area, with its standard error."""
    s = strata(assessed, mapped, model)
    hit = F.when(F.col("label") == F.col("mapped_class"), F.col("n")).otherwise(0)
    per = s.groupBy("district_id", "mapped_class").agg(
        F.first("weight").alias("weight"), F.first("n_stratum").alias("n"), F.sum(hit).alias("hits")
    ).withColumn("p", F.col("hits") / F.col("n"))
    spread = F.coalesce(F.try_divide(F.col("p") * (1 - F.col("p")), F.col("n") - 1), F.lit(0.0))
    return per.agg(
        F.sum(F.col("weight") * F.col("p")).alias("accuracy"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight") * spread)).alias("standard_error"),
        F.count("*").alias("strata"),
    )


def area_adjusted_classes(assessed: DataFrame, mapped: DataFrame, model: str) -> DataFrame:
    """Area share and area-adjusted user's and producer's accuracy per class."""
    s = strata(assessed, mapped, model).withColumn("p", F.col("weight") * F.col("n") / F.col("n_stratum"))
    hit = F.when(F.col("label") == F.col("mapped_class"), F.col("p")).otherwise(0.0)
    truth = s.groupBy(F.col("label").alias("class_id")).agg(F.sum("p").alias("area_share"), F.sum(hit).alias("hits"))
    drawn = s.groupBy(F.col("mapped_class").alias("class_id")).agg(F.sum("p").alias("mapped_share"))
    return truth.join(drawn, "class_id", "left").select(
        "class_id", "area_share", F.try_divide("hits", "mapped_share").alias("users"), F.try_divide("hits", "area_share").alias("producers")
    )


def composite_depth(pixels: DataFrame, districts: DataFrame, band: str, cell_deg: float = 0.1) -> DataFrame:
    """Valid observations reaching the median, per district (pixels need lon, lat).

    Observations are counted per pixel first, so the polygon test runs once a pixel.
    """
    depth = pixels.groupBy("x", "y", "lon", "lat").agg(F.count(band).alias("valid"))
    placed = R.locate(depth, districts, ["district_id"], cell_deg)
    return placed.groupBy("district_id").agg(
        F.count("*").alias("pixels"), F.sum("valid").alias("valid"), F.avg("valid").alias("mean_depth"),
        F.min("valid").alias("min_depth"), F.max("valid").alias("max_depth"),
    )


def recall_by_distance(assessed: DataFrame, model: str, distance_km: Column) -> DataFrame:
    """Change of recall per 100 km from the labelled area, per class, over districts."""
    recall = assessed.groupBy("district_id", "label", distance_km.alias("km")).agg(
        F.avg((F.col(model) == F.col("label")).cast("double")).alias("recall")
    )
    return recall.groupBy("label").agg(
        F.count("*").alias("districts"), F.regr_slope("recall", F.col("km") / 100).alias("slope_per_100km"),
        F.avg("recall").alias("mean_recall"),
    )
