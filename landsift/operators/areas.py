"""Class areas of a classified raster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landsift import schema as S
from landsift.functions import keys as K
from landsift.operators import pyramid


def class_histogram(classified: DataFrame) -> DataFrame:
    """Pixels per class; masked pixels are not counted."""
    return classified.filter("classification IS NOT NULL").groupBy("classification").agg(F.count("*").alias("pixel_count"))


def grouped_area(classified: DataFrame, scale_m: int = 10, base_m: int = 10) -> DataFrame:
    """Summed area per class at the given pixel size, each coarser pixel going to its majority class."""
    return pyramid.area_by_scale(classified, [scale_m], base_m).select("class_id", "area_sqm")


def class_area_table(classified: DataFrame) -> DataFrame:
    """All classes with pixels, m2, hectares, acres and percent; absent ones are zero."""
    classes = S.class_table(classified.sparkSession)
    counts = class_histogram(classified).withColumnRenamed("classification", "class_id")
    everything = W.partitionBy()  # five rows at most
    full = classes.join(counts, "class_id", "left").withColumn("pixel_count", F.coalesce("pixel_count", F.lit(0)))
    sqm = F.col("pixel_count") * S.PIXEL_AREA_SQM
    return full.withColumn("whole", F.sum(sqm).over(everything)).select(
        "class_id", "name", "color", "description", "pixel_count",
        F.round(sqm, 2).alias("area_sqm"), F.round(K.hectares(sqm), 4).alias("area_ha"),
        F.round(K.acres(sqm), 4).alias("area_acres"), F.round(K.percentage(sqm, F.col("whole")), 2).alias("percentage"),
    )


def area_summary(classified: DataFrame) -> DataFrame:
    total = classified.agg(F.count("classification").alias("total_pixels"))
    sqm = F.col("total_pixels") * S.PIXEL_AREA_SQM
    return total.select(
        "total_pixels", F.round(sqm, 2).alias("total_area_sqm"), F.round(K.hectares(sqm), 4).alias("total_area_ha"),
        F.round(K.acres(sqm), 4).alias("total_area_acres"),
    )


def dominant_class(class_areas: DataFrame) -> DataFrame:
    """The class with the largest share, the first one on a tie."""
    first = F.struct(F.col("percentage"), (-F.col("class_id")).alias("rank"))
    return class_areas.agg(F.max_by(F.struct("name", "percentage"), first).alias("top")).select(
        K.display_name(F.col("top.name")).alias("name"), F.col("top.percentage").alias("percentage")
    )


def geojson_report(geometry: str, model_id: str, summary: DataFrame, class_areas: DataFrame) -> DataFrame:
    """One GeoJSON feature with the model, the totals and the class areas."""
    name, kind, _ = S.MODELS[S.normalise_model(model_id)]
    listed = class_areas.agg(F.array_sort(F.collect_list(F.struct(*class_areas.columns))).alias("areas"))
    model = F.struct(F.lit(model_id).alias("id"), F.lit(name).alias("name"), F.lit(kind).alias("type"))
    properties = F.struct(
        model.alias("model"), F.struct(*summary.columns).alias("summary"), listed.scalar().alias("individual_class_areas")
    )
    shape = F.from_json(F.lit(geometry), "struct<type:string,coordinates:string>")
    body = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"'), shape["type"], F.lit('","coordinates":'), shape["coordinates"],
        F.lit('},"properties":'), F.to_json(properties), F.lit("}"),
    )
    return summary.select(body.alias("value"))
