"""Hash columns, content keys and small text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landsift import schema as S


def random_column(ident: Column, seed: int) -> Column:
    """Uniform 0-1 number that depends only on the row id and the seed.

    rand(seed) depends on the partitioning; this one survives a repartition.
    """
    digest = F.md5(F.concat_ws("|", ident.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def content_key(fields: dict[str, Column]) -> Column:
    """First 16 hex digits of the hash of the key-sorted JSON of the inputs."""
    payload = F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))
    return F.substring(F.sha1(payload), 1, 16)


def overlay_key(geometry: Column, model: Column, start: Column, end: Column, cloud: Column, smoothing: Column) -> Column:
    return content_key({
        "geometry": geometry, "model": F.lower(model), "start": start, "end": end,
        "cloud": cloud, "smoothing": smoothing, "schema": F.lit(S.SCHEMA_VERSION),
    })


def normalised_model(model: Column) -> Column:
    aliases = F.create_map(*[F.lit(v) for pair in S.MODEL_ALIASES.items() for v in pair])
    lowered = F.lower(model)
    return F.coalesce(aliases[lowered], lowered)


def model_key(model: Column, start: Column, end: Column, cloud: Column, fallback: Column) -> Column:
    """Key of one trained model; the area of interest is not part of it."""
    return F.struct(
        normalised_model(model).alias("model"), start.alias("start"), end.alias("end"),
        cloud.alias("cloud"), fallback.alias("fallback"), F.lit(S.SCHEMA_VERSION).alias("schema_version"),
    )


def display_name(name: Column) -> Column:
    current = F.create_map(*[F.lit(v) for pair in S.LEGACY_CLASS_NAMES.items() for v in pair])
    return F.coalesce(current[name], name)


def rgb(color: Column) -> dict[str, Column]:
    """Red, green and blue of ``#RRGGBB``."""
    code = F.ltrim(color, F.lit("#"))
    return {
        name: F.conv(F.substring(code, 1 + 2 * i, 2), 16, 10).cast("int")
        for i, name in enumerate(("red", "green", "blue"))
    }


def window_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def version_band_count(version: Column) -> Column:
    return F.regexp_extract(version, r"(\d+)-band", 1).cast("int")


def hectares(sqm: Column) -> Column:
    return sqm / S.SQM_PER_HECTARE


def acres(sqm: Column) -> Column:
    return sqm / S.SQM_PER_ACRE


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
