"""Per-pixel band arithmetic. A masked value is NULL and stays NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsift import schema as S


def clamp(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; least/greatest skip NULL, so it is guarded."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def unit_scale(value: Column, low: float, high: float) -> Column:
    return (value - low) / (high - low)


def to_unit(value: Column, low: float, high: float) -> Column:
    return clamp(unit_scale(value, low, high), 0.0, 1.0)


def rescale_bands(names: list[str]) -> dict[str, Column]:
    """Bands with a known range mapped onto 0-1; other bands are left out."""
    return {n: to_unit(F.col(n), *S.FEATURE_RANGES[n]) for n in names if n in S.FEATURE_RANGES}


def bit_is_clear(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(1 << bit)) == 0


def is_clear(qa: Column) -> Column:
    return bit_is_clear(qa, S.CLOUD_BIT) & bit_is_clear(qa, S.CIRRUS_BIT)


def masked_reflectance(band: str, qa: str = "QA60") -> Column:
    """Digital number to reflectance, NULL under cloud or cirrus."""
    return F.when(is_clear(F.col(qa)), F.col(band) / 10000)


def normalized_difference(a: str, b: str) -> Column:
    return F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b))


def core_indices() -> dict[str, Column]:
    nir, red = F.col("B8"), F.col("B4")
    return {
        "NDVI": normalized_difference("B8", "B4"),
        "NDWI": normalized_difference("B3", "B8"),
        "NDBI": normalized_difference("B11", "B8"),
        "SAVI": F.try_divide(1.5 * (nir - red), nir + red + 0.5),
    }


def bareness_indices() -> dict[str, Column]:
    """Bareness and built-up indices; the two open-ended ratios come rescaled."""
    b2, b3, b4 = F.col("B2"), F.col("B3"), F.col("B4")
    b8, b11, b12 = F.col("B8"), F.col("B11"), F.col("B12")
    built = F.try_divide(b11 * 2, b11 + b8)
    green = F.try_divide(b8, b8 + b4) + F.try_divide(b3, b3 + b11)
    swir_ratio = F.try_divide(b11, b12 + 1e-6)
    baei = F.try_divide(b4 + 0.3, b3 + b11 + 1e-6)
    return {
        "BSI": F.try_divide((b11 + b4) - (b8 + b2), b11 + b4 + b8 + b2),
        "UI": F.try_divide(b12 - b8, b12 + b8),
        "IBI": F.try_divide(built - green, built + green),
        "SWIRratio": to_unit(swir_ratio, *S.FEATURE_RANGES["SWIRratio"]),
        "BAEI": to_unit(baei, *S.FEATURE_RANGES["BAEI"]),
    }


def spectral_indices() -> dict[str, Column]:
    return {**core_indices(), **bareness_indices()}


def radar_bands() -> dict[str, Column]:
    """Backscatter in dB to 0-1. The ratio is a difference of decibels taken first."""
    vv, vh = F.col("VV"), F.col("VH")
    return {
        "VVVH": to_unit(vv - vh, -5.0, 20.0),
        "VV": to_unit(vv, -25.0, 5.0),
        "VH": to_unit(vh, -30.0, 0.0),
    }


def grey_level(value: Column, low: float, high: float, levels: int = S.GREY_LEVELS) -> Column:
    """Whole grey level 0..levels-1; the cast truncates."""
    return (to_unit(value, low, high) * (levels - 1)).cast("int")


def optical_grey(band: str = "B8") -> Column:
    return grey_level(F.col(band), 0.0, 0.5)


def radar_grey(band: str = "VV") -> Column:
    return grey_level(F.col(band), -25.0, 5.0)


def true_colour() -> dict[str, Column]:
    """Red, green, blue bytes of the 0-0.3 reflectance stretch."""
    pairs = {"red": "B4", "green": "B3", "blue": "B2"}
    return {name: (to_unit(F.col(b), 0.0, 0.3) * 255).cast("int") for name, b in pairs.items()}


def add_bands(image: DataFrame, bands: dict[str, Column], overwrite: bool = True) -> DataFrame:
    """Append bands; an existing name is replaced only when ``overwrite``."""
    taken = sorted(set(bands) & set(image.columns))
    if taken and not overwrite:
        raise ValueError(f"bands already present: {taken}")
    return image.withColumns(bands)


def add_expression(image: DataFrame, name: str, text: str, bindings: dict[str, str]) -> DataFrame:
    """Band from an expression string whose symbols are bound to bands."""
    bound = image.withColumns({symbol: F.col(band) for symbol, band in bindings.items()})
    return bound.withColumn(name, F.expr(text)).drop(*[s for s in bindings if s not in image.columns])


def constant_bands(values: dict[str, float | None], dtype: str = "double") -> dict[str, Column]:
    """Constant image: the same value in every pixel; None is a masked band."""
    return {name: F.lit(v).cast(dtype) for name, v in values.items()}
