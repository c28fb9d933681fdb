"""Grayscale and value studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaframe.functions import color as C

RGB = ("r", "g", "b")


def _rgb():
    return [F.col(c) for c in RGB]


def grayscale(pixels: DataFrame, conversion: str = "luminance") -> DataFrame:
    """Every pixel's gray byte; ``none`` keeps the colours."""
    if conversion == "none":
        return pixels
    return pixels.withColumn("gray", C.to_byte(C.gray_value(*_rgb(), conversion)))


def value_bands(pixels: DataFrame, levels: int = 4, bias: float = 0.0, conversion: str = "luminance") -> DataFrame:
    """Gray byte, band and the band's own gray; 2 to 8 levels."""
    levels = max(2, min(8, levels))
    gray = grayscale(pixels, "luminance" if conversion == "none" else conversion)
    return gray.withColumn("band", C.band_of_byte(F.col("gray"), C.thresholds(levels, bias))).withColumn("band_gray", C.band_gray(F.col("band"), levels))


def band_counts(bands: DataFrame, levels: int = 4) -> DataFrame:
    """Pixels per image and band, bands clamped to the levels."""
    return bands.groupBy("image_id", F.least(F.greatest(F.col("band"), F.lit(0)), F.lit(levels - 1)).alias("band")).agg(F.count(F.lit(1)).alias("cnt"))


def with_oklab(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns(dict(zip(C.LAB, C.oklab(*_rgb()), strict=True)))


def biased(lab: DataFrame, bias: float) -> DataFrame:
    """Lightness raised to the exponent of a luminance bias; colour stays."""
    e = C.exponent(bias)
    return lab if abs(e - 1) < 1e-4 else lab.withColumn("ok_l", F.pow(C.clamp(F.col("ok_l")), C.num(e)))


def lab_bands(lab: DataFrame, edges: list[float]) -> DataFrame:
    return lab.withColumn("band", C.band_of_value(F.col("ok_l"), edges))


def composite_label(family: str, value: str, values: int):
    return F.col(family) * values + F.col(value)


def with_gray_table(pixels: DataFrame, conversion: str = "average") -> DataFrame:
    """Gray bytes by tables: bytes to linear light by 256 entries, and back by 4097."""
    from_byte = F.array(*[C.num(v) for v in _linear_table()])
    to_byte = F.array(*[F.lit(v) for v in _byte_table()])
    lin = [F.element_at(from_byte, F.col(c) + 1) for c in RGB]
    mixed = (F.greatest(*lin) + F.least(*lin)) / 2.0 if conversion == "lightness" else (lin[0] + lin[1] + lin[2]) / 3.0
    return pixels.withColumn("gray", F.element_at(to_byte, F.floor(F.round(mixed * 4096, 9) + 0.5).cast("int") + 1))


def _linear_table() -> list[float]:
    return [v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4 for v in (i / 255 for i in range(256))]


def _byte_table() -> list[int]:
    return [int((v * 12.92 if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055) * 255 + 0.5) for v in (i / 4096 for i in range(4097))]


def as_clusters(bands: DataFrame, levels: int = 4) -> DataFrame:
    """Bands as clusters of equal salience: (image_id, k, gray, cnt, salience)."""
    counts = band_counts(bands, levels)
    return counts.select("image_id", F.col("band").alias("k"), C.band_gray(F.col("band"), levels).alias("gray"), "cnt", C.num(1).alias("salience"))


def display_names(colors: DataFrame) -> DataFrame:
    """``colors`` with the name of each colour as shown: its components r, g, b of 0..1 are rounded to bytes first; null where one is null."""
    own = colors.select(F.struct(*colors.columns).alias("own"), *[C.to_byte(F.round(c, 9)).alias(c) for c in ("r", "g", "b")])
    known = F.col("own.r").isNotNull() & F.col("own.g").isNotNull() & F.col("own.b").isNotNull()
    named = with_oklab(own).select("own", F.when(known, C.color_name(F.round("ok_l", 9), F.col("ok_a"), F.col("ok_b"))).alias("name"))
    return named.select(*[F.col("own")[c].alias(c) for c in colors.columns], "name")
