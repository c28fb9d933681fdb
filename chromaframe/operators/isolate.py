"""Band isolation and point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def isolate_bands(bands: DataFrame, selected: list[int]) -> DataFrame:
    """Selected bands keep their colour; the others turn mostly gray and darker."""
    gray = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    keep = F.col("band").isin(*selected) if selected else F.lit(False)
    dim = {c: F.when(keep, F.col(c)).otherwise(F.floor(F.round((gray * 0.85 + F.col(c) * 0.15) * 0.55, 9)).cast("int")) for c in ("r", "g", "b")}
    return bands.withColumns(dim)


def band_at(bands: DataFrame, taps: DataFrame, width: int, height: int) -> DataFrame:
    """Band under each tap (tap_id, image_id, u, v in 0..1): an equi-join on the pixel's index."""
    x = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.floor(F.col("u") * width).cast("int")))
    y = F.greatest(F.lit(0), F.least(F.lit(height - 1), F.floor(F.col("v") * height).cast("int")))
    return taps.withColumn("idx", (y * width + x).cast("int")).join(bands.select("image_id", "idx", "band"), ["image_id", "idx"])


def toggle(selected: str, band):
    """A focused band added to a set of bands, or taken out if it was in."""
    s = F.col(selected)
    return F.when(F.array_contains(s, band), F.array_remove(s, band)).otherwise(F.array_sort(F.array_union(s, F.array(band))))


def palette_sections(palette: DataFrame, limit: int | None = None) -> DataFrame:
    """Bands of a palette (image_id, idx, band) with the ordered indexes of their colours; negative bands are no section."""
    rows = palette.where("band >= 0") if limit is None else palette.where((F.col("band") >= 0) & (F.col("idx") < limit))
    return rows.groupBy("image_id", "band").agg(F.sort_array(F.collect_list("idx")).alias("members"))
