"""What leaves a study: the shown image with its overlays as files, and the report of its settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.operators import contours, lines, presets, tiles
from chromaframe.sources import imagefiles
from chromaframe.sources.raster import encode
from chromaframe.sources.store import stored

#: Pixels of the largest images whose lines get their colours in the group that draws them.
WHOLE = 512 * 512


def exported(original: DataFrame, shown: DataFrame, original_mode: bool, grid: DataFrame | None = None, contours: DataFrame | None = None, grid_opacity: float = 0.7, contour_opacity: float = 0.7) -> DataFrame:
    """Pixels of an export: the original in original mode, else what is shown; over it the coloured lines of the grid, then those of contours."""
    out = original if original_mode else shown
    for overlay, opacity in ((grid, grid_opacity), (contours, contour_opacity)):
        if overlay is not None:
            out = tiles.drawn(out, overlay, opacity)
    return out


def write_pngs(pixels: DataFrame, path: str, mode: str = "append") -> None:
    """Every image as ``<image_id>.png`` in a folder; all of them or none."""
    imagefiles.write_images(encode(pixels).select(F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("name"), "content"), path, mode)


def contour_lines(pixels: DataFrame, levels: int = 5, cutoff: float = 1.0, style: str = "auto", custom: str = "#000000FF", size: int = 201) -> DataFrame:
    """Coloured contour lines (image_id, kind, i, j, run, x0, y0, x1, y1, color) of the depth of images.

    Depth is resampled to ``size`` x ``size`` points; levels lie evenly between an image's least depth and the lesser of its greatest and ``cutoff``; cells
    wholly behind ``cutoff`` have no lines; crossings are joined into chains and bent. An image whose depth lies all behind the cutoff, or in one value,
    has no contours. ``i`` numbers an image's chains through all its levels, ``j`` the pieces of a chain.

    An image is one group of the pixels that its points are made from, at most three rows and columns of each point; one of at most ``WHOLE`` pixels goes
    there whole, and its lines get their colours at once. Those of larger ones get them by a join with pixels.
    """
    known = F.col("depth").isNotNull()
    ends = {"mx": F.max("x"), "my": F.max("y"), "wide": F.max(F.when(known, F.col("x"))), "high": F.max(F.when(known, F.col("y"))), "lo": F.min("depth") / 255.0, "hi": F.least(F.max("depth") / 255.0, C.num(cutoff))}
    sizes = stored(pixels.groupBy("image_id").agg(*[v.alias(c) for c, v in ends.items()]).where("hi > lo"), "image-sizes")
    light = C.dot((0.2126, 0.7152, 0.0722), C.linear_rgb(F.col("r"), F.col("g"), F.col("b")))
    shown = pixels.select("image_id", "x", "y", (F.col("depth") / 255.0).alias("v"), *([light.alias("light")] if style == "auto" else []))
    needed = F.col("v").isNotNull() & contours.read(F.col("x"), F.col("wide"), size) & contours.read(F.col("y"), F.col("high"), size)

    def drawn(those: DataFrame, whole: bool) -> DataFrame:
        placed = shown.join(those.hint("merge"), "image_id")
        found = contours.contours(placed if whole else placed.where(needed).drop("light"), levels, cutoff, size, whole)
        return found.select("image_id", F.lit("contour").alias("kind"), *found.columns[1:])

    if style != "auto":
        return lines.line_colors(drawn(sizes, False), pixels, style, custom)
    area = (F.col("mx").cast("long") + 1) * (F.col("my") + 1)
    color = F.when(F.col("black"), "#000000FF").otherwise("#FFFFFFFF").alias("color")
    found = drawn(sizes.where(area <= WHOLE), True).select("image_id", "kind", "i", "j", "run", "x0", "y0", "x1", "y1", color)
    large = sizes.where(area > WHOLE)
    if large.isEmpty():
        return found
    return found.unionByName(lines.line_colors(drawn(large, False), pixels.join(large.select("image_id").hint("merge"), "image_id", "left_semi")))


#: Sections of the report with the labels of their lines, in order; a line without a label is its value.
SECTIONS = [
    ("Application", [("", "software")]),
    ("Mode", [("", "mode")]),
    ("Background", [("Enabled", "background_enabled"), ("Mode", "background_mode"), ("Foreground Cutoff", "foreground_cutoff"), ("Background Cutoff", "background_cutoff"), ("Intensity", "depth_intensity")]),
    ("Simplification", [("Method", "abstraction_method"), ("Strength", "abstraction_strength")]),
    ("Grayscale Conversion", [("", "grayscale")]),
    ("Limit Colors / Values", [("Values", "value_levels"), ("Value Bias", "value_bias"), ("Colors", "color_limit"), ("Color Bias", "color_bias")]),
    ("Palette Selection", [("Enabled", "palette_enabled"), ("Spread", "palette_spread"), ("Max Pigments per Mix", "most_pigments"), ("Min Concentration", "least_concentration"), ("Pigments", "pigments")]),
    ("Contours", [("Enabled", "contour_enabled"), ("Levels", "contour_levels"), ("Line Style", "contour_style"), ("Color", "contour_color"), ("Opacity", "contour_opacity")]),
    ("Grid", [("Enabled", "grid_enabled"), ("Divisions", "grid_divisions"), ("Diagonals", "grid_diagonals"), ("Line Style", "grid_style"), ("Color", "grid_color"), ("Opacity", "grid_opacity")]),
]
#: Lines whose numbers carry a sign; of these, the biases also have a name.
SIGNED, BIASES = {"value_bias", "color_bias", "palette_spread"}, {"value_bias", "color_bias"}


def signed_text(v: Column) -> Column:
    """A number with up to three decimals and its sign; zero has none."""
    return F.when(F.round(v, 3) == 0, F.lit("0")).otherwise(presets.scalar_text(v, 3, True))


def bias_name(bias: Column) -> Column:
    return F.when(F.abs(bias) < 0.04, "Even").when(bias < 0, "Light Detail").otherwise("Shadow Detail")


def _value(column: str, kind: str) -> Column:
    v = F.col(column)
    if column == "pigments":  # of (id, name), in their own order
        named = F.transform(v, lambda p: F.concat(F.coalesce(p["name"], p["id"]), F.lit(" ["), p["id"], F.lit("]")))
        return F.concat(F.lit("("), F.size(v).cast("string"), F.lit("): "), F.array_join(named, ", "))
    if kind == "boolean":
        return presets.on_off(v)
    if kind in ("double", "float"):
        text = signed_text(v.cast("double")) if column in SIGNED else presets.scalar_text(v.cast("double"), 3)
        return F.concat(bias_name(v), F.lit(" ("), text, F.lit(")")) if column in BIASES else text
    return v.cast("string")


def export_report(settings: DataFrame, palette: DataFrame | None = None) -> DataFrame:
    """The settings of every study (image_id and the columns that ``SECTIONS`` names) as text, then the lines of its palette (image_id, recipe_id, line) if it has one.

    A null setting is an empty value.
    """
    kinds = dict(settings.dtypes)
    blocks = []
    for title, rows in SECTIONS:
        text = [F.concat(F.lit(label + (" " if c == "pigments" else ": ") if label else ""), F.coalesce(_value(c, kinds[c]), F.lit(""))) for label, c in rows]
        blocks.append(F.concat_ws("\n", F.lit(title), *text))
    report = settings.select("image_id", F.concat_ws("\n\n", *blocks).alias("report"))
    if palette is None:
        return report
    swatches = palette.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("recipe_id", "line"))).alias("lines"))
    tail = F.concat_ws("\n", F.lit("Generated Palette"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return report.join(swatches, "image_id", "left").select("image_id", F.concat_ws("\n\n", "report", F.when(F.col("lines").isNotNull(), tail)).alias("report"))
