"""Depth statistics and depth-driven effects. Depth bytes: 0 near, 255 far."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaframe.functions import color as C


def value_counts(pixels: DataFrame) -> DataFrame:
    """Pixels per image and depth byte: at most 256 rows an image, from which all other statistics follow."""
    return pixels.groupBy("image_id", "depth").agg(F.count(F.lit(1)).alias("n"))


def depth_range(counts: DataFrame) -> DataFrame:
    """Smallest and largest depth in 0..1; a flat range is widened by a step around its centre."""
    eps = 1 / 255
    r = counts.groupBy("image_id").agg((F.min("depth") / 255.0).alias("lo"), (F.max("depth") / 255.0).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    centre = (lo + hi) * 0.5
    flat = hi - lo < eps
    return r.select(
        "image_id", F.when(flat, F.greatest(C.num(0), centre - eps * 0.5)).otherwise(lo).alias("lo"), F.when(flat, F.least(C.num(1), centre + eps * 0.5)).otherwise(hi).alias("hi")
    )


def percentiles(counts: DataFrame, ranks: list[float]) -> DataFrame:
    """Nearest-rank percentiles: the value at index round((n - 1) * p) of the sorted values."""
    up = Window.partitionBy("image_id").orderBy("depth")
    whole = Window.partitionBy("image_id")
    cum = counts.select("image_id", "depth", F.sum("n").over(up).alias("upto"), F.sum("n").over(whole).alias("total"))
    ps = cum.select("*", F.explode(F.array(*[C.num(p) for p in ranks])).alias("p"))
    at = F.floor((F.col("total") - 1) * F.col("p") + 0.5)
    return ps.where(F.col("upto") > at).groupBy("image_id", "p").agg(F.min("depth").alias("depth"))


def histogram(counts: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """Counts in equal bins over a domain; values outside are skipped but stay in the total."""
    v = F.col("depth") / 255.0
    inside = (v >= lo) & (v <= hi)
    bin_of = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.round((v - lo) / (hi - lo) * bins, 9)).cast("int")))
    got = counts.where(inside).groupBy("image_id", bin_of.alias("bin")).agg(F.sum("n").alias("n"))
    images = counts.groupBy("image_id").agg(F.sum("n").alias("total"))
    every = images.select("image_id", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(got, ["image_id", "bin"], "left").select("image_id", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("cnt"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def tail(counts: DataFrame, bounds: tuple[int, ...] = (250, 254)) -> DataFrame:
    return counts.groupBy("image_id").agg(*[F.sum(F.when(F.col("depth") >= b, F.col("n")).otherwise(0)).cast("long").alias(f"n_{b}") for b in bounds])


def top_values(counts: DataFrame, k: int = 6) -> DataFrame:
    """The most frequent depths above 0, ties to the smaller."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "depth"))
    return counts.where("depth > 0").withColumn("rank", rank).where(F.col("rank") <= k).select("image_id", "rank", "depth", F.col("n").alias("cnt"))


def coverage(counts: DataFrame, cutoff: float) -> DataFrame:
    """Share of pixels at or beyond a cutoff."""
    far = F.sum(F.when(F.col("depth") >= int(255 * cutoff + 0.5), F.col("n")).otherwise(0))
    return counts.groupBy("image_id").agg((far / F.sum("n")).alias("share"))


def accepted(counts: DataFrame) -> DataFrame:
    """Whether embedded depth is usable: enough values above 0, and more than a flat range."""
    nonzero = counts.groupBy("image_id").agg((F.sum(F.when(F.col("depth") > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("nonzero"))
    r = depth_range(counts).join(nonzero, "image_id")
    return r.select("image_id", ((F.col("nonzero") >= 0.001) & (F.round(F.col("hi") - F.col("lo"), 9) >= round(2 / 255, 9))).alias("accepted"))


def normalized(pixels: DataFrame, invert: bool = False, least: int = 32) -> DataFrame:
    """Depth over its 0.5 to 99.8 percentile window, clamped, to the power 0.92; zero stays zero."""
    counts = value_counts(pixels.where("depth > 0"))
    window = percentiles(counts, [0.005, 0.998]).groupBy("image_id").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    enough = counts.groupBy("image_id").agg(F.sum("n").alias("valid")).where(F.col("valid") > least)
    t = C.clamp((F.col("depth") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), C.num(1e-6)))
    v = F.pow(t, C.num(0.92))
    v = 1.0 - v if invert else v
    joined = pixels.join(window.join(enough, "image_id"), "image_id")
    return joined.select("image_id", "idx", F.when(F.col("depth") > 0, C.to_byte(F.round(v, 9))).otherwise(0).alias("depth"))


def finite(samples: DataFrame) -> DataFrame:
    """Samples (image_id, idx, v) with a finite value above 0."""
    return samples.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") > 0) & (F.col("v") < float("inf")))


def float_range(samples: DataFrame) -> DataFrame:
    """Smallest, largest and mean finite value of each image."""
    return samples.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))).groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))


def normalized_floats(samples: DataFrame, disparity: bool = False, least: int = 32) -> DataFrame:
    """Depth bytes of float samples (image_id, idx, v) over the 0.5 to 99.8 percentile window of the valid ones, to the power 0.92.

    Disparity is turned round; invalid samples are 0; images with at most ``least`` valid ones have no depth.
    """
    valid = finite(samples)
    counts = valid.groupBy("image_id", F.col("v").alias("depth")).agg(F.count(F.lit(1)).alias("n"))
    window = percentiles(counts, [0.005, 0.998]).groupBy("image_id").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    enough = counts.groupBy("image_id").agg(F.sum("n").alias("valid")).where(F.col("valid") > least)
    joined = samples.join(window.join(enough, "image_id"), "image_id")
    t = C.clamp((F.col("v") - F.col("lo")) / (F.greatest(F.col("hi"), F.col("lo") + 1e-8) - F.col("lo")))
    curved = F.pow(t, C.num(0.92))
    mapped = 1.0 - curved if disparity else curved
    ok = F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") > 0) & (F.col("v") < float("inf"))
    return joined.select("image_id", "idx", F.when(ok, C.to_byte(F.round(mapped, 9))).otherwise(0).alias("depth"))


def cutoffs(ranges: DataFrame) -> DataFrame:
    """Foreground and background cutoffs at the thirds of the range."""
    span = F.greatest(F.col("hi") - F.col("lo"), C.num(1 / 255))
    return ranges.select("image_id", (F.col("lo") + span / 3.0).alias("foreground"), (F.col("lo") + span * 2.0 / 3.0).alias("background"))


def synced(lo: Column, hi: Column, foreground: Column, background: Column) -> tuple[Column, Column]:
    """Cutoffs kept within a range and in order."""
    f, b = F.least(hi, F.greatest(lo, foreground)), F.least(hi, F.greatest(lo, background))
    return F.least(f, b), F.greatest(f, b)


def painterly(pixels: DataFrame, foreground: float, background: float, intensity: float, compress: bool = True) -> DataFrame:
    """Near pixels gain contrast, chroma and warmth; far ones lose contrast and chroma and turn cooler."""
    d = F.col("depth") / 255.0
    light, a, b = C.oklab(F.col("r"), F.col("g"), F.col("b"))
    near = 1.0 - C.smoothstep(C.num(0), C.num(foreground), d)
    far = C.smoothstep(C.num(background), C.num(1), d)
    stage = pixels.select("image_id", "idx", light.alias("l"), a.alias("a"), b.alias("b"), near.alias("near"), far.alias("far"))
    light, a, b, t = F.col("l"), F.col("a"), F.col("b"), F.col("near")
    s = t * intensity
    scale = C.mix(C.num(1), 1.0 + 0.3 * s, t)
    stage = stage.select("image_id", "idx", "far", C.mix(light, 0.5 + (light - 0.5) * (1.0 + 0.4 * s), t).alias("l"), (a * scale + 0.005 * s).alias("a"), (b * scale + 0.015 * s).alias("b"))
    if compress:
        t = F.col("far")
        s = t * intensity
        scale = C.mix(C.num(1), 1.0 - 0.5 * s, t)
        dull = 1.0 - 0.3 * s
        stage = stage.select(
            "image_id", "idx", C.mix(light, 0.5 + (light - 0.5) * (1.0 - 0.5 * s), t).alias("l"), ((a * scale + 0.003 * s) * dull).alias("a"), ((b * scale - 0.02 * s) * dull).alias("b")
        )
    return stage.select("image_id", "idx", *[C.rounded(c).alias(n) for n, c in zip(C.LAB, (C.clamp(light), a, b), strict=True)])


def remove_background(pixels: DataFrame, background: float, intensity: float) -> DataFrame:
    """Far pixels fade to white over a soft edge."""
    t = C.smoothstep(C.num(background - 0.03), C.num(background + 0.03), F.col("depth") / 255.0) * intensity
    return pixels.withColumns({c: F.floor(F.round(C.mix(F.col(c).cast("double"), C.num(255), t) + 0.5, 9)).cast("int") for c in ("r", "g", "b")})


def threshold_preview(pixels: DataFrame, background: float) -> DataFrame:
    """Pixels beyond the cutoff show their depth as gray."""
    t = C.smoothstep(C.num(background - 0.01), C.num(background + 0.01), F.col("depth") / 255.0)
    return pixels.withColumns({c: F.floor(F.round(C.mix(F.col(c).cast("double"), F.col("depth").cast("double"), t) + 0.5, 9)).cast("int") for c in ("r", "g", "b")})


def hard_preview(pixels: DataFrame, background: float) -> DataFrame:
    """The preview without a soft edge: depth as gray from the cutoff's byte on."""
    far = F.col("depth") >= max(0, min(255, int(background * 255 + 0.5)))
    return pixels.withColumns({c: F.when(far, F.col("depth")).otherwise(F.col(c)) for c in ("r", "g", "b")})


def simple_effect(pixels: DataFrame, foreground: float, background: float, intensity: float, remove: bool = False) -> DataFrame:
    """The depth effect in plain RGB: nearer pixels gain saturation and warmth, farther ones lose them or fade to white; bytes are cut off."""
    d = F.col("depth") / 255.0
    t = F.least((d - background) / max(0.05, 1.0 - background), C.num(1))
    far = d > background
    stage = pixels.withColumns({c: F.col(c) / 255.0 for c in ("r", "g", "b")})
    if remove:
        blend = t * intensity
        stage = stage.withColumns({c: F.when(far, F.col(c) * (1.0 - blend) + blend).otherwise(F.col(c)) for c in ("r", "g", "b")})
    stage = stage.withColumn("lum", C.dot((0.2126, 0.7152, 0.0722), [F.col(c) for c in ("r", "g", "b")]))
    near = (1.0 - d / max(foreground, 0.001)) * (intensity * 0.3)
    away = t * (intensity * 0.3)
    warm, cool = {"r": 0.02, "g": 0.0, "b": -0.02}, {"r": -0.02, "g": 0.0, "b": 0.03}

    def moved(c: str) -> Column:
        v, lum = F.col(c), F.col("lum")
        out = F.when(d < foreground, lum + (v - lum) * (1.0 + near) + near * warm[c])
        return out.otherwise(v) if remove else out.when(far, lum + (v - lum) * (1.0 - away) + away * cool[c]).otherwise(v)

    bytes_ = {c: F.greatest(C.num(0), F.least(C.num(255), F.round(moved(c) * 255.0, 9))).cast("int") for c in ("r", "g", "b")}
    return stage.withColumns({f"_{c}": v for c, v in bytes_.items()}).withColumns({c: F.col(f"_{c}") for c in bytes_}).drop("lum", *[f"_{c}" for c in bytes_])


def effect(pixels: DataFrame, mode: str, foreground: float, background: float, intensity: float) -> DataFrame:
    """Pixels after a depth effect: "none" leaves them; "blur" and "remove" treat the background first; all others end in ``painterly``."""
    if mode == "none":
        return pixels
    if mode == "blur":
        for axis in ("x", "y"):
            pixels = pixels.drop("r", "g", "b").join(blurred(pixels, background, intensity, axis, halves=True), ["image_id", "idx"])
    elif mode == "remove":
        pixels = remove_background(pixels, background, intensity)
    elif mode != "compress":
        raise ValueError(f"unknown mode {mode!r}")
    lab = painterly(pixels, foreground, background, intensity, compress=mode == "compress")
    rgb = C.rgb_bytes([F.col(c) for c in C.LAB])
    new = lab.select("image_id", "idx", *[v.alias(c) for c, v in zip("rgb", rgb, strict=True)])
    return pixels.drop("r", "g", "b").join(new, ["image_id", "idx"]).select(*pixels.columns)


def resized(depths: DataFrame, pixels: DataFrame, exact: bool = True) -> DataFrame:
    """Depth bytes (image_id, x, y, depth) at the size of the images in ``pixels``: linear between the centres of their own places, halves up.

    Places have nine decimals and are summed as such, so no order of additions decides what is half. Not ``exact``: sums of doubles, always added row by row.
    """

    def size(of: DataFrame, *names: str) -> DataFrame:
        return of.groupBy("image_id").agg(*[(F.max(c) + 1).alias(n) for c, n in zip("xy", names, strict=True)])

    def corners(c: str, own: str, to: str) -> Column:
        """The two neighbours along one axis with their weights, one of them where they are the same place."""
        place = F.greatest(C.num(0), F.least(F.col(own) - 1.0, F.round((F.col(c) + 0.5) * F.col(own) / F.col(to) - 0.5, 9)))
        low = F.floor(place).cast("int")
        return F.filter(F.array(*[F.struct((low + n).alias("at"), (1.0 - F.abs(place - (low + n))).alias("w"), F.lit(n).alias("n")) for n in (0, 1)]), lambda e: e["w"] > 0)

    sizes = size(depths, "dw", "dh").join(size(pixels, "w", "h").hint("merge"), "image_id")
    rows = pixels.select("image_id", "x", "y").join(sizes.hint("merge"), "image_id")
    rows = rows.withColumn("cx", F.explode(corners("x", "dw", "w"))).withColumn("cy", F.explode(corners("y", "dh", "h")))
    share = (F.col(f"{c}.w").cast("decimal(10,9)" if exact else "double") for c in ("cx", "cy"))
    rows = rows.select("image_id", "x", "y", (next(share) * next(share)).alias("share"), (2 * F.col("cy.n") + F.col("cx.n")).alias("n"), F.col("cx.at").alias("dx"), F.col("cy.at").alias("dy"))
    own = depths.select("image_id", F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("depth").cast("decimal(3,0)" if exact else "double").alias("depth"))
    part = F.col("share") * F.col("depth")
    if exact:
        mixed = F.floor(F.round(F.sum(part), 9) + F.lit(Decimal("0.5")))
    else:
        a, b, c, e = (F.coalesce(F.sum(F.when(F.col("n") == n, part)), C.num(0)) for n in range(4))
        mixed = F.when(F.count("depth") > 0, F.floor(C.nanos(a + b + c + e) / 1e9 + 0.5))
    return rows.join(own.hint("merge"), ["image_id", "dx", "dy"]).groupBy("image_id", "x", "y").agg(mixed.cast("int").alias("depth"))


def embedded(samples: DataFrame) -> DataFrame:
    """Depth bytes (image_id, x, y, depth) of float samples (image_id, kind, idx, x, y, v): of an image's disparity, or else of its depth.

    A kind with too few valid samples is passed over; an image without any usable kind has no rows.
    """
    near, far = (normalized_floats(samples.where(F.col("kind") == k), k == "disparity") for k in ("disparity", "depth"))
    each = near.withColumn("kind", F.lit("disparity")).unionByName(far.withColumn("kind", F.lit("depth")))
    best = each.groupBy("image_id").agg(F.max("kind").alias("kind"))  # disparity comes after depth
    places = samples.select("image_id", "kind", "idx", "x", "y")
    return each.join(best, ["image_id", "kind"]).join(places, ["image_id", "kind", "idx"]).select("image_id", "x", "y", "depth")


def with_embedded(pixels: DataFrame, samples: DataFrame) -> DataFrame:
    """``pixels`` with the depth that came with their images, in their size; null where none did."""
    own = resized(embedded(samples), pixels)
    return pixels.drop("depth").join(own, ["image_id", "x", "y"], "left").select(*pixels.columns)


BLUR = 12
#: Side of the blocks that are blurred at once.
BLOCK = 256


def blurred(pixels: DataFrame, background: float, intensity: float, axis: str = "x", halves: bool = False) -> DataFrame:
    """One pass of a Gaussian blur whose radius grows with depth; along a row (x) or a column (y), clamped at the ends of the line's own pixels.

    Lines are cut into blocks; a pixel within the largest radius of a border also goes to the block behind it, so each block is one group of bounded size, blurred
    by arrays, one offset after the other. Places without a pixel have no weight. ``halves`` rounds to bytes, halves upwards.
    """
    line, along = ("y", "x") if axis == "x" else ("x", "y")
    t = C.clamp((F.col("depth") / 255.0 - background) / (1.0 - background + 1e-6))
    radius = F.floor(F.round(t * BLUR * intensity, 9)).cast("int")
    ends = pixels.groupBy("image_id", line).agg(F.min(along).alias("low"), F.max(along).alias("high"))
    home = F.floor(F.col(along) / BLOCK)
    blocks = F.array_distinct(F.array(*[F.floor((F.col(along) + o) / BLOCK) for o in (-BLUR, 0, BLUR)]))
    placed = pixels.select("image_id", "idx", F.col(line).alias("line"), F.col(along).alias("along"), radius.alias("radius"), "r", "g", "b", home.alias("home"), F.explode(blocks).alias("block"))
    placed = placed.join(ends.withColumnRenamed(line, "line"), ["image_id", "line"]).withColumn("band", F.floor(F.col("line") / BLOCK))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        line, along = group["line"].to_numpy(), group["along"].to_numpy()
        top, left = line.min(), along.min()
        known = np.zeros((line.max() - top + 1, along.max() - left + 1))
        values = np.zeros((*known.shape, 3))
        known[line - top, along - left] = 1
        values[line - top, along - left] = group[["r", "g", "b"]].to_numpy()
        own = group[(group["home"] == group["block"]).to_numpy()]
        line, along, reach = own["line"].to_numpy() - top, own["along"].to_numpy(), own["radius"].to_numpy()
        low, high = own["low"].to_numpy(), own["high"].to_numpy()
        total, weight = np.zeros((len(own), 3)), np.zeros(len(own))
        sigma = np.maximum(reach / 2.0, 1e-6)
        for o in range(-BLUR, BLUR + 1):
            i = np.flatnonzero(reach >= abs(o))
            if len(i):
                at = np.clip(along[i] + o, low[i], high[i]) - left
                w = np.exp(-(o * o) / (2.0 * sigma[i] * sigma[i])) * known[line[i], at]
                total[i] += w[:, None] * values[line[i], at]
                weight[i] += w
        out = total / weight[:, None]
        return pd.DataFrame({"image_id": own["image_id"], "idx": own["idx"], "r": out[:, 0], "g": out[:, 1], "b": out[:, 2]})

    soft = placed.groupBy("image_id", "band", "block").applyInPandas(run, "image_id bigint, idx int, r double, g double, b double")
    return soft.select("image_id", "idx", *[(F.floor(F.round(c, 6) + 0.5).cast("int") if halves else C.rounded(F.col(c), 6)).alias(c) for c in ("r", "g", "b")])
