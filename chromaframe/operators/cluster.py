"""Perceptual clustering: Oklab histogram, seeding, weighted Lloyd steps, assignment, cluster tables.

Pixels are reduced to at most 12 * 24 * 24 histogram bins an image before anything iterates, so the iterative steps run on a few
hundred rows per image (one group each), and pixels are touched again only by the final assignment, a projection.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.sources.store import fixed

BINS = (12, 24, 24)
RANGE_AB = 0.45
LAB = list(C.LAB)


def bin_index(light: Column, a: Column, b: Column) -> Column:
    """Bin number; components are floored and clamped into their bins. Rounding keeps the floor stable between engines."""

    def part(v: Column, lo: float, hi: float, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.round((v - lo) / (hi - lo) * n, 9)).cast("int")))

    i, j, k = part(light, 0.0, 1.0, BINS[0]), part(a, -RANGE_AB, RANGE_AB, BINS[1]), part(b, -RANGE_AB, RANGE_AB, BINS[2])
    return (i * BINS[1] + j) * BINS[2] + k


def histogram(lab: DataFrame, least: int | None = None) -> DataFrame:
    """Candidates per image: bin, mean colour, count and weight n * (1 + 2 * chroma), for bins with enough pixels.

    The least count is max(4, n / 100000). An image where no bin has that keeps its first pixel's colour with all its weight.
    """
    binned = lab.groupBy("image_id", bin_index(*[F.col(c) for c in LAB]).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in LAB], F.min(F.struct("idx", *LAB)).alias("first")
    )
    totals = binned.groupBy("image_id").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min("first").alias("first"))
    enough = F.greatest(F.lit(4), F.expr("total div 100000")) if least is None else F.lit(least)
    rows = binned.drop("first").join(totals, "image_id").withColumn("enough", enough)
    good = rows.where("n >= enough").select("image_id", "bin", "n", *LAB)
    bare = totals.withColumn("enough", enough).where("most < enough").select("image_id", F.lit(-1).alias("bin"), F.col("total").alias("n"), *[F.col(f"first.{c}").alias(c) for c in LAB])
    return good.unionByName(bare).withColumn("weight", F.when(F.col("bin") < 0, F.col("n").cast("double")).otherwise(F.col("n") * (1.0 + 2.0 * C.chroma(F.col("ok_a"), F.col("ok_b")))))


def coarse_histogram(lab: DataFrame) -> DataFrame:
    """Candidates by sums of whole bytes: L over 0..1, a and b over their range, each rounded to 0..255 before it is added; no least count."""

    def as_byte(c: str, lo: float, hi: float) -> Column:
        t = F.greatest(C.num(0), F.least(C.num(1), (F.col(c) - lo) / (hi - lo)))
        return F.floor(F.round(t * 255.0, 9) + 0.5).cast("long")

    ranges = {"ok_l": (0.0, 1.0), "ok_a": (-0.45, 0.45), "ok_b": (-0.45, 0.45)}
    sums = lab.groupBy("image_id", bin_index(*[F.col(c) for c in LAB]).alias("bin")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(as_byte(c, *r)).alias(c) for c, r in ranges.items()])
    means = sums.withColumns({c: lo + F.col(c) / F.col("n") / 255.0 * (hi - lo) for c, (lo, hi) in ranges.items()})
    return means.withColumn("weight", F.col("n") * (1.0 + 2.0 * C.chroma(F.col("ok_a"), F.col("ok_b"))))


def first_points(lab: np.ndarray, k: int, l_weight: float, rng: np.random.Generator, spread_out: bool) -> np.ndarray:
    """Centres to begin with: k different points at random, or each next one with a chance by its squared distance from those before."""
    if not spread_out:
        return lab[rng.choice(len(lab), size=k, replace=False)]
    scale = np.array([l_weight, 1, 1])
    chosen = [int(rng.integers(len(lab)))]
    near = np.full(len(lab), np.inf)
    while len(chosen) < k:
        near = np.minimum(near, (((lab - lab[chosen[-1]]) * scale) ** 2).sum(axis=1))
        total = near.sum()
        chosen.append(int(np.searchsorted(np.cumsum(near), rng.random() * total)) if total > 0 else int(rng.integers(len(lab))))
    return lab[np.minimum(chosen, len(lab) - 1)]


def plain_kmeans(lab: np.ndarray, k: int, l_weight: float = 0.1, rounds: int = 8, seed: int = 0, spread_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels of points by plain k-means; it ends when no label changes or no centre moves by a squared 0.001."""
    k = min(k, len(lab))
    if k <= 0:
        return np.zeros((0, 3)), np.zeros(0, np.int64)
    centers = first_points(lab, k, l_weight, np.random.default_rng(seed), spread_out)
    labels = np.zeros(len(lab), np.int64)
    scale = np.array([l_weight, 1, 1])
    for _ in range(rounds):
        now = np.argmin(np.stack([(((lab - c) * scale) ** 2).sum(axis=1) for c in centers], axis=1), axis=1)
        changed, labels = (now != labels).any(), now
        count = np.bincount(labels, minlength=k)
        means = np.stack([np.bincount(labels, lab[:, i], k) for i in range(3)], axis=1) / np.maximum(count, 1)[:, None]
        new = np.where(count[:, None] > 0, means, centers)
        moved = ((new - centers) ** 2).sum(axis=1).max()
        centers = new
        if not changed or moved < 0.001:
            break
    return centers, labels


def kmeans_of_bins(candidates: DataFrame, k: int, seed: int = 0, spread_out: bool = False) -> DataFrame:
    """Plain k-means on the bins of each image: a bin is one point."""
    return _per_image(candidates, lambda lab, w: plain_kmeans(lab, k, seed=seed, spread_out=spread_out)[0])


def _hue_coverage(lab: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """How well a candidate adds a hue: colourfulness, times its distance from the nearest colourful seed's hue."""
    strength = np.minimum(1, np.hypot(lab[:, 1], lab[:, 2]) / 0.14)
    colourful = seeds[np.hypot(seeds[:, 1], seeds[:, 2]) > 0.02]
    if not len(colourful):
        out = 0.7 + 0.3 * strength
    else:
        d = np.abs(np.arctan2(lab[:, 2], lab[:, 1])[:, None] - np.arctan2(colourful[:, 2], colourful[:, 1])[None, :])
        out = (0.2 + 0.8 * np.minimum(d, 2 * np.pi - d).min(axis=1) / np.pi) * strength
    return np.where(np.hypot(lab[:, 1], lab[:, 2]) <= 0.02, 0.2, out)


#: Scores of seeds nearer than that are equal.
TIE = 1e-6


def choose_seeds(lab: np.ndarray, weight: np.ndarray, k: int, spread: float = 0.0, l_weight: float = 0.3, tie: float = TIE) -> np.ndarray:
    """Indexes of up to k seeds: the heaviest first, then far and heavy ones; ties by weight, L, a, b, all descending.

    Scores within ``tie`` of the best so far are equal to it; where that is 0, scores that are so to nine places.
    """
    order = np.lexsort((-lab[:, 2], -lab[:, 1], -lab[:, 0], -np.round(weight, 9)))
    lab, weight = lab[order], weight[order]
    scale = np.array([l_weight, 1, 1])
    chosen = [0]
    nearest = np.full(len(lab), np.inf)
    while len(chosen) < k:
        nearest = np.minimum(nearest, (((lab - lab[chosen[-1]]) * scale) ** 2).sum(axis=1))
        heavy = 0.35 + 0.65 * np.sqrt(weight / weight.max())
        score = nearest * ((1 - spread) * heavy + (spread * _hue_coverage(lab, lab[chosen]) if spread else 0))
        score = np.where(np.round(nearest, 9) > 1e-6, score if tie else np.round(score, 9), -1)
        best, top = None, -0.5
        for i in np.flatnonzero(score > np.concatenate(([-0.5], np.maximum.accumulate(score)[:-1]))).tolist():
            if best is None or score[i] > top + tie:  # scores nearer than that are equal, and the order decides
                best, top = i, score[i]
        if best is None:
            break
        chosen.append(best)
    return order[chosen]


def lloyd(lab: np.ndarray, weight: np.ndarray, centers: np.ndarray, rounds: int = 4, l_weight: float = 0.3, spread: float = 0.0) -> np.ndarray:
    """Weighted Lloyd steps; stops when no centre moves by 0.0005 (squared). Empty centres stay."""
    scale = np.array([l_weight, 1, 1])
    for _ in range(rounds):
        d = (((lab[:, None] - centers[None]) * scale) ** 2).sum(axis=2)
        if spread > 0.001:
            h = np.abs(np.arctan2(lab[:, 2], lab[:, 1])[:, None] - np.arctan2(centers[:, 2], centers[:, 1])[None])
            c = np.minimum(np.hypot(lab[:, 1], lab[:, 2])[:, None], np.hypot(centers[:, 1], centers[:, 2])[None])
            d = d * (1 + spread * 4 * np.sqrt(np.minimum(h, 2 * np.pi - h) / np.pi) * np.minimum(1, c / 0.12))
        label = np.round(d, 9).argmin(axis=1)
        mass = np.bincount(label, weight, len(centers))
        moved = np.stack([np.bincount(label, weight * lab[:, j], len(centers)) for j in range(3)], axis=1) / np.maximum(mass, 1e-12)[:, None]
        moved = np.where(mass[:, None] > 0, moved, centers)
        shift = ((moved - centers) ** 2).sum(axis=1).max()
        centers = moved
        if shift < 0.0005:
            break
    return centers


CENTERS = "image_id bigint, k int, ok_l double, ok_a double, ok_b double"


def _per_image(candidates: DataFrame, make: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """A kernel over one image's candidates, at most 6912 rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        out = make(group[LAB].to_numpy(), group["weight"].to_numpy())
        return pd.DataFrame({"image_id": group["image_id"].iloc[0], "k": np.arange(len(out), dtype=np.int32), **{c: out[:, j] for j, c in enumerate(LAB)}})

    return candidates.select("image_id", "bin", "weight", *LAB).groupBy("image_id").applyInPandas(run, CENTERS)


def seeds(candidates: DataFrame, k: int, spread: float = 0.0, l_weight: float = 0.3, tie: float = TIE) -> DataFrame:
    return _per_image(candidates, lambda lab, w: lab[choose_seeds(lab, w, k, spread, l_weight, tie)])


def centers(candidates: DataFrame, k: int, spread: float = 0.0, l_weight: float = 0.3, rounds: int = 4) -> DataFrame:
    return _per_image(candidates, lambda lab, w: lloyd(lab, w, lab[choose_seeds(lab, w, k, spread, l_weight)], rounds, l_weight, spread))


def assign_fixed(lab: DataFrame, palette: list[tuple[float, float, float]], l_weight: float = 0.3, inside: bool = True) -> DataFrame:
    """Label of the nearest colour of a fixed palette, ties to the first; a projection of literals."""
    p = [F.col(c) for c in LAB]
    options = [F.struct(C.nanos(C.distance2(p, [C.num(v) for v in q], l_weight, inside)).alias("d"), F.lit(i).alias("i")) for i, q in enumerate(palette)]
    best = F.least(*options) if len(options) > 1 else options[0]
    return lab.withColumn("label", best["i"])


#: Images whose centres are broadcast together: at most 48 of 40 bytes each, about 40 MB.
MAX_BROADCAST_IMAGES = 20_000
#: Up to so many centres are compared one by one in generated code.
UNROLLED = 16


def assign(lab: DataFrame, centers: DataFrame, l_weight: float = 0.3, inside: bool = True) -> DataFrame:
    """Label of the nearest centre of the pixel's own image, the first on ties.

    Centres travel as one array row per image, so pixels never multiply; where the images are few, the pixels stay where they are.
    """
    packed = fixed(centers.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("k", *LAB))).alias("centers")))  # at most 48 an image
    size = packed.agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.max(F.size("centers")), F.lit(0)).alias("most")).first()
    p = [F.col(c) for c in LAB]

    def option(c: Column) -> Column:
        return F.struct(C.nanos(C.distance2(p, [c[n] for n in LAB], l_weight, inside)).alias("d"), c["k"].alias("k"))

    if 2 <= size.most <= UNROLLED:
        each = [F.get("centers", F.lit(i)) for i in range(size.most)]
        best = F.least(*[F.when(c.isNotNull(), option(c)) for c in each])
    else:
        best = F.array_min(F.transform("centers", option))
    joined = lab.join(F.broadcast(packed) if size.images <= MAX_BROADCAST_IMAGES else packed, "image_id")
    return joined.withColumn("label", best["k"]).drop("centers")


def cluster_table(labelled: DataFrame, k: int) -> DataFrame:
    """Mean colour and count of labels 0..k-1; empty clusters are mid gray with count 0."""
    got = labelled.groupBy("image_id", F.col("label").alias("k")).agg(*[F.avg(c).alias(c) for c in LAB], F.count(F.lit(1)).alias("cnt"))
    images = got.select("image_id").distinct()
    every = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    filled = every.join(got, ["image_id", "k"], "left")
    return filled.select("image_id", "k", *[F.coalesce(c, C.num(v)).alias(c) for c, v in zip(LAB, (0.5, 0.0, 0.0), strict=True)], F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def salience(clusters: DataFrame) -> DataFrame:
    """How much a cluster stands out: by chroma, and by squared distance from its image's mean colour."""
    mean = clusters.groupBy("image_id").agg(*[(F.sum(F.col(c) * F.col("cnt")) / F.sum("cnt")).alias(f"mean_{c}") for c in LAB])
    d = C.distance2([F.col(c) for c in LAB], [F.col(f"mean_{c}") for c in LAB])
    c = C.chroma(F.col("ok_a"), F.col("ok_b"))
    s = C.clamp(0.75 + 0.75 * F.least(c, C.num(0.2)) / 0.2 + 0.5 * F.least(d, C.num(0.3)) / 0.3, 0.75, 2.0)
    return clusters.join(mean, "image_id").select(*clusters.columns, s.alias("salience"))


def render(labelled: DataFrame, colors: DataFrame) -> DataFrame:
    """Pixels in the colour of their label (image_id, k, ok_l, ok_a, ok_b); labels are clamped to those there are."""
    rgb = C.rgb_bytes([F.col(c) for c in LAB])
    top = colors.groupBy("image_id").agg(F.max("k").alias("top"))
    table = colors.select("image_id", "k", *[v.alias(n) for n, v in zip(("r", "g", "b"), rgb, strict=True)])
    clamped = labelled.select("image_id", "idx", "label").join(top, "image_id").select("image_id", "idx", F.greatest(F.lit(0), F.least("top", "label")).alias("k"))
    return clamped.join(table, ["image_id", "k"]).select("image_id", "idx", F.col("k").alias("label"), "r", "g", "b")


def project_labels(labelled: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels through a mapping (image_id, label, target); what it lacks becomes 0."""
    return labelled.select("image_id", "idx", "label").join(mapping, ["image_id", "label"], "left").select("image_id", "idx", F.coalesce("target", F.lit(0)).alias("label"))


def weighted_centroids(clusters: DataFrame) -> DataFrame:
    """Count-weighted mean colour of clusters by ``target``."""
    return clusters.where("cnt > 0").groupBy("image_id", "target").agg(*[(F.sum(F.col(c) * F.col("cnt")) / F.sum("cnt")).alias(c) for c in LAB], F.sum("cnt").alias("cnt"))


def importances(clusters: DataFrame) -> DataFrame:
    """Sum of count times salience (at least 0.1, 1 where unknown) by ``target``."""
    return clusters.groupBy("image_id", "target").agg(F.sum(F.col("cnt") * F.greatest(C.num(0.1), F.coalesce("salience", C.num(1)))).alias("importance"))
