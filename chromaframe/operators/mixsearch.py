"""Search for the mix nearest to each colour, by boxes of Oklab.

The weight of chroma hangs on the target, so no fixed metric fits; but a box of colours bounds the weighted distance to every mix in it, for any
weight. ``index`` cuts the cells of a grid, along a curve that keeps neighbours together, into boxes of about ``LEAF`` mixes, writes the mixes by box
to the shared folder and keeps the bounds of the boxes, at most some 10^5 rows whatever the number of mixes. ``nearest`` works by branch and
bound: every target is compared with the mixes of the box that bounds it best, and then with those of all boxes whose bound lies
under what it found. Targets and mixes meet by box in groups of at most ``TARGETS`` targets; neither side is ever whole in one place.

Where all mixes of a pigment table are at most ``HELD``, ``Held`` does the same within a task: it makes the mixes from the pigments, which are all
that is sent, and keeps its boxes as arrays. Results are the same.

Ties in distance, to nine places, go to fewer paints, then lower indexes and amounts. Equal colours are searched once. Colours with a null have no mix;
without mixes there is no result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.operators.spectral import ORDER, Mix, Pigments, chroma_weight, pruned_parts, steps
from chromaframe.sources.store import stored

LAB = list(C.LAB)
#: Mixes of a box; twice as many where that would make more than MOST_BOXES boxes, and so on.
LEAF, MOST_BOXES = 2048, 1 << 16
#: Cells of the grid along each axis, as bits, and what it spans; colours outside lie in its outer cells.
GRID_BITS = 6
LOW, HIGH = (0.0, -0.5, -0.5), (1.0, 0.5, 0.5)
#: Targets that meet the mixes of a box in one group.
TARGETS = 20_000
#: Distances are rounded to nine places, so a bound may lie this much above what it bounds.
SLACK = 2e-9

#: Mixes that a task may hold, 16 bytes each with their numbers: those of 83 pigments in threes. Mixes of a box there, and those made at once.
HELD, HELD_LEAF, HELD_AT_ONCE = 4_200_000, 256, 1 << 13

FOUND = "ok_l double, ok_a double, ok_b double, dd double, n_paints int, i0 int, i1 int, i2 int, a0 int, a1 int, a2 int, mix_l double, mix_a double, mix_b double"
NEAREST = "image_id bigint, k int, i0 int, i1 int, i2 int, a0 int, a1 int, a2 int, n_paints int, ok_l double, ok_a double, ok_b double, delta_e double"


@dataclass
class Index:
    """Mixes by ``box``, and per box its number and the least and greatest value of each coordinate."""

    mixes: DataFrame
    box: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, colors: np.ndarray, boxes: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Least weighted squared distance of each colour to each box, or to some."""
        w = chroma_weight(colors)[:, None]
        low, high = self.low[boxes], self.high[boxes]
        gap = [np.maximum(0.0, np.maximum(low[None, :, i] - colors[:, i, None], colors[:, i, None] - high[None, :, i])) for i in range(3)]
        return gap[0] * gap[0] + w * (gap[1] * gap[1] + gap[2] * gap[2])


def cell() -> Column:
    """Number of a colour's grid cell along a Z-curve: the bits of its three coordinates in turn."""
    n = 1 << GRID_BITS
    at = [F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - lo) / (hi - lo) * n))).cast("int") for c, lo, hi in zip(LAB, LOW, HIGH, strict=True)]
    out = F.lit(0)
    for bit in range(GRID_BITS):
        for axis, a in enumerate(at):
            out = out + F.shiftleft(F.shiftright(a, bit).bitwiseAND(1), 3 * bit + axis)
    return out


class Held:
    """All mixes of at most ``most`` paints of a pigment table in boxes along the Z-curve, as arrays.

    A mix is a colour in single precision and its number among the sets of paints and their steps. A search gathers all mixes that may be nearest, as
    the error of single precision is bounded, and makes these few anew, so results are those of double precision.
    """

    def __init__(self, pigments: Pigments, most: int = 3, leaf: int = HELD_LEAF):
        self.pigments, self.kinds, n = pigments, [], 0
        for size in (2, 3) if most >= 3 else (2,):
            sets = np.fromiter(itertools.chain.from_iterable(itertools.combinations(range(len(pigments.pid)), size)), np.int16).reshape(-1, size)
            amounts = steps(size)
            amounts = amounts[(amounts > 0).sum(axis=1) <= most]
            self.kinds.append((n, sets, amounts))
            n += len(sets) * len(amounts)
        self.lab, curve = np.empty((n, 3), np.float32), np.empty(n, np.int32)
        for start in range(0, n, HELD_AT_ONCE):
            at = slice(start, min(start + HELD_AT_ONCE, n))
            self.lab[at] = lab = pigments.mixes(*self.paints(np.arange(at.start, at.stop)))
            curve[at] = self._curve(lab)
        order = np.argsort(curve, kind="stable").astype(np.int32)
        del curve
        for i in range(3):
            self.lab[:, i] = self.lab[order, i]
        self.number = order
        self.error = 2.0**-24 * max(1.0, float(np.abs(self.lab).max(initial=0)))
        self.start = np.arange(0, n, leaf)
        self.end = np.append(self.start[1:], n)
        ends = [f.reduceat(self.lab, self.start, axis=0).astype(float) if n else self.lab for f in (np.minimum, np.maximum)]
        ends = [ends[0] - self.error, ends[1] + self.error]
        self.boxes = Index(None, self.start, *ends)
        self.wide = math.isqrt(len(self.start)) + 1  # boxes of a group, which bounds them all
        first = np.arange(0, len(self.start), self.wide)
        self.groups = Index(None, first, *[f.reduceat(e, first, axis=0) if len(first) else e for f, e in zip((np.minimum, np.maximum), ends, strict=True)])

    @staticmethod
    def _curve(lab: np.ndarray) -> np.ndarray:
        at = ((lab - LOW) / np.subtract(HIGH, LOW) * (1 << GRID_BITS)).clip(0, (1 << GRID_BITS) - 1).astype(np.int32)
        curve = np.zeros(len(at), np.int32)
        for bit in range(GRID_BITS):
            for axis in range(3):
                curve |= (at[:, axis] >> bit & 1) << 3 * bit + axis
        return curve

    def paints(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (-1: none) and amounts of mixes by their numbers."""
        places, amounts = np.full((len(number), 3), -1), np.zeros((len(number), 3), np.int64)
        for first, sets, of in self.kinds:
            mine = np.flatnonzero((number >= first) & (number < first + len(sets) * len(of)))
            at, step = np.divmod(number[mine] - first, max(1, len(of)))
            places[mine, : sets.shape[1]] = sets[at]
            amounts[mine] = of[step]
        return places, amounts

    def _slack(self, d: float) -> float:
        """How far a squared distance of double precision may lie from one of single precision, both weighted by at most 1, 32 and 32, and rounded."""
        return 2 * self.error * math.sqrt(65 * d) + 65 * self.error**2 + SLACK

    def nearest(self, color: np.ndarray, least: float = 0.02) -> Mix:
        color, w = np.asarray(color, float), chroma_weight(np.asarray(color, float))
        best, limit, near = np.inf, np.inf, []  # no less than the nearest's distance, and than what single precision makes of that
        groups = self.groups.bounds(color[None])[0]
        for group in np.argsort(groups).tolist():
            if groups[group] > best + SLACK:
                break
            boxes = np.arange(group * self.wide, min((group + 1) * self.wide, len(self.start)))
            bound = self.boxes.bounds(color[None], boxes)[0]
            for box in np.argsort(bound).tolist():
                if bound[box] > best + SLACK:
                    break
                at = slice(self.start[boxes[box]], self.end[boxes[box]])
                diff = self.lab[at] - color
                diff *= diff
                d = diff[:, 0] + w * (diff[:, 1] + diff[:, 2])
                least_d = float(d.min())
                if least_d < best and (most := least_d + self._slack(least_d)) < best:
                    best, limit = most, most + self._slack(most)
                if least_d <= limit:
                    same = np.flatnonzero(d <= limit)
                    near.append((d[same], self.number[at][same]))
        d, number = (np.concatenate(c) for c in zip(*near, strict=True))
        places, amounts = self.paints(number[d <= limit].astype(np.int64))
        full = max(2, len(places))  # the product of a single row is summed in another order
        lab = self.pigments.mixes(np.resize(places, (full, 3)), np.resize(amounts, (full, 3)))[: len(places)]
        diff = (lab - color) ** 2
        d = np.round(diff[:, 0] + w * (diff[:, 1] + diff[:, 2]), 9)
        one = int(np.lexsort((*amounts.T[::-1], *places.T[::-1], (amounts > 0).sum(axis=1), d))[0])
        parts = {int(self.pigments.pid[p]): a / 8.0 for p, a in zip(places[one].tolist(), amounts[one].tolist(), strict=True) if a}
        return Mix(pruned_parts(parts, least), tuple(lab[one].tolist()), math.sqrt(d[one]))

    def nearest_all(self, colors: np.ndarray) -> list[Mix]:
        return [self.nearest(c) for c in colors]


def index(mixes: DataFrame, most: int = 3, leaf: int = LEAF) -> Index:
    """The index of all mixes of at most ``most`` paints."""
    spark = mixes.sparkSession
    placed = stored(mixes.where(F.col("n_paints") <= most).select(*ORDER, *LAB).withColumn("cell", cell()), "mixes")
    cells = placed.groupBy("cell").count().toArrow().sort_by("cell")  # at most 2 ^ (3 * GRID_BITS) rows
    count = cells.column("count").to_numpy()
    leaf = max(leaf, -(-int(count.sum()) // MOST_BOXES))
    # cells go to boxes as they come; a cell of more than a leaf is cut into parts of its own
    parts = np.maximum(1, -(-count // leaf))
    small = np.where(parts > 1, 0, count)
    group = (np.cumsum(small) - small) // leaf + np.cumsum(parts > 1)
    number = np.concatenate(([0], np.cumsum((group[1:] != group[:-1]) | (parts[1:] > 1) | (parts[:-1] > 1)))) if len(group) else group
    base = number + np.concatenate(([0], np.cumsum(parts - 1)[:-1])) if len(group) else group
    cuts = spark.createDataFrame(pa.table({"cell": cells.column("cell"), "base": base.astype(np.int64), "parts": parts.astype(np.int64)})) if len(group) else placed.selectExpr("cell", "0L AS base", "1L AS parts").limit(0)
    boxed = placed.join(F.broadcast(cuts), "cell").withColumn("box", F.col("base") + F.pmod(F.xxhash64(*ORDER), F.col("parts")))
    table = stored(boxed.select("box", *ORDER, *LAB).repartition("box").sortWithinPartitions("box"), "mixes-by-box")
    ends = table.groupBy("box").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in LAB]).toArrow()
    low, high = (np.stack([ends.column(f"{n}_{c}").to_numpy() for c in LAB], axis=1) for n in ("low", "high"))
    return Index(table, ends.column("box").to_numpy(), low, high)


def _compared(targets: pa.Table, mixes: pa.Table) -> pa.Table:
    """The nearest of the mixes to each target."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    keys = [mixes.column(c).to_numpy() for c in ORDER]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    lab = np.stack([mixes.column(c).to_numpy() for c in LAB], axis=1).reshape(-1, 3)[order]
    colors = np.stack([targets.column(c).to_numpy() for c in LAB], axis=1).reshape(-1, 3)
    best, dd = np.zeros(len(colors), np.int64), np.zeros(len(colors))
    if len(lab):
        step = max(1, (1 << 20) // len(lab))
        for first in range(0, len(colors), step):
            some = colors[first : first + step]
            diff = (lab[None] - some[:, None]) ** 2
            d = np.round(diff[:, :, 0] + chroma_weight(some)[:, None] * (diff[:, :, 1] + diff[:, :, 2]), 9)
            best[first : first + step] = d.argmin(axis=1)
            dd[first : first + step] = d.min(axis=1)
    else:
        colors, best, dd = colors[:0], best[:0], dd[:0]
    return pa.table([*colors.T, dd, *[k[best] for k in keys], *lab[best].T], names=names)


def _probe(tries: DataFrame, found: Index) -> DataFrame:
    """The nearest mix of each colour in the box it is to try (lab, box)."""
    sizes = tries.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / F.lit(TARGETS)).alias("blocks"))  # a row a box at most
    blocked = tries.join(F.broadcast(sizes), "box").select("box", F.pmod(F.xxhash64(*LAB, F.lit(3)), F.col("blocks")).alias("block"), *LAB)
    mixes = found.mixes.join(F.broadcast(sizes), "box").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    return blocked.groupBy("box", "block").cogroup(mixes.groupBy("box", "block")).applyInArrow(_compared, FOUND)


def _tries(colors: DataFrame, found: Index, bounded: bool) -> DataFrame:
    """Boxes that each colour is to try: the one of the least bound, or, with ``bounded``, all others whose bound isn't above what it has found (dd)."""
    box, index = found.box, Index(None, found.box, found.low, found.high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // max(1, len(box)))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                some = batch.slice(first, step)
                lab = np.stack([some.column(c).to_numpy() for c in LAB], axis=1)
                bound = index.bounds(lab)
                least = bound.argmin(axis=1)
                if bounded:
                    open_ = bound <= some.column("dd").to_numpy()[:, None] + SLACK
                    open_[np.arange(len(lab)), least] = False
                    row, at = np.nonzero(open_)
                else:
                    row, at = np.arange(len(lab)), least
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*lab[row].T, box[at])], names=[*LAB, "box"])

    return colors.mapInArrow(run, "ok_l double, ok_a double, ok_b double, box bigint")


def nearest(targets: DataFrame, found: Index) -> DataFrame:
    """For each target (image_id, k, ok_l, ok_a, ok_b) the mix with the smallest weighted distance, as NEAREST."""
    colors = targets.select(*LAB).dropna().distinct()
    best_of = F.min(F.struct("dd", *ORDER, "mix_l", "mix_a", "mix_b")).alias("m")
    if not len(found.box):
        return targets.sparkSession.createDataFrame([], NEAREST)
    seed = stored(_probe(_tries(colors, found, False), found), "mix-seeds")
    more = _probe(_tries(seed.select(*LAB, "dd"), found, True), found)
    best = seed.unionByName(more).groupBy(*LAB).agg(best_of)
    rows = targets.select("image_id", "k", *LAB).join(best, LAB)
    mix = [F.col(f"m.{c}") for c in ORDER[1:]]
    return rows.select("image_id", "k", *mix, "m.n_paints", *[F.col(f"m.mix_{c[-1]}").alias(c) for c in LAB], F.sqrt("m.dd").alias("delta_e"))


def nearest_mix(targets: DataFrame, mixes: DataFrame, most: int = 3, leaf: int = LEAF) -> DataFrame:
    """``nearest`` among all mixes of at most ``most`` paints of a table."""
    return nearest(targets, index(mixes, most, leaf))
