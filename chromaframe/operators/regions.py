"""Connected regions of label rasters, and the cleanup of small ones.

Images are cut into tiles of ``TILE`` x ``TILE`` pixels, which are groups of bounded size; a pixel at a tile's edge also goes to the tile beside it,
as halo. Regions are found within tiles by arrays; what tiles join is a graph of their local regions, merged by Spark. The cleanup works on the graph of
regions: only the pixels of small regions are looked at again, and the scan order is replayed region by region.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.operators import graph
from chromaframe.sources.store import stored

FACTORS = {"off": 0.0, "small": 0.002, "medium": 0.005, "large": 0.01}
TILE = 256
#: Pixels of small regions that one group of the cleanup holds, on average.
GROUP = 1 << 16
#: Steps to the neighbours, in the order in which a region grows.
AROUND = ((-1, 0), (1, 0), (0, -1), (0, 1))


def _tiles(pixels: DataFrame, width: int, tile: int, *values: str) -> DataFrame:
    """Pixels (image_id, idx, values) by tile (tx, ty), each also in the tiles that it touches with a side, there not ``own``."""
    x, y = (F.col("idx") % width).cast("int"), F.floor(F.col("idx") / width).cast("int")
    tx, ty = F.floor(x / tile).cast("int"), F.floor(y / tile).cast("int")

    def place(dx: int, dy: int, there: Column) -> Column:
        return F.when(there, F.struct((tx + dx).alias("tx"), (ty + dy).alias("ty"), F.lit(not (dx or dy)).alias("own")))

    inside = [(x % tile == 0) & (tx > 0), x % tile == tile - 1, (y % tile == 0) & (ty > 0), y % tile == tile - 1]
    places = F.array_compact(F.array(place(0, 0, F.lit(True)), *[place(dx, dy, c) for (dx, dy), c in zip(AROUND, inside, strict=True)]))
    return pixels.select("image_id", "idx", x.alias("x"), y.alias("y"), *values, F.explode(places).alias("t")).select("image_id", "t.*", "idx", "x", "y", *values)


def _grid(group: pd.DataFrame, tile: int, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile with its halo, values, indices and which pixels are the tile's own; -1 as the index of places without a pixel."""
    x, y = (group[c].to_numpy() - int(group[t].iloc[0]) * tile + 1 for c, t in (("x", "tx"), ("y", "ty")))
    values, idx, own = np.zeros((tile + 2, tile + 2), np.int64), np.full((tile + 2, tile + 2), -1, np.int64), np.zeros((tile + 2, tile + 2), bool)
    values[y, x], idx[y, x], own[y, x] = group[value].to_numpy(), group["idx"].to_numpy(), group["own"].to_numpy()
    return values, idx, own


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over edges a - b."""
    parent = np.arange(n)
    while len(a):
        low = np.minimum(parent[a], parent[b])
        new = parent.copy()
        np.minimum.at(new, parent[a], low)
        np.minimum.at(new, parent[b], low)
        new = new[new]
        if (new == parent).all():
            break
        parent = new
    return parent


def _local(labelled: DataFrame, width: int, tile: int) -> DataFrame:
    """Own pixels with ``root``, the smallest index of their region within the tile, and ``beyond``, pixels of the same label right of or below the tile."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        values, idx, own = _grid(group, tile, "label")
        at = np.full(idx.shape, -1)
        inner = np.flatnonzero(own)
        inner = inner[np.argsort(idx.ravel()[inner])]
        at.ravel()[inner] = np.arange(len(inner))
        a, b, edge, beyond = [], [], [], []
        for dx, dy in ((1, 0), (0, 1)):
            here, there = (slice(0, -1), slice(0, -1)), (slice(dy, tile + 1 + dy), slice(dx, tile + 1 + dx))
            alike = own[here] & (idx[there] >= 0) & (values[here] == values[there])
            inside = alike & own[there]
            a.append(at[here][inside])
            b.append(at[there][inside])
            edge.append(at[here][alike & ~inside])
            beyond.append(idx[there][alike & ~inside])
        indices = idx.ravel()[inner]
        root = indices[_union(len(inner), np.concatenate(a), np.concatenate(b))]
        out: list[list[int]] = [[] for _ in inner]
        for e, j in zip(np.concatenate(edge).tolist(), np.concatenate(beyond).tolist(), strict=True):
            out[e].append(j)
        return pd.DataFrame({"image_id": group["image_id"].iloc[0], "idx": indices.astype(np.int32), "label": values.ravel()[inner].astype(np.int32), "root": root.astype(np.int32), "beyond": pd.Series(out, dtype=object)})

    tiles = _tiles(labelled, width, tile, "label")
    return tiles.groupBy("image_id", "tx", "ty").applyInPandas(run, "image_id bigint, idx int, label int, root int, beyond array<int>")


def _found(labelled: DataFrame, width: int, tile: int) -> DataFrame:
    """(image_id, idx, label, region)."""
    local = stored(_local(labelled.select("image_id", "idx", "label"), width, tile), "regions")
    cross = local.where(F.size("beyond") > 0).select("image_id", F.col("root").alias("a"), F.explode("beyond").alias("idx"))
    ends = local.where((F.col("idx") % width % tile == 0) | (F.floor(F.col("idx") / width) % tile == 0)).select("image_id", "idx", F.col("root").alias("b"))
    merged = graph.components(cross.join(ends, ["image_id", "idx"]).select("image_id", "a", "b"), ["image_id"])
    return local.join(merged.withColumnRenamed("node", "root"), ["image_id", "root"], "left").select("image_id", "idx", "label", F.coalesce("component", "root").alias("region"))


def regions(labelled: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """4-connected regions: every pixel with its region's smallest index."""
    return _found(labelled, width, tile).drop("label")


def region_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("image_id", "region").agg(F.count(F.lit(1)).alias("size"))


def _neighbours(found: DataFrame, small: DataFrame, width: int, tile: int) -> DataFrame:
    """Pixels of small regions with the indices and regions of their neighbours, -1 where there is none."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        region, idx, own = _grid(group, tile, "region")
        wanted, _, _ = _grid(group, tile, "small")
        ys, xs = np.nonzero(own & (wanted > 0))
        out = {"image_id": group["image_id"].iloc[0], "idx": idx[ys, xs], "region": region[ys, xs]}
        near = [idx[ys + dy, xs + dx] for dx, dy in AROUND]
        beside = [np.where(i >= 0, region[ys + dy, xs + dx], -1) for i, (dx, dy) in zip(near, AROUND, strict=True)]
        return pd.DataFrame(out | {n: pd.Series(list(np.stack(v, axis=1)), dtype=object) for n, v in (("near", near), ("beside", beside))})

    marked = found.join(small.select("image_id", "region", F.lit(1).alias("small")), ["image_id", "region"], "left").withColumn("small", F.coalesce("small", F.lit(0)))
    return _tiles(marked, width, tile, "region", "small").groupBy("image_id", "tx", "ty").applyInPandas(run, "image_id bigint, idx int, region int, near array<int>, beside array<int>")


def _met(group: pd.DataFrame) -> pd.DataFrame:
    """Per region and neighbouring region how often they touch, and when the growing region first meets it.

    All regions of the group grow at once, breadth first from their smallest index; ``turn`` is what the growth of one region alone would count.
    """
    group = group.sort_values("idx")
    idx, region = group["idx"].to_numpy(), group["region"].to_numpy()
    near, beside = (np.stack(group[c].to_numpy()) for c in ("near", "beside"))
    turn = np.full(len(idx), -1, np.int64)
    own = beside == region[:, None]
    into = np.where(own, np.searchsorted(idx, near), 0)
    _, first = np.unique(region, return_index=True)  # the smallest index of a region comes first
    turn[first] = 0
    grown = {int(region[f]): 1 for f in first}
    edge = first
    while True:
        to, ok = into[edge].ravel(), own[edge].ravel()
        to = to[ok]
        to = to[turn[to] < 0]
        _, at = np.unique(to, return_index=True)
        edge = to[np.sort(at)]
        if not len(edge):
            break
        order = np.argsort(region[edge], kind="stable")  # by region, each in its own order
        edge = edge[order]
        starts = np.flatnonzero(np.diff(region[edge], prepend=-1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(edge)], strict=True):
            r = int(region[edge[s]])
            turn[edge[s:e]] = grown[r] + np.arange(e - s)
            grown[r] += e - s
    row, side = np.nonzero((beside >= 0) & ~own)
    out = pd.DataFrame({"region": region[row], "other": beside[row, side], "turn": turn[row] * 4 + side})
    out = out.groupby(["region", "other"], as_index=False).agg(cnt=("turn", "size"), turn=("turn", "min"))
    return out.assign(image_id=group["image_id"].iloc[0])[["image_id", "region", "other", "cnt", "turn"]]


def _by_region(group: pd.DataFrame):
    """(region, [(other, cnt)]) in order."""
    cuts = np.flatnonzero(np.diff(group["region"].to_numpy(), prepend=-1)).tolist()  # a group has a row
    region, pairs = group["region"].tolist(), list(zip(group["other"].tolist(), group["cnt"].tolist(), strict=True))
    for s, e in zip(cuts, [*cuts[1:], len(pairs)], strict=True):
        yield region[s], pairs[s:e]


def _replayed(group: pd.DataFrame) -> pd.DataFrame:
    """Labels of small regions, in scan order: each takes the label most frequent around it as labels are then, of equally frequent ones the one met first."""
    group = group.sort_values(["region", "turn"])
    label = dict(zip(group["other"].tolist(), group["other_label"].tolist(), strict=True)) | dict(zip(group["region"].tolist(), group["label"].tolist(), strict=True))
    new = {}
    for region, rows in _by_region(group):
        around: dict[int, int] = {}
        for other, cnt in rows:
            if label[other] != label[region]:
                around[label[other]] = around.get(label[other], 0) + cnt
        if around:
            new[region] = label[region] = max(around, key=around.get)
    return pd.DataFrame({"image_id": group["image_id"].iloc[0], "region": list(new), "new": list(new.values())})


def cleaned(labelled: DataFrame, factor: float, width: int, tile: int = TILE) -> DataFrame:
    """Regions under ``floor(n * factor)`` pixels of an image take the label most frequent around them, in scan order and in place.

    A region is found and grown as it was at first, since one that has changed its label is never grown again; only the labels around it may have
    changed, and these are those of regions. So the scan is replayed on pairs of regions (their touches, their first meeting).
    """
    if factor <= 0:
        return labelled.select("image_id", "idx", "label")
    found = stored(_found(labelled, width, tile), "regions-found")
    sizes = found.groupBy("image_id", "region").agg(F.count(F.lit(1)).alias("size"), F.first("label").alias("label"))
    least = found.groupBy("image_id").agg(F.floor(F.count(F.lit(1)) * F.lit(float(factor))).alias("least"))
    sized = stored(sizes.join(least, "image_id"), "region-sizes")
    small = sized.where("size < least")
    parts = F.greatest(F.lit(1), F.ceil(F.sum("size") / F.lit(GROUP))).alias("parts")
    near = _neighbours(found, small, width, tile).join(small.groupBy("image_id").agg(parts), "image_id")
    met = near.withColumn("part", F.pmod(F.xxhash64("region"), F.col("parts"))).groupBy("image_id", "part").applyInPandas(_met, "image_id bigint, region int, other int, cnt bigint, turn bigint")
    labels = sized.select("image_id", "region", "label")
    touching = met.join(labels, ["image_id", "region"]).join(labels.toDF("image_id", "other", "other_label"), ["image_id", "other"])
    new = touching.groupBy("image_id").applyInPandas(_replayed, "image_id bigint, region int, new int")
    return found.join(new, ["image_id", "region"], "left").select("image_id", "idx", F.coalesce("new", "label").alias("label"))
