"""Contour lines of an image's depth in one group of bounded size: what ``lines`` does step by step for fields of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.operators import lines

EDGES = "TBLR"
#: Edges joined in a cell, by whether the mean of its corners is below the level, its case and the segment; -1 where there is none.
PAIRS = np.full((2, 16, 2, 2), -1)
for _case in range(1, 15):
    for _low, _found in zip((1, 0), lines.crossings(_case), strict=True):
        for _seg, _pair in enumerate(_found):
            PAIRS[_low, _case, _seg] = [EDGES.index(e) for e in _pair]


def _rounded(v: np.ndarray, places: int = 6) -> np.ndarray:
    """Rounded as Spark does, by the shortest decimals of a double: up from the double next to a half on."""
    low = np.floor(v * 10.0**places)
    return (low + (v >= (2.0 * low + 1.0) / (2.0 * 10.0**places))) / 10.0**places


def read(at: Column, last: Column, n: int) -> Column:
    """Whether one of ``n`` points that span 0..``last`` may lie next to a place, and so is made from it: of a point at most three places are such."""
    step = F.greatest(last, F.lit(1)) / float(max(1, n - 1))
    return F.floor((at + 1.000001) / step) >= F.ceil((at - 1.000001) / step)


def field(x: np.ndarray, y: np.ndarray, v: np.ndarray, wide: int, high: int, size: int) -> np.ndarray:
    """``lines.resampled`` as an array by rows, NaN where there is no point; only the rows and columns that points are made from are held."""
    (fx, sx), (fy, sy) = lines.corners(wide, size), lines.corners(high, size)
    cols, rows = np.union1d(fx, fx + 1), np.union1d(fy, fy + 1)
    i, j = np.minimum(np.searchsorted(cols, x), len(cols) - 1), np.minimum(np.searchsorted(rows, y), len(rows) - 1)
    own = (cols[i] == x) & (rows[j] == y) & ~np.isnan(v)
    at = (j * len(cols) + i)[own]
    count = np.bincount(at, minlength=len(rows) * len(cols)).reshape(len(rows), -1)
    value = np.bincount(at, v[own], len(rows) * len(cols)).reshape(len(rows), -1)
    left, top = np.searchsorted(cols, fx)[None], np.searchsorted(rows, fy)[:, None]
    total, known = np.zeros((size, size)), np.zeros((size, size), np.int64)
    for below, wy in ((0, 1.0 - sy[:, None]), (1, sy[:, None])):
        for right, wx in ((0, 1.0 - sx[None]), (1, sx[None])):
            total += value[top + below, left + right] * wx * wy
            known += count[top + below, left + right]
    return np.where(known > 0, _rounded(total, 9), np.nan)


def segments(v: np.ndarray, levels: list[float], cutoff: float) -> list[np.ndarray]:
    """Of each level the end points (ax, ay, bx, by) of its segments in ten-thousandths of the field, by cell and place in it."""
    tl, tr, bl, br = v[:-1, :-1], v[:-1, 1:], v[1:, :-1], v[1:, 1:]
    mean = (tl + tr + bl + br) / 4.0
    shown = ~np.isnan(mean) & ~((tl >= cutoff) & (tr >= cutoff) & (bl >= cutoff) & (br >= cutoff))
    out = []
    for t in levels:
        below = (v < t).astype(np.int8)
        case = 8 * below[:-1, :-1] + 4 * below[:-1, 1:] + 2 * below[1:, 1:] + below[1:, :-1]
        y, x = np.nonzero(shown & (case > 0) & (case < 15))
        a, b, c, e = tl[y, x], tr[y, x], bl[y, x], br[y, x]

        def cut(p: np.ndarray, q: np.ndarray, t: float = t) -> np.ndarray:
            far = np.abs(q - p) > 1e-12
            return np.where(far, np.clip((t - p) / np.where(far, q - p, 1.0), 0.0, 1.0), 0.5)

        points = np.array([[x + cut(a, b), y], [x + cut(c, e), y + 1], [x, y + cut(a, c)], [x + 1, y + cut(b, e)]])
        points = _rounded(points / float(len(v) - 1))
        pairs = PAIRS[(mean[y, x] < t).astype(int), case[y, x]].reshape(-1, 2)
        k = np.flatnonzero(pairs[:, 0] >= 0)
        p, q = points[pairs[k, 0], :, k // 2], points[pairs[k, 1], :, k // 2]
        out.append(np.rint(np.hstack((p, q))[(p != q).any(axis=1)] * lines.QUANTUM).astype(np.int64))
    return out


def bent(points: np.ndarray, closed: bool, steps: int = 6) -> np.ndarray:
    """``lines.smoothed`` of one chain."""
    if len(points) > 2:
        ends = points[[-1]], points[[0, 1]]
        if not closed:
            ends = 2.0 * points[:1] - points[1:2], 2.0 * points[-1:] - points[-2:-1]
        way = np.concatenate((ends[0], points, ends[1]))
        p0, p1, p2, p3 = (way[None, k : len(way) - 3 + k] for k in range(4))
        t = (np.arange(steps) / float(steps))[:, None, None]
        curve = 0.5 * (2.0 * p1 + (p2 - p0) * t + (2.0 * p0 - 5.0 * p1 + 4.0 * p2 - p3) * t * t + (3.0 * p1 - p0 - 3.0 * p2 + p3) * t * t * t)
        curve[0] = p1[0]
        curve = curve.transpose(1, 0, 2).reshape(-1, 2)
        points = curve if closed else np.concatenate((curve, points[-1:]))
    return _rounded(np.clip(points, 0.0, 1.0))


def drawn(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``lines.chain_segments`` of the smoothed chains of an image's levels: numbers of chains, numbers in them, and (x0, y0, x1, y1)."""
    i, j, sides, chains = [], [], [], 0
    for ends in levels:
        for _, points, closed in lines.walk([((a, b), (c, d)) for a, b, c, d in ends.tolist()]):
            way = bent(np.array(points) / lines.QUANTUM, closed)
            side = np.hstack((way, np.roll(way, -1, axis=0)))[: len(way) if closed else -1]
            k = np.flatnonzero((side[:, :2] != side[:, 2:]).any(axis=1))
            i.append(np.full(len(k), chains, np.int32))
            j.append(k.astype(np.int32))
            sides.append(side[k])
            chains += 1
    return (np.concatenate(i), np.concatenate(j), np.concatenate(sides)) if chains else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty((0, 4)))


def _dealt(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each of ``n`` parts of a thing belongs to, and its number there."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def toned(sides: np.ndarray, x: np.ndarray, y: np.ndarray, light: np.ndarray, mx: int, my: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``lines.line_colors`` in the style "auto" of an image that is whole: the segment of each run, its number, its ends, and whether it is black."""
    at, lit = y * (mx + 1) + x, ~np.isnan(light)
    there = np.bincount(at, minlength=(mx + 1) * (my + 1))
    n_lit = np.bincount(at[lit], minlength=len(there))
    total = np.bincount(at[lit], light[lit], len(there))
    (x0, y0), (dx, dy) = sides[:, :2].T, (sides[:, 2:] - sides[:, :2]).T
    px, py = dx * mx, dy * my
    length = _rounded(np.sqrt(px * px + py * py), 9)
    chunks = np.maximum(1, np.ceil(length / min(48.0, max(1.0, min(mx, my) + 1.0)))).astype(np.int64)
    side, chunk = _dealt(chunks)
    span = (length / chunks)[side]
    samples = np.maximum(1, np.ceil(_rounded(span / 8.0, 9))).astype(np.int64)
    part, s = _dealt(samples)
    k, near = _dealt(np.where(span[part] < 3, 1, 9))
    part, s, wide = part[k], s[k], span[part[k]] >= 3
    along = (chunk[part] + (s + 0.5) / samples[part]) / chunks[side[part]]

    def place(c: np.ndarray, d: np.ndarray, m: int, off: np.ndarray) -> np.ndarray:
        to = (c[side[part]] + d[side[part]] * along) * m
        return np.clip(np.floor(_rounded(to + 0.5, 9)).astype(np.int64) + np.where(wide, off, 0), 0, m)

    spot = place(y0, dy, my, near % 3 - 1) * (mx + 1) + place(x0, dx, mx, near // 3 - 1)
    found, n, sums = (np.bincount(part, w[spot], len(side)) for w in (there, n_lit, total))
    luminance = _rounded(sums / np.maximum(n, 1), 9)
    kept = np.flatnonzero(found > 0)
    black = ((n > 0) & (np.abs(luminance) >= np.abs(luminance - 1.0)))[kept]
    side, chunk = side[kept], chunk[kept]
    new = np.ones(len(kept), bool)
    new[1:] = (side[1:] != side[:-1]) | (black[1:] != black[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(kept))[: len(first)] - 1
    of = side[first]
    run = np.arange(len(of)) - np.searchsorted(of, of) + 1
    ends = [_rounded(c[of] + d[of] * w / chunks[of]) for w in (chunk[first], chunk[last] + 1) for c, d in ((x0, dx), (y0, dy))]
    return of, run.astype(np.int32), np.stack(ends, axis=1), black[first]


SIDES = "image_id bigint, i int, j int, x0 double, y0 double, x1 double, y1 double"


def contours(placed: DataFrame, levels: int, cutoff: float, size: int, whole: bool) -> DataFrame:
    """Contour lines of images, each a group of the pixels (x, y, v, light) that its field is made from, or of all where images are ``whole`` and lines get colours.

    ``placed`` also has an image's least and greatest level, lo and hi, the last places mx and my of its pixels, and wide and high of those with depth.
    """
    shares = [(k + 1) / (levels + 1) for k in range(levels)]

    def run(group: pa.Table) -> pa.Table:
        x, y, v = (group[c].to_numpy() for c in ("x", "y", "v"))
        mx, my, wide, high, lo, hi = (group[c][0].as_py() for c in ("mx", "my", "wide", "high", "lo", "hi"))
        edges = [float(_rounded(lo + (hi - lo) * s, 9)) for s in shares]
        i, j, sides = drawn(segments(field(x, y, v, wide, high, size), edges, cutoff))
        more = {}
        if whole:
            of, number, sides, black = toned(sides, x, y, group["light"].to_numpy(), mx, my)
            i, j, more = i[of], j[of], {"run": number, "black": black}
        ends = dict(zip(("x0", "y0", "x1", "y1"), np.ascontiguousarray(sides.T), strict=True))
        return pa.table({"image_id": np.full(len(i), group["image_id"][0].as_py(), np.int64), "i": i, "j": j, **ends, **more})

    return placed.groupBy("image_id").applyInArrow(run, SIDES + (", run int, black boolean" if whole else ""))
