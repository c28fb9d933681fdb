"""Grid lines, contours, line tones and smoothing."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.operators import graph
from chromaframe.sources.store import stored


def grid_segments(images: DataFrame, divisions: int, diagonals: bool = False) -> DataFrame:
    """Segments (image_id, kind, i, j, x0, y0, x1, y1) of a grid of square cells over images (image_id, width, height).

    Cells come from the short edge; the last line of each direction lies on the border.
    """
    if divisions <= 0:
        return images.sparkSession.createDataFrame([], "image_id bigint, kind string, i int, j int, x0 double, y0 double, x1 double, y1 double")
    cell = F.least("width", "height") / float(divisions)
    base = images.select("image_id", (cell / F.col("width")).alias("cw"), (cell / F.col("height")).alias("ch"), F.ceil(F.col("width") / cell).cast("int").alias("cols"), F.ceil(F.col("height") / cell).cast("int").alias("rows"))
    i = F.explode(F.sequence(F.lit(0), F.col("cols"))).alias("i")
    down = base.select("image_id", "cw", i).select("image_id", F.lit("column").alias("kind"), "i", F.lit(0).alias("j"), F.least(F.col("i") * F.col("cw"), C.num(1)).alias("x0"), C.num(0).alias("y0"), F.least(F.col("i") * F.col("cw"), C.num(1)).alias("x1"), C.num(1).alias("y1"))
    j = F.explode(F.sequence(F.lit(0), F.col("rows"))).alias("j")
    across = base.select("image_id", "ch", j).select("image_id", F.lit("row").alias("kind"), F.lit(0).alias("i"), "j", C.num(0).alias("x0"), F.least(F.col("j") * F.col("ch"), C.num(1)).alias("y0"), C.num(1).alias("x1"), F.least(F.col("j") * F.col("ch"), C.num(1)).alias("y1"))
    out = down.unionByName(across)
    if diagonals:
        cells = base.select("*", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("j"))
        x0, y0 = F.col("i") * F.col("cw"), F.col("j") * F.col("ch")
        x1, y1 = F.least(x0 + F.col("cw"), C.num(1)), F.least(y0 + F.col("ch"), C.num(1))
        inside = cells.select("image_id", "i", "j", x0.alias("l"), y0.alias("t"), x1.alias("r"), y1.alias("b")).where("r > l and b > t")
        for kind, a, b in (("falling", "t", "b"), ("rising", "b", "t")):
            out = out.unionByName(inside.select("image_id", F.lit(kind).alias("kind"), "i", "j", F.col("l").alias("x0"), F.col(a).alias("y0"), F.col("r").alias("x1"), F.col(b).alias("y1")))
    return out.where("x0 <> x1 or y0 <> y1")


def contour_cells(field: DataFrame, levels: list[float] | Column, cutoff: float = 1.0) -> DataFrame:
    """Cells that a level crosses, with corner values and case index (8 top left, 4 top right, 2 bottom right, 1 bottom left below it).

    ``field`` is (image_id, x, y, v), with an array of the image's own levels where ``levels`` names one. Corners come from the next pixel of the row and the next row, two windows and no join.
    """
    right = Window.partitionBy("image_id", "y").orderBy("x")
    below = Window.partitionBy("image_id", "x").orderBy("y")
    wide = field.withColumn("tr", F.lead("v").over(right))
    cells = wide.withColumns({"bl": F.lead("v").over(below), "br": F.lead("tr").over(below)}).withColumnRenamed("v", "tl").dropna(subset=["tr", "bl", "br"])
    cells = cells.where(~((F.col("tl") >= cutoff) & (F.col("tr") >= cutoff) & (F.col("bl") >= cutoff) & (F.col("br") >= cutoff)))
    own = levels if isinstance(levels, Column) else F.array(*[C.num(t) for t in levels])
    each = cells.select("image_id", "x", "y", "tl", "tr", "bl", "br", F.posexplode(own).alias("level", "t"))
    case = sum(((F.col(c) < F.col("t")).cast("int") * w for c, w in (("tr", 4), ("br", 2), ("bl", 1))), (F.col("tl") < F.col("t")).cast("int") * 8)
    return each.withColumn("case_index", case).where((F.col("case_index") > 0) & (F.col("case_index") < 15))


def contour_levels(lo: float, hi: float, n: int, cutoff: float = 1.0) -> list[float]:
    hi = min(cutoff, hi)
    return [lo + (hi - lo) * (i + 1) / (n + 1) for i in range(n)]


def _cut(t: Column, a: Column, b: Column) -> Column:
    return F.when(F.abs(b - a) > 1e-12, C.clamp((t - a) / (b - a))).otherwise(C.num(0.5))


#: Bits of a case by corner, each named by the two edges that meet there, and the corners at the ends of each edge.
CORNERS = {"TL": 8, "TR": 4, "BR": 2, "LB": 1}
ENDS = {"T": (8, 4), "L": (8, 1), "B": (1, 2), "R": (4, 2)}


def crossings(case: int) -> tuple[list[str], list[str]]:
    """Pairs of edges that a case joins, where the mean of the corners is below the level and where it is not.

    An edge is crossed where its ends differ. Where all four are, lines cut off the corners on the mean's side of the level.
    """
    edges = [e for e, (p, q) in ENDS.items() if bool(case & p) != bool(case & q)]
    if len(edges) == 2:
        return ["".join(edges)], ["".join(edges)]
    return [c for c, bit in CORNERS.items() if case & bit], [c for c, bit in CORNERS.items() if not case & bit]


def contour_segments(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Line segments of crossed cells, in 0..1 of a field of ``width`` x ``height`` cells."""
    t, tl, tr, bl, br, x, y = (F.col(c) for c in ("t", "tl", "tr", "bl", "br", "x", "y"))
    points = {
        "T": F.struct((x + _cut(t, tl, tr)).cast("double").alias("x"), y.cast("double").alias("y")),
        "B": F.struct((x + _cut(t, bl, br)).cast("double").alias("x"), (y + 1).cast("double").alias("y")),
        "L": F.struct(x.cast("double").alias("x"), (y + _cut(t, tl, bl)).cast("double").alias("y")),
        "R": F.struct((x + 1).cast("double").alias("x"), (y + _cut(t, tr, br)).cast("double").alias("y")),
    }

    def pairs(*edges: str) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("seg"), points[e[0]].alias("a"), points[e[1]].alias("b")) for i, e in enumerate(edges)])

    case = F.col("case_index")
    low = (tl + tr + bl + br) / 4.0 < t
    out = F.when(F.lit(False), pairs("TL"))
    for k in range(1, 15):
        below, above = crossings(k)
        out = out.when((case == k) & low, pairs(*below)).when(case == k, pairs(*above))
    rows = cells.select("image_id", "level", "x", "y", F.explode(out).alias("s"))
    segs = rows.select(
        "image_id", "level", F.col("x").alias("cell_x"), F.col("y").alias("cell_y"), "s.seg",
        *[C.rounded(F.col(f"s.{p}.{c}") / float(n)).alias(f"{c}{i}") for i, p in enumerate("ab") for c, n in (("x", width), ("y", height))],
    )
    return segs.where("x0 <> x1 or y0 <> y1")


def tone(luminance: Column) -> Column:
    """Black or white, whichever is further from the luminance; black on ties, white where there is none."""
    return F.when(luminance.isNull(), "white").when(F.abs(luminance - 0.0) >= F.abs(luminance - 1.0), "black").otherwise("white")


def line_tone_runs(samples: DataFrame) -> DataFrame:
    """Consecutive chunks of equal tone along each line merged: samples are (image_id, line, chunk, luminance)."""
    along = Window.partitionBy("image_id", "line").orderBy("chunk")
    toned = samples.withColumn("tone", tone(F.col("luminance")))
    starts = toned.withColumn("new", F.coalesce((F.col("tone") != F.lag("tone").over(along)).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("new").over(along).cast("int"))
    return runs.groupBy("image_id", "line", "run").agg(F.min("tone").alias("tone"), F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"))


def catmull_rom(points: DataFrame, steps: int = 6) -> DataFrame:
    """Points of open chains (chain, i, px, py) with ``steps`` spline points after each but the last; ends are reflected."""
    along = Window.partitionBy("chain").orderBy("i")

    def at(c: str, k: int) -> Column:
        return (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(along) if k > 0 else F.lag(c, -k).over(along)

    rows = points
    for c in ("px", "py"):
        rows = rows.withColumns({f"{c}0": at(c, -1), f"{c}2": at(c, 1), f"{c}3": at(c, 2)})
    rows = rows.where(F.col("px2").isNotNull())
    each = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    t = F.col("step") / float(steps)

    def value(c: str) -> Column:
        p1, p2 = F.col(c), F.col(f"{c}2")
        p0, p3 = F.coalesce(F.col(f"{c}0"), 2.0 * p1 - p2), F.coalesce(F.col(f"{c}3"), 2.0 * p2 - p1)
        return 0.5 * (2.0 * p1 + (p2 - p0) * t + (2.0 * p0 - 5.0 * p1 + 4.0 * p2 - p3) * t * t + (3.0 * p1 - p0 - 3.0 * p2 + p3) * t * t * t)

    return each.select("chain", "i", "step", C.rounded(value("px")).alias("px"), C.rounded(value("py")).alias("py"))


CHAINS = "image_id bigint, level int, first int, i int, px double, py double, closed boolean"


def walk(ends: list[tuple]) -> list[tuple[int, list[tuple], bool]]:
    """Chains of segments, given by their end points: the first segment, the points and whether it is closed. Of several ways on, the first unused segment."""
    at: dict[tuple, deque[int]] = {}
    for s, pair in enumerate(ends):
        for p in pair:
            at.setdefault(p, deque()).append(s)
    used = [False] * len(ends)

    def onward(tip: tuple) -> tuple | None:
        """The other end of the first unused segment at ``tip``; used ones are forgotten on the way."""
        waiting = at[tip]
        while waiting:
            s = waiting.popleft()
            if not used[s]:
                used[s] = True
                return ends[s][1] if ends[s][0] == tip else ends[s][0]
        return None

    out = []
    for s, (a, b) in enumerate(ends):
        if used[s]:
            continue
        used[s] = True
        chain = deque((a, b))
        while (p := onward(chain[-1])) is not None:
            chain.append(p)
        while (p := onward(chain[0])) is not None:
            chain.appendleft(p)
        closed = chain[0] == chain[-1]
        if closed:
            chain.pop()
        out.append((s, [p for p, before in zip(chain, [None, *chain], strict=False) if p != before], closed))
    return out


def _walked(group: pd.DataFrame) -> pd.DataFrame:
    """Chains of one connected piece with points where more than two segments meet."""
    group = group.sort_values("s")
    numbers = group["s"].tolist()
    ends = [((a, b), (c, d)) for a, b, c, d in group[["ax", "ay", "bx", "by"]].to_numpy().tolist()]
    rows = [(numbers[s], i, x / QUANTUM, y / QUANTUM, closed) for s, points, closed in walk(ends) for i, (x, y) in enumerate(points)]
    out = pd.DataFrame(rows, columns=["first", "i", "px", "py", "closed"])
    out.insert(0, "level", group["level"].iloc[0])
    out.insert(0, "image_id", group["image_id"].iloc[0])
    return out


def _ranked(segs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chains of pieces in which no more than two segments meet at a point, by list ranking.

    A segment is two darts, 2s from its first end to its second and 2s + 1 back. The dart before a dart is the one that arrives where it leaves, along the
    other segment there. Before the two darts of a piece's first segment there is none, which cuts closed pieces open. Every round doubles the way to
    the dart that each knows: after as many rounds as the longest chain's length has bits, all know the first dart of their way and how far it is.
    """
    both = nodes.where(F.size("at") == 2).select(*LEVEL, F.explode(F.array(F.struct(F.col("at")[0].alias("x"), F.col("at")[1].alias("y")), F.struct(F.col("at")[1].alias("x"), F.col("at")[0].alias("y")))).alias("p"))
    before = both.select(*LEVEL, (2 * F.col("p.x.s") + F.col("p.x.side")).alias("dart"), (2 * F.col("p.y.s") + 1 - F.col("p.y.side")).alias("before"))
    way = F.explode(F.array(F.struct(F.lit(0).alias("dir"), F.col("bx").alias("x"), F.col("by").alias("y")), F.struct(F.lit(1).alias("dir"), F.col("ax").alias("x"), F.col("ay").alias("y"))))
    darts = segs.select(*LEVEL, "s", "piece", way.alias("w")).select(*LEVEL, "piece", (2 * F.col("s") + F.col("w.dir")).alias("dart"), "w.x", "w.y").join(before.hint("merge"), [*LEVEL, "dart"], "left")
    starts = F.col("before").isNull() | (F.floor(F.col("dart") / 2) == F.col("piece"))
    darts = stored(darts.select(*LEVEL, "piece", "dart", "x", "y", F.when(starts, F.col("dart")).otherwise(F.col("before")).alias("root"), (~starts).cast("int").alias("far"), F.col("before").isNull().alias("tip")), "darts")
    known = darts.select(*LEVEL, "dart", "root", "far")
    while True:
        step = known.toDF(*LEVEL, "root", "next", "more")
        known = stored(known.join(step.hint("merge"), [*LEVEL, "root"]).select(*LEVEL, "dart", F.col("next").alias("root"), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("open")), "darts-known")
        if known.where("open").isEmpty():
            break
        known = known.drop("open")
    found = darts.drop("root", "far").join(known.hint("merge"), [*LEVEL, "dart"])
    piece = Window.partitionBy(*LEVEL, "piece")
    closed = ~F.max("tip").over(piece)
    found = found.withColumn("closed", closed).withColumn("n", F.count(F.lit(1)).over(piece) / 2)
    on, back = F.col("root") == 2 * F.col("piece"), F.col("root") == 2 * F.col("piece") + 1
    # the way on leads to places 1, 2 ... and, if closed, at last to the first place again; the way back to 0, -1 ...
    placed = found.withColumn("place", F.when(on, F.col("far") + 1).when(back, -F.col("far"))).where(F.when(F.col("closed"), (on & (F.col("far") < F.col("n") - 1)) | (back & (F.col("far") == 0))).otherwise(on | back))
    i = F.row_number().over(piece.orderBy("place")) - 1
    return placed.select(*LEVEL, F.col("piece").cast("int").alias("first"), i.cast("int").alias("i"), (F.col("x") / QUANTUM).alias("px"), (F.col("y") / QUANTUM).alias("py"), "closed")


LEVEL = ["image_id", "level"]
#: End points are equal where they are so in ten-thousandths.
QUANTUM = 10_000


def contour_chains(segments: DataFrame) -> DataFrame:
    """Segments of each image and level joined at equal end points (to 1/10000) into chains of points; a closed one names its first point once.

    A chain starts with its first segment, by cell and place in it, goes on from its second end, then back from its first. Chains are numbered by their
    first segments. A connected piece is ranked as a whole by joins; only one with a point of more than two segments, or a segment of no
    length, is walked segment by segment, in a group of its own.
    """
    order = Window.partitionBy(*LEVEL).orderBy("cell_y", "cell_x", "seg")
    ends = {f"{p}{c}": F.rint(F.col(f"{c}{i}") * QUANTUM).cast("long") for i, p in enumerate("ab") for c in "xy"}
    segs = stored(segments.select(*LEVEL, (F.row_number().over(order) - 1).alias("s"), *[v.alias(k) for k, v in ends.items()]), "segments")
    side = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for i, p in enumerate("ab")]))
    at = segs.select(*LEVEL, "s", side.alias("e")).groupBy(*LEVEL, "e.x", "e.y").agg(F.sort_array(F.collect_list(F.struct("s", "e.side"))).alias("at"))
    nodes = stored(at, "segment-ends")
    edges = nodes.where(F.size("at") > 1).select(*LEVEL, F.col("at")[0]["s"].alias("a"), F.explode(F.slice("at", 2, F.size("at") - 1)).alias("t"))
    pieces = graph.components(edges.select(*LEVEL, "a", F.col("t.s").alias("b")), LEVEL)
    segs = stored(segs.join(pieces.withColumnRenamed("node", "s").hint("merge"), [*LEVEL, "s"], "left").withColumn("piece", F.coalesce("component", "s")).drop("component"), "segments")
    meet = nodes.where((F.size("at") > 2) | (F.col("at")[0]["s"] == F.get("at", F.lit(1))["s"])).select(*LEVEL, F.col("at")[0]["s"].alias("s"))
    branched = stored(segs.join(meet.hint("merge"), [*LEVEL, "s"]).select(*LEVEL, "piece").distinct(), "segments-meeting")
    walked = segs.join(branched.hint("merge"), [*LEVEL, "piece"], "left_semi").groupBy(*LEVEL, "piece").applyInPandas(_walked, CHAINS)
    simple = segs.join(branched.hint("merge"), [*LEVEL, "piece"], "left_anti")
    inside = nodes.join(simple.select(*LEVEL, "s").hint("merge"), [F.col("at")[0]["s"] == F.col("s"), *[nodes[c] == simple[c] for c in LEVEL]], "left_semi")
    chains = _ranked(simple, inside).unionByName(walked)
    number = F.dense_rank().over(Window.partitionBy(*LEVEL).orderBy("first")) - 1
    return chains.select(*LEVEL, number.cast("int").alias("chain"), "i", "px", "py", "closed")


def smoothed(chains: DataFrame, steps: int = 6, *keys: str) -> DataFrame:
    """Chains (``keys``, chain, i, px, py, closed) with ``steps`` spline points after each point but the last of an open one.

    Open ends are reflected, closed chains go round. Chains of two points stay as they are.
    """
    keys = (*(keys or ("image_id", "level")), "chain")
    whole = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    along = Window.partitionBy(*keys).orderBy("i")
    rows = chains.withColumns({"n": F.count(F.lit(1)).over(whole), "rank": F.row_number().over(along)})
    for c in ("px", "py"):
        first, last, second = F.first(c).over(whole), F.last(c).over(whole), F.nth_value(c, 2).over(whole)
        here, after = F.col(c), F.coalesce(F.lead(c).over(along), F.when(F.col("closed"), first))
        before = F.coalesce(F.lag(c).over(along), F.when(F.col("closed"), last).otherwise(2.0 * here - after))
        turn = F.when(F.col("rank") == F.col("n"), second).otherwise(first)
        further = F.coalesce(F.lead(c, 2).over(along), F.when(F.col("closed"), turn).otherwise(2.0 * after - here))
        rows = rows.withColumns({f"{c}0": before, f"{c}2": after, f"{c}3": further})
    curve = F.col("px2").isNotNull() & (F.col("n") > 2)
    each = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.when(curve, F.lit(steps - 1)).otherwise(F.lit(0)))))
    t = F.col("step") / float(steps)

    def value(c: str) -> Column:
        p0, p1, p2, p3 = (F.col(f"{c}{k}") for k in ("0", "", "2", "3"))
        bent = 0.5 * (2.0 * p1 + (p2 - p0) * t + (2.0 * p0 - 5.0 * p1 + 4.0 * p2 - p3) * t * t + (3.0 * p1 - p0 - 3.0 * p2 + p3) * t * t * t)
        return C.clamp(F.when(F.col("step") == 0, p1).otherwise(bent))

    return each.select(*keys, "i", "step", C.rounded(value("px")).alias("px"), C.rounded(value("py")).alias("py"), "closed")


def chain_segments(points: DataFrame) -> DataFrame:
    """Segments (image_id, kind, i, j, x0, y0, x1, y1) between the points of smoothed chains; a closed one also has the one back to its first point."""
    along = Window.partitionBy(*LEVEL, "chain").orderBy("i", "step")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    number = F.dense_rank().over(Window.partitionBy("image_id").orderBy("level", "chain")) - 1
    to = {f"{c}1": F.coalesce(F.lead(f"p{c}").over(along), F.when(F.col("closed"), F.first(f"p{c}").over(whole))) for c in "xy"}
    rows = points.withColumns(to | {"chain_": number, "j": F.row_number().over(along) - 1}).where("x1 is not null and (px <> x1 or py <> y1)")
    return rows.select("image_id", F.lit("contour").alias("kind"), F.col("chain_").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("px").alias("x0"), F.col("py").alias("y0"), "x1", "y1")


def corners(last: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` points that span 0..``last`` the first neighbours along one axis and the weights of the second."""
    place = np.round(np.arange(n) * last / max(1, n - 1), 9)
    low = np.minimum(np.floor(place), max(last - 1, 0)).astype(np.int64)
    return low, place - low


#: Rows of a field that are resampled at once.
BAND = 64


def resampled(field: DataFrame, width: int = 201, height: int = 201) -> DataFrame:
    """A field (image_id, x, y, v) at ``width`` x ``height`` points that span it, linear between its own points; those that are missing add nothing.

    A band of rows, with the first row of the band behind it, is one group, which makes the points that begin in it by arrays. No points are joined.
    """
    size = field.groupBy("image_id").agg(F.max("x").alias("wide"), F.max("y").alias("high"))
    bands = F.array_distinct(F.array(F.floor(F.col("y") / BAND), F.floor(F.greatest(F.col("y") - 1, F.lit(0)) / BAND)))
    placed = field.select("image_id", "x", "y", "v", F.explode(bands).alias("band")).join(size.hint("merge"), "image_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["v"].notna().to_numpy()]
        if not len(group):
            return pd.DataFrame({"image_id": [], "x": [], "y": [], "v": []})
        band, wide, high = (int(group[c].iloc[0]) for c in ("band", "wide", "high"))
        shape = (BAND + 1, wide + 2)  # a column behind the last, for weights of 0
        at = (group["y"].to_numpy() - band * BAND) * shape[1] + group["x"].to_numpy()
        count = np.bincount(at, minlength=shape[0] * shape[1]).reshape(shape)
        value = np.bincount(at, group["v"].to_numpy(float), shape[0] * shape[1]).reshape(shape)
        (fx, sx), (fy, sy) = corners(wide, width), corners(high, height)
        y = np.flatnonzero(fy // BAND == band)
        top, across, down = (fy[y] - band * BAND)[:, None], sx[None], sy[y][:, None]
        total, known = np.zeros((len(y), width)), np.zeros((len(y), width), np.int64)
        for below, wy in ((0, 1.0 - down), (1, down)):
            for right, wx in ((0, 1.0 - across), (1, across)):
                total += value[top + below, fx[None] + right] * wx * wy
                known += count[top + below, fx[None] + right]
        i, j = np.nonzero(known)
        return pd.DataFrame({"image_id": group["image_id"].iloc[0], "x": j.astype(np.int32), "y": y[i].astype(np.int32), "v": total[i, j]})

    return placed.groupBy("image_id", "band").applyInPandas(run, "image_id bigint, x int, y int, v double")


def line_colors(segments: DataFrame, pixels: DataFrame, style: str = "auto", custom: str = "#000000FF") -> DataFrame:
    """Segments (image_id, kind, i, j, x0, y0, x1, y1) with a colour; in the style "auto" cut where the contrasting tone changes.

    "auto" looks at chunks of at most 48 pixels: the mean luminance of 3 x 3 pixels at points 8 pixels apart along the chunk.
    """
    if style != "auto":
        return segments.withColumn("color", F.lit({"black": "#000000FF", "white": "#FFFFFFFF", "custom": custom}[style]))
    size = pixels.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    key = ["image_id", "kind", "i", "j"]
    px, py = (F.col("x1") - F.col("x0")) * F.col("mx"), (F.col("y1") - F.col("y0")) * F.col("my")
    rows = segments.join(size.hint("merge"), "image_id").withColumn("length", F.round(F.sqrt(px * px + py * py), 9))
    longest = F.least(C.num(48), F.greatest(C.num(1), F.least("mx", "my") + 1.0))
    rows = rows.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("length") / longest)).cast("int"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("span", F.col("length") / F.col("chunks"))
    rows = rows.withColumn("samples", F.greatest(F.lit(1), F.ceil(F.round(F.col("span") / 8.0, 9))).cast("int"))
    rows = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("samples") - 1)))
    along = (F.col("chunk") + (F.col("s") + 0.5) / F.col("samples")) / F.col("chunks")
    near = F.when(F.col("span") < 3, F.array(F.lit(0))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    rows = rows.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))

    def at(c: str) -> Column:
        place = (F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * along) * F.col(f"m{c}")
        return F.greatest(F.lit(0), F.least(F.col(f"m{c}"), F.floor(F.round(place + 0.5, 9)).cast("int") + F.col(f"d{c}")))

    light = C.dot((0.2126, 0.7152, 0.0722), C.linear_rgb(F.col("r"), F.col("g"), F.col("b")))
    looked = pixels.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), light.alias("light"))
    rows = rows.select(*key, "x0", "y0", "x1", "y1", "chunk", "chunks", at("x").alias("sx"), at("y").alias("sy")).join(looked.hint("merge"), ["image_id", "sx", "sy"])
    means = rows.groupBy(*key, "x0", "y0", "x1", "y1", "chunk", "chunks").agg(F.round(F.avg("light"), 9).alias("luminance"))
    order = Window.partitionBy(*key).orderBy("chunk")
    toned = means.withColumn("tone", tone(F.col("luminance")))
    toned = toned.withColumn("run", F.sum(F.coalesce((F.col("tone") != F.lag("tone").over(order)).cast("int"), F.lit(1))).over(order).cast("int"))
    cut = toned.groupBy(*key, "x0", "y0", "x1", "y1", "chunks", "run", "tone").agg(F.min("chunk").alias("a"), (F.max("chunk") + 1).alias("b"))

    def end(c: str, which: str) -> Column:
        return C.rounded(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col(which) / F.col("chunks"))

    color = F.when(F.col("tone") == "black", "#000000FF").otherwise("#FFFFFFFF").alias("color")
    return cut.select(*key, "run", end("x", "a").alias("x0"), end("y", "a").alias("y0"), end("x", "b").alias("x1"), end("y", "b").alias("y1"), color)


def average_luminance(pixels: DataFrame, most: int = 4096) -> DataFrame:
    """Mean luminance of each image over a grid of about ``most`` pixels: every k-th of every k-th row."""
    step = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("mx") * F.col("my") / float(most)))).cast("int")
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("mx"), (F.max("y") + 1).alias("my")).select("image_id", step.alias("step"))
    light = C.dot((0.2126, 0.7152, 0.0722), C.linear_rgb(F.col("r"), F.col("g"), F.col("b")))
    return pixels.join(size.hint("merge"), "image_id").where("x % step = 0 and y % step = 0").groupBy("image_id").agg(F.avg(light).alias("luminance"))
