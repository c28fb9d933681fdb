"""Palettes of recipes: assignment, merging, pruning and the end-to-end builder.

A ``recipe`` row is (image_id, recipe_id, components array of (pid, concentration), ok_l, ok_a, ok_b, cnt, importance). ``build`` makes
at most 48 recipes an image; the greedy steps, whose outcome depends on their order, run as one group per image. Distances are Euclidean
in Oklab unless a lightness weight is named.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.operators import cluster, mixsearch, presets, spectral
from chromaframe.sources.store import stored

LAB = list(C.LAB)
#: Colours under this chroma are neutral; hues of anchors lie so far apart; loss at which pruning ends; squared move that
#: calls for a new recipe.
NEUTRAL = 0.04
HUE_GAP = 0.55
LEAST_LOSS = 0.005
MOVED = 1e-4
RECIPE = "image_id bigint, recipe_id int, components array<struct<pid:int,concentration:double>>, ok_l double, ok_a double, ok_b double, cnt bigint, importance double"


def assignment_l_weight(clusters: DataFrame) -> DataFrame:
    """Per image, 1 where every colour is neutral, else 0.3."""
    c = F.max(C.chroma(F.col("ok_a"), F.col("ok_b")))
    return clusters.groupBy("image_id").agg(F.when(c < 0.01, C.num(1)).otherwise(C.num(0.3)).alias("l_weight"))


def nearest_recipe(colors: DataFrame, recipes: DataFrame, l_weight: float = 0.3) -> DataFrame:
    """Recipe id nearest to each colour of the same image, the lowest on ties, 0 where an image has none."""
    packed = recipes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("recipe_id", *LAB))).alias("all"))
    p = [F.col(c) for c in LAB]

    def option(r: Column) -> Column:
        return F.struct(F.round(C.distance2(p, [r[n] for n in LAB], l_weight), 9).alias("d"), r["recipe_id"].alias("id"))

    best = F.array_min(F.transform("all", option))["id"]
    return colors.join(packed, "image_id", "left").withColumn("recipe_id", F.coalesce(best, F.lit(0))).drop("all")


def value_anchors(recipes: DataFrame) -> DataFrame:
    """Darkest, lightest and most neutral recipe of each image, among those with more than 1 % of its pixels; only a neutral one is most neutral."""
    total = recipes.groupBy("image_id").agg(F.sum("cnt").alias("total"))
    rows = recipes.join(total, "image_id").where(F.col("cnt") > F.col("total") * 0.01)
    light, c = F.round("ok_l", 9), F.round(C.chroma(F.col("ok_a"), F.col("ok_b")), 9)
    return rows.groupBy("image_id").agg(
        F.min(F.struct(light, "recipe_id"))["recipe_id"].alias("darkest"),
        F.min(F.struct(-light, F.col("recipe_id").alias("recipe_id")))["recipe_id"].alias("lightest"),
        F.min(F.when(c < NEUTRAL, F.struct(c, F.col("recipe_id").alias("recipe_id"))))["recipe_id"].alias("most_neutral"),
    )


def chroma_anchors(recipes: DataFrame) -> DataFrame:
    """Recipes at either end of the a and b axes, among coloured ones with more than 0.2 % of the pixels."""
    total = recipes.groupBy("image_id").agg(F.sum("cnt").alias("total"))
    c = C.chroma(F.col("ok_a"), F.col("ok_b"))
    rows = recipes.join(total, "image_id").where((F.col("cnt") > F.col("total") * 0.002) & (c >= 0.04))

    def end(name: str, sign: int) -> Column:
        return F.min(F.struct(F.round(sign * F.col(name), 9).alias("v"), F.col("recipe_id").alias("recipe_id")))["recipe_id"]

    return rows.groupBy("image_id").agg(end("ok_a", 1).alias("least_a"), end("ok_a", -1).alias("most_a"), end("ok_b", 1).alias("least_b"), end("ok_b", -1).alias("most_b"))


def signature(components: Column) -> Column:
    """Pigments with their amounts in eighths, as text."""
    parts = F.array_sort(F.transform(components, lambda c: F.concat_ws(":", c["pid"].cast("string"), F.floor(c["concentration"] * 8 + 0.5).cast("string"))))
    return F.array_join(parts, "|")


def deduplicated(recipes: DataFrame) -> DataFrame:
    """The first recipe of each signature, with the ids that it stands for."""
    return recipes.withColumn("signature", signature(F.col("components"))).groupBy("image_id", "signature").agg(F.min("recipe_id").alias("recipe_id"), F.sort_array(F.collect_list("recipe_id")).alias("members"))


def clipped(recipes: DataFrame, bound: float = 0.05) -> DataFrame:
    return recipes.where(F.round("delta_e", 9) > bound)


def tube_scores(recipes: DataFrame) -> DataFrame:
    """Sum of concentration * count * salience per pigment."""
    parts = recipes.select("image_id", "cnt", "salience", F.explode("components").alias("c"))
    return parts.groupBy("image_id", "c.pid").agg(F.sum(F.col("c.concentration") * F.col("cnt") * F.col("salience")).alias("score"))


def palette_report(labelled: DataFrame, recipes: DataFrame) -> DataFrame:
    """Pixel count and share of every palette entry, with its colour as text."""
    counts = labelled.groupBy("image_id", F.col("label").alias("recipe_id")).agg(F.count(F.lit(1)).alias("n_pixels"))
    total = counts.groupBy("image_id").agg(F.sum("n_pixels").alias("total"))
    rgb = C.rgb_bytes([F.col(c) for c in LAB])
    named = recipes.select("image_id", "recipe_id", C.hex_color(*rgb, F.lit(255)).alias("hex"))
    rows = named.join(counts, ["image_id", "recipe_id"], "left").join(total, "image_id")
    return rows.select("image_id", "recipe_id", "hex", F.coalesce("n_pixels", F.lit(0)).cast("long").alias("n_pixels"), C.rounded(F.coalesce("n_pixels", F.lit(0)) / F.col("total")).alias("share"))


def select_tubes(scores: DataFrame, tones: DataFrame, most: int) -> DataFrame:
    """Per image the pigments of the largest scores, at most ``most``, with their ``place``: of two neighbours in the order within a tenth, the one whose masstone lies farther from those taken goes first."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "pid"], ascending=[False, True]).reset_index(drop=True)
        score, lab, pid = group["score"].tolist(), group[LAB].to_numpy(float), group["pid"].tolist()
        order = list(range(len(score)))
        taken: list[int] = []

        def gap(i: int) -> float:
            return min((((lab[i] - lab[t]) ** 2).sum() for t in taken), default=0.0)

        for at in range(min(most, len(order))):
            if at + 1 < len(order) and score[order[at + 1]] >= score[order[at]] * 0.9 and gap(order[at + 1]) > gap(order[at]):
                order[at], order[at + 1] = order[at + 1], order[at]
            taken.append(order[at])
        return pd.DataFrame({"image_id": group["image_id"].iloc[0], "pid": [pid[t] for t in taken], "place": range(len(taken))})

    rows = scores.where("score > 0").join(tones.select("pid", *LAB), "pid").select("image_id", "pid", "score", *LAB)
    return rows.groupBy("image_id").applyInPandas(run, "image_id bigint, pid int, place int")


def unselected(pigments: DataFrame, tubes: DataFrame) -> DataFrame:
    """Per image the pigments that its tubes leave."""
    return tubes.select("image_id").distinct().join(pigments.select("pid"), F.lit(True)).join(tubes.select("image_id", "pid"), ["image_id", "pid"], "left_anti")


class InnerMixes:
    """Colours of the mixes of sets of one to three pigments in which every paint has an amount, each set's worked out once for all images of a worker.

    Triples of up to ``most`` pigments are kept (76,076 of 78: 38 MB), those of larger tables made anew.
    """

    def __init__(self, pigments: spectral.Pigments, most: int = 100):
        self.pigments = pigments
        inner = [spectral.steps(n, False) for n in (2, 3)]
        self.amounts = [np.array([(8,)]), inner[0][:, :2], inner[1]]
        self.most, self.at, self.lab = most, {}, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"at": {}, "lab": {}}

    def _made(self, places: np.ndarray) -> np.ndarray:
        amounts = self.amounts[places.shape[1] - 1]
        return self.pigments.mixes(np.repeat(places, len(amounts), axis=0), np.tile(amounts, (len(places), 1))).reshape(len(places), len(amounts), 3)

    def of(self, places: np.ndarray) -> np.ndarray:
        """Colours (set, mix, 3) of sets given by ascending places."""
        n, size = places.shape[1], len(self.pigments.pid)
        if size > self.most:
            return self._made(places)
        if n not in self.at:
            every = np.array(list(itertools.combinations(range(size), n)))
            at = np.zeros((size,) * n, np.int32)
            at[tuple(every.T)] = np.arange(len(every))
            self.at[n], self.lab[n] = at, np.concatenate([self._made(every[i : i + 2048]) for i in range(0, len(every), 2048)])
        return self.lab[n][self.at[n][tuple(places.T)]]


class SubsetMinima:
    """Per colour the distance of the best mix of every set of one to ``paints`` pigments, each set's worked out when it is first asked for.

    The nearest mix of some tubes is the nearest among the sets of them, so the error of any tubes is a minimum over sets; a trial swap asks for the
    sets with the new tube alone, and no mix is ever looked at twice.
    """

    def __init__(self, pigments: spectral.Pigments, colors: np.ndarray, paints: int = 3, mixes: InnerMixes | None = None):
        self.colors, self.paints, self.mixes = colors, paints, mixes or InnerMixes(pigments)
        self.place = {int(p): i for i, p in enumerate(pigments.pid)}
        self.best: dict[tuple[int, ...], np.ndarray] = {}

    def sets(self, tubes: Iterable[int]) -> list[tuple[int, ...]]:
        """All sets of at most ``paints`` of some tubes."""
        tubes = sorted(p for p in tubes if p in self.place)
        return [c for n in range(1, self.paints + 1) for c in itertools.combinations(tubes, n)]

    def look(self, sets: list[tuple[int, ...]]) -> np.ndarray:
        """The distances (set, colour) of the best mixes of sets."""
        for n in range(1, self.paints + 1):
            new = [c for c in dict.fromkeys(sets) if len(c) == n and c not in self.best]
            for first in range(0, len(new), 2048):
                some = new[first : first + 2048]
                lab = self.mixes.of(np.array([[self.place[p] for p in c] for c in some]))
                d = np.empty((len(some), len(self.colors)))
                for i, c in enumerate(self.colors):
                    diff = (lab - c) ** 2
                    d[:, i] = (diff[..., 0] + spectral.chroma_weight(c) * (diff[..., 1] + diff[..., 2])).min(axis=1)
                self.best.update(zip(some, np.sqrt(np.round(d, 9)), strict=True))
        return np.array([self.best[c] for c in sets]).reshape(len(sets), len(self.colors))


def tube_error(minima: SubsetMinima, tubes: Iterable[int], weights: np.ndarray) -> float:
    """Weighted distances of colours to their nearest mixes of some tubes."""
    found = minima.look(minima.sets(tubes))
    return float(found.min(axis=0, initial=np.inf) @ weights)


def improve_tubes(tubes: list[int], pigments: list[int], minima: SubsetMinima, weights: np.ndarray) -> list[int]:
    """Swap one tube for one left out while that lowers the error by more than 0.001: the best swap each time, at most twice as often as there are tubes.

    What the tubes without one of them reach is one minimum a tube; a swap adds the sets that hold the new tube, those of all new tubes at once.
    """
    tubes = list(tubes)
    for _ in range(max(3, 2 * len(tubes))):
        least, best = tube_error(minima, tubes, weights), None
        others = [p for p in pigments if p not in tubes and p in minima.place]
        if not others:
            break
        with_one = [c for n in range(minima.paints) for c in itertools.combinations(sorted(t for t in tubes if t in minima.place), n)]
        new = minima.look([tuple(sorted((*c, p))) for p in others for c in with_one]).reshape(len(others), len(with_one), -1)
        errors = np.full((len(others), len(tubes)), np.inf)
        for i, gone in enumerate(tubes):
            left = minima.look(minima.sets(tubes[:i] + tubes[i + 1 :])).min(axis=0, initial=np.inf)
            mine = new[:, [gone not in c for c in with_one]].min(axis=1, initial=np.inf)
            errors[:, i] = np.minimum(left, mine) @ weights
        for at, p in enumerate(others):
            for i, error in enumerate(errors[at].tolist()):
                if error < least - 0.001:
                    best, least = [*tubes[:i], p, *tubes[i + 1 :]], error
        if best is None:
            break
        tubes = best
    return tubes


def improved_tubes(tubes: DataFrame, clusters: DataFrame, pigments: DataFrame, paints: int = 3) -> DataFrame:
    """``select_tubes`` of every image after ``improve_tubes`` for its clusters (k, lab, cnt, salience), among all ``pigments``."""
    shared = tubes.sparkSession.sparkContext.broadcast(InnerMixes(spectral.Pigments.of(pigments)))  # at most 255 rows

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.assign(w=right["cnt"] * right["salience"]).sort_values(["w", "k"], ascending=[False, True])
        found = left.sort_values("place")["pid"].astype(int).tolist()
        if found and len(right):
            mixes = shared.value
            found = improve_tubes(found, mixes.pigments.pid.tolist(), SubsetMinima(mixes.pigments, right[LAB].to_numpy(float), paints, mixes), right["w"].to_numpy(float))
        return pd.DataFrame({"image_id": (left if len(left) else right)["image_id"].iloc[0], "pid": found, "place": range(len(found))})

    return tubes.groupBy("image_id").cogroup(clusters.select("image_id", "k", *LAB, "cnt", "salience").groupBy("image_id")).applyInPandas(run, "image_id bigint, pid int, place int")


def palette_lines(report: DataFrame) -> DataFrame:
    """One line of text per palette entry (image_id, recipe_id, hex, n_pixels, share, mix, delta_e, clipped); entries without a mix are short."""

    def scalar(c: Column) -> Column:
        return presets.scalar_text(c, 3)

    mix = F.array_join(F.transform("mix", lambda c: F.concat_ws(" ", c["name"], F.concat(scalar(c["concentration"] * 100), F.lit("%")))), " + ")
    parts = [
        F.concat(F.lit("Swatch "), (F.col("recipe_id") + 1).cast("string")), F.col("hex"),
        F.concat(scalar(F.col("share") * 100), F.lit("% ("), F.col("n_pixels").cast("string"), F.lit(" px)")),
        F.when(F.size("mix") > 0, mix), F.when(F.size("mix") > 0, F.concat(F.lit("Delta E "), scalar(F.col("delta_e")))), F.when((F.size("mix") > 0) & F.col("clipped"), F.lit("Clipped")),
    ]
    return report.select("image_id", "recipe_id", F.concat_ws(" | ", *parts).alias("line"))


def band_recipes(sections: DataFrame, recipes: DataFrame) -> DataFrame:
    """The recipe of each band: that of the first palette index in it (image_id, idx, band)."""
    first = sections.where("band >= 0").groupBy("image_id", "band").agg(F.min("idx").alias("recipe_id"))
    return first.join(recipes, ["image_id", "recipe_id"], "left")


@dataclass(eq=False)
class Recipe:
    """A recipe inside a group kernel; ``members`` are the ids merged into it."""

    id: int
    parts: dict[int, float]
    lab: np.ndarray
    cnt: int
    importance: float
    members: list[int] = field(default_factory=list)


def _rows_to_recipes(group: pa.Table) -> list[Recipe]:
    group = group.sort_by("recipe_id").combine_chunks()
    parts = group.column("components").combine_chunks()
    parts = parts.chunk(0) if isinstance(parts, pa.ChunkedArray) else parts
    pids, amounts, ends = parts.values.field("pid").to_pylist(), parts.values.field("concentration").to_pylist(), parts.offsets.to_pylist()
    ids, cnt, importance = (group.column(c).to_pylist() for c in ("recipe_id", "cnt", "importance"))
    lab = np.stack([group.column(c).to_numpy() for c in LAB], axis=1)
    return [Recipe(i, dict(zip(pids[a:b], amounts[a:b], strict=True)), lab[n], cnt[n], float(importance[n]), [i]) for n, (i, a, b) in enumerate(zip(ids, ends, ends[1:]))]


def _distance(a: Recipe, b: Recipe) -> float:
    return float(np.sqrt(((a.lab - b.lab) ** 2).sum()))


def similar(a: Recipe, b: Recipe, color: float, concentration: float) -> bool:
    """Near colours, or the same pigments in near amounts."""
    if _distance(a, b) < color:
        return True
    return set(a.parts) == set(b.parts) and all(round(abs(v - b.parts[p]), 9) <= concentration for p, v in a.parts.items())


#: Recipes that are compared with one kept recipe at once.
AT_ONCE = 4096


def merge(recipes: list[Recipe], color: float = 0.015, concentration: float = 0.05) -> list[Recipe]:
    """Recipes folded into the first similar one before them; the larger lends its colour and amounts. Empty ones go to the nearest.

    What is ``similar`` to a kept recipe is worked out for many at once, when it is kept and again when it changes; each then takes the first that it is similar to.
    """
    kept: list[Recipe] = []
    full = [r for r in recipes if r.cnt > 0]
    sets: dict[tuple[int, ...], int] = {}
    for first in range(0, len(full), AT_ONCE):
        some = full[first : first + AT_ONCE]
        lab = np.array([r.lab for r in some])
        pids = [sorted(r.parts) for r in some]
        kind = np.array([sets.setdefault(tuple(p), len(sets)) for p in pids])
        widest = max(map(len, [*pids, *(k.parts for k in kept)]))
        amounts = np.array([[r.parts[q] for q in p] + [0.0] * (widest - len(p)) for r, p in zip(some, pids, strict=True)]).reshape(len(some), widest)
        alike = np.zeros((len(some), max(64, 2 * len(kept))), bool)

        def compared(i: int, start: int) -> None:
            k = kept[i]
            near = np.sqrt(((lab[start:] - k.lab) ** 2).sum(axis=1)) < color
            own = sorted(k.parts)
            mine = np.array([k.parts[q] for q in own] + [0.0] * (widest - len(own)))
            near |= (kind[start:] == sets[tuple(own)]) & (np.round(np.abs(amounts[start:] - mine), 9) <= concentration).all(axis=1)
            alike[start:, i] = near

        for i in range(len(kept)):
            compared(i, 0)
        for at, r in enumerate(some):
            if len(kept) == alike.shape[1]:
                alike = np.concatenate([alike, np.zeros_like(alike)], axis=1)
            i = int(alike[at].argmax())
            if not alike[at, i]:
                kept.append(replace(r, members=list(r.members)))
                compared(len(kept) - 1, at + 1)
                continue
            k, changes = kept[i], kept[i].cnt < r.cnt
            k.members.extend(r.members)
            lead = r if changes else k
            kept[i] = Recipe(k.id, lead.parts, lead.lab, k.cnt + r.cnt, k.importance + r.importance, k.members)
            if changes:
                compared(i, at + 1)
    if kept:
        lab = np.array([k.lab for k in kept])
        ids = np.array([k.id for k in kept])
        for r in (r for r in recipes if r.cnt <= 0):
            d = np.round(np.sqrt(((lab - r.lab) ** 2).sum(axis=1)), 9)
            same = np.flatnonzero(d == d.min())
            kept[int(same[ids[same].argmin()])].members.extend(r.members)
    return kept


def _chroma(r: Recipe) -> float:
    return math.hypot(r.lab[1], r.lab[2])


def _hue_gap(a: float, b: float) -> float:
    return min(abs(a - b), 2 * math.pi - abs(a - b))


def anchors(recipes: list[Recipe], shades: int) -> set[int]:
    """Ids that pruning keeps, at most max(2, ``shades``): extreme values and the most neutral, extremes of a and b, then hues apart."""
    most = min(len(recipes), max(2, shades))
    total = max(1, sum(r.cnt for r in recipes))
    found: list[Recipe] = []

    def add(some: list[Recipe], key) -> None:
        if some and len(found) < most and (best := min(some, key=key)) not in found:
            found.append(best)

    heavy = [r for r in recipes if r.cnt > max(1, total // 100)]
    add(heavy, lambda r: (r.lab[0], r.id))
    add(heavy, lambda r: (-r.lab[0], r.id))
    add([r for r in heavy if _chroma(r) < NEUTRAL], lambda r: (_chroma(r), r.id))
    colored = [r for r in recipes if r.cnt > max(1, total // 500) and r not in found and _chroma(r) >= NEUTRAL]
    score = {r.id: max(0.0, r.importance) * (1 + min(_chroma(r) / 0.2, 1)) for r in colored}
    for axis in (1, 2):
        for sign in (1, -1):
            add(colored, lambda r, axis=axis, sign=sign: (sign * r.lab[axis], sign * score[r.id], r.id))
    hues = [math.atan2(r.lab[2], r.lab[1]) for r in found if _chroma(r) >= NEUTRAL]
    for r in sorted(colored, key=lambda r: (-score[r.id], -_chroma(r), r.id)):
        hue = math.atan2(r.lab[2], r.lab[1])
        if r not in found and len(found) < most and all(_hue_gap(hue, h) >= HUE_GAP for h in hues):
            found.append(r)
            hues.append(hue)
    return {r.id for r in found}


def _survivors(recipes: list[Recipe], left: list[Recipe]) -> list[Recipe]:
    """``left`` with what was dropped from ``recipes`` added to the nearest of them."""
    out = {r.id: replace(r, members=list(r.members)) for r in left}
    lab, ids = np.array([r.lab for r in left]).reshape(-1, 3), np.array([r.id for r in left])
    for r in recipes:
        if r.id not in out:
            d = np.round(np.sqrt(((lab - r.lab) ** 2).sum(axis=1)), 9)
            same = np.flatnonzero(d == d.min())
            near = out[int(ids[same].min())]
            near.members.extend(r.members)
            near.cnt += r.cnt
            near.importance += r.importance
    return list(out.values())


def adaptive_prune(recipes: list[Recipe], shades: int, keep: set[int], bound: float = LEAST_LOSS) -> list[Recipe]:
    """Drop the least important recipe that is not kept, while its share of importance times its distance to the next stays under the bound."""
    total = max(1.0, sum(r.importance for r in recipes))
    lab = np.array([r.lab for r in recipes]).reshape(-1, 3)
    left = np.ones(len(recipes), bool)
    loose = sorted((i for i, r in enumerate(recipes) if r.id not in keep), key=lambda i: (round(recipes[i].importance, 9), recipes[i].id))
    for i in loose[: max(0, len(recipes) - max(2, shades))]:
        left[i] = False
        near = np.sqrt(((lab[left] - lab[i]) ** 2).sum(axis=1)).min()
        if recipes[i].importance * near / total >= bound:
            left[i] = True
            break
    return _survivors(recipes, [r for r, stays in zip(recipes, left, strict=True) if stays])


def prune_to(recipes: list[Recipe], shades: int) -> list[Recipe]:
    """Drop the least important until so many remain; anchors, found anew, stay."""
    if len(recipes) <= shades or shades <= 1:
        return recipes
    keep = anchors(recipes, shades)
    loose = sorted((r for r in recipes if r.id not in keep), key=lambda r: (round(r.importance, 9), r.id))
    gone = {r.id for r in loose[: len(recipes) - shades]}
    return _survivors(recipes, [r for r in recipes if r.id not in gone])


MEMBERS = RECIPE.replace("importance double", "importance double, members array<int>")


def _table(image_id: int, recipes: list[Recipe]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.struct({"pid": pa.int32(), "concentration": pa.float64()})), *[pa.float64()] * 3, pa.int64(), pa.float64(), pa.list_(pa.int32())]
    rows = [(image_id, r.id, [{"pid": p, "concentration": c} for p, c in sorted(r.parts.items())], *map(float, r.lab), r.cnt, r.importance, sorted(r.members)) for r in recipes]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["image_id", "recipe_id", "components", *LAB, "cnt", "importance", "members"])


def _grouped(recipes: DataFrame, make) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        return _table(group.column("image_id")[0].as_py(), make(_rows_to_recipes(group)))

    return recipes.select(*[c.split()[0] for c in RECIPE.split(", ")]).groupBy("image_id").applyInArrow(run, MEMBERS)


def merged(recipes: DataFrame) -> DataFrame:
    return _grouped(recipes, merge)


def merge_and_prune(recipes: list[Recipe], shades: int) -> list[Recipe]:
    recipes = merge(recipes)
    return prune_to(adaptive_prune(recipes, shades, anchors(recipes, shades)), shades)


def pruned(recipes: DataFrame, shades: int) -> DataFrame:
    """Merging, anchors, adaptive pruning and pruning to ``shades``."""
    return _grouped(recipes, lambda rows: merge_and_prune(rows, shades))


def _nearest(colors: np.ndarray, recipes: np.ndarray, l_weight: float) -> np.ndarray:
    """Place of the nearest recipe of every colour, the first on ties."""
    d = (colors[:, None] - recipes[None]) * np.array([l_weight, 1, 1])
    return np.round((d**2).sum(axis=2), 9).argmin(axis=1)


def _means(lab: np.ndarray, cnt: np.ndarray, target: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.bincount(target, cnt, n)
    sums = np.stack([np.bincount(target, cnt * lab[:, i], n) for i in range(3)], axis=1)
    return sums / np.maximum(total, 1)[:, None], total


class Unanswered(Exception):
    """Colours whose nearest mixes aren't known yet."""

    def __init__(self, colors: np.ndarray):
        super().__init__()
        self.colors = colors


class Answers:
    """The nearest mixes of the colours asked for so far."""

    def __init__(self, known: dict[tuple[float, float, float], spectral.Mix]):
        self.known = known

    def nearest_all(self, colors: np.ndarray) -> list[spectral.Mix]:
        keys = [tuple(c) for c in np.asarray(colors, float).reshape(-1, 3).tolist()]
        if open_ := [k for k in dict.fromkeys(keys) if k not in self.known]:
            raise Unanswered(np.array(open_))
        return [self.known[k] for k in keys]


def image_palette(clusters: pd.DataFrame, table: spectral.Mixes | mixsearch.Held | Answers, shades: int) -> pd.DataFrame:
    """Recipes of one image from its clusters (k, lab, cnt, salience): decompose, snap twice, merge, prune, refit, deduplicate."""
    clusters = clusters.sort_values("k")
    lab, cnt = clusters[LAB].to_numpy(float), clusters["cnt"].to_numpy(float)
    weight = 1.0 if np.hypot(lab[:, 1], lab[:, 2]).max() < 0.01 else 0.3
    mixes = table.nearest_all(lab)
    for _ in range(2):  # a recipe moves only where the colours that it stands for have moved
        now = np.array([m.lab for m in mixes])
        means, total = _means(lab, cnt, _nearest(lab, now, weight), len(mixes))
        moved = (total > 0) & (((means - now) ** 2).sum(axis=1) > MOVED)
        again = iter(table.nearest_all(means[moved]))
        mixes = [next(again) if m else old for m, old in zip(moved, mixes, strict=True)]
    target = _nearest(lab, np.array([m.lab for m in mixes]), weight)
    loads = np.bincount(target, cnt, len(mixes))
    importance = np.bincount(target, cnt * np.maximum(0.1, clusters["salience"].to_numpy(float)), len(mixes))
    rows = [Recipe(i, m.parts, np.array(m.lab), int(loads[i]), float(importance[i]), [i]) for i, m in enumerate(mixes)]
    kept = [r for r in merge_and_prune(rows, shades) if r.cnt > 0]
    refit = table.nearest_all(np.array([_means(lab, cnt, np.where(np.isin(target, r.members), 0, 1), 2)[0][0] for r in kept]))
    final: dict[tuple, spectral.Mix] = {}
    place: list[int] = []
    for mix in refit:
        sign = tuple(sorted((p, math.floor(c * 8 + 0.5)) for p, c in mix.parts.items()))
        place.append(list(final).index(sign) if sign in final else len(final))
        final.setdefault(sign, mix)
    # colours go to the refit recipes, of which equal ones are one
    label = np.array(place)[_nearest(lab, np.array([m.lab for m in refit]), weight)]
    out = []
    for i, mix in enumerate(final.values()):
        mine = label == i
        parts = [{"pid": p, "concentration": c} for p, c in sorted(mix.parts.items())]
        out.append((int(clusters["image_id"].iloc[0]), i, parts, *map(float, mix.lab), int(cnt[mine].sum()), mix.delta_e, mix.delta_e > 0.05, clusters["k"].to_numpy()[mine].tolist()))
    return pd.DataFrame(out, columns=_PALETTE_NAMES)


PALETTE = "image_id bigint, recipe_id int, components array<struct<pid:int,concentration:double>>, ok_l double, ok_a double, ok_b double, cnt bigint, delta_e double, clipped boolean, labels array<int>"
_PALETTE_NAMES = [c.split()[0] for c in PALETTE.split(", ")]
#: Times that an image asks for mixes: its clusters, two snaps, the refit.
ASKS = 4


def _known(found: pd.DataFrame) -> dict[tuple[float, float, float], spectral.Mix]:
    out = {}
    for r in found.itertuples():
        amounts = {int(p): a / 8.0 for p, a in ((r.i0, r.a0), (r.i1, r.a1), (r.i2, r.a2)) if a > 0}
        out[r.ask_l, r.ask_a, r.ask_b] = spectral.Mix(spectral.pruned_parts(amounts, 0.02), (r.ok_l, r.ok_a, r.ok_b), r.delta_e)
    return out


ASK = ", ".join(f"ask_{c[-1]} double" for c in LAB)


#: Images of a task that holds all mixes; each takes some hundredths of a second, so the few bytes of their clusters don't say how to deal them out.
HELD_IMAGES = 16


def _palettes_held(clusters: DataFrame, pigments: spectral.Pigments, paints: int, shades: int) -> DataFrame:
    """``palettes`` by tasks that each hold all mixes of the pigments."""
    tasks = max(1, -(-clusters.select("image_id").distinct().count() // HELD_IMAGES))
    shared = clusters.sparkSession.sparkContext.broadcast(_Once(pigments, paints))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return image_palette(group, shared.value.held(), shades)

    return stored(clusters.repartition(tasks, "image_id").groupBy("image_id").applyInPandas(run, PALETTE), "palettes")


class _Once:
    """Pigments whose mixes a worker makes when it first needs them."""

    def __init__(self, pigments: spectral.Pigments, paints: int):
        self.pigments, self.paints, self.made = pigments, paints, None

    def held(self) -> mixsearch.Held:
        if self.made is None:
            self.made = mixsearch.Held(self.pigments, self.paints)
        return self.made


def palettes(clusters: DataFrame, mixes: mixsearch.Index, shades: int) -> DataFrame:
    """``image_palette`` of every image, with ``labels``.

    An image's clusters, at most 48 rows, are one group, and never see the mix table: a group runs as far as it has answers and gives back the colours
    that it asks for next; these are searched in the index, all images at once, and the groups run again. Images are done after ``ASKS`` rounds.
    """
    asks = [c.split()[0] for c in ASK.split(", ")]

    def run(group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        try:
            return image_palette(group, Answers(_known(found)), shades).assign(**{c: None for c in asks})
        except Unanswered as e:
            out = pd.DataFrame(e.colors, columns=asks).assign(image_id=int(group["image_id"].iloc[0]))
            return out.reindex(columns=[*_PALETTE_NAMES, *asks]).astype({c: object for c in _PALETTE_NAMES[1:]}).replace({np.nan: None})

    groups = clusters.groupBy("image_id")
    answers = clusters.sparkSession.createDataFrame([], f"{mixsearch.NEAREST}, {ASK}")
    for _ in range(ASKS + 1):
        rows = stored(groups.cogroup(answers.groupBy("image_id")).applyInPandas(run, f"{PALETTE}, {ASK}"), "palettes")
        asked = rows.where(F.col(asks[0]).isNotNull()).select("image_id", *asks)
        if asked.isEmpty():
            return rows.drop(*asks)
        asked = asked.withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy(*asks)).cast("int"))
        found = mixsearch.nearest(asked.select("image_id", "k", *[F.col(a).alias(c) for a, c in zip(asks, LAB, strict=True)]), mixes)
        answers = stored(answers.unionByName(found.join(asked, ["image_id", "k"])), "palette-answers")
    raise RuntimeError("an image asked for mixes that the index does not hold")


def build(pixels_lab: DataFrame, pigments: DataFrame, shades: int = 8, paints: int = 3, spread: float = 0.0, held: int = mixsearch.HELD) -> tuple[DataFrame, DataFrame]:
    """Recipes of every image and the recipe of every pixel: over-cluster, decompose into mixes of at most ``paints`` pigments, then project.

    Pixels take part only in the histogram, one assignment, which is written once, and the last projection. Up to ``held`` mixes are held by tasks, more
    are searched in an index that Spark holds.
    """
    k = min(2 * max(2, shades), 48)
    labelled = stored(cluster.assign(pixels_lab, cluster.centers(cluster.histogram(pixels_lab), k, spread)), "palette-pixels")
    clusters = stored(cluster.salience(cluster.cluster_table(labelled, k)).where("cnt > 0").select("image_id", "k", *LAB, "cnt", "salience"), "palette-clusters")
    table = spectral.Pigments.of(pigments)
    if table.count(paints) <= held:
        final = _palettes_held(clusters, table, paints, shades)
    else:
        final = palettes(clusters, mixsearch.index(spectral.mix_table(pigments, paints), paints), shades)
    mapping = final.select("image_id", F.explode("labels").alias("label"), F.col("recipe_id").alias("target"))
    return final.drop("labels"), cluster.project_labels(labelled, mapping)
