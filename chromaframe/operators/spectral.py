"""Spectral pigment mixing (Kubelka-Munk) and the search for mixes near a colour."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaframe.functions import color as C

WAVELENGTHS = list(range(400, 701, 10))

#: XYZ to linear sRGB.
FROM_XYZ = [(3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252)]


def _lobe(w: float, mean: float, low: float, high: float) -> float:
    t = (w - mean) * (low if w < mean else high)
    return math.exp(-0.5 * t * t)


def observer(w: float) -> tuple[float, float, float]:
    """Colour-matching functions by the published multi-lobe Gaussian fit (Wyman, Sloan and Shirley, 2013)."""
    x = 0.362 * _lobe(w, 442.0, 0.0624, 0.0374) + 1.056 * _lobe(w, 599.8, 0.0264, 0.0323) - 0.065 * _lobe(w, 501.1, 0.0490, 0.0382)
    y = 0.821 * _lobe(w, 568.8, 0.0213, 0.0247) + 0.286 * _lobe(w, 530.9, 0.0613, 0.0322)
    z = 1.217 * _lobe(w, 437.0, 0.0845, 0.0278) + 0.681 * _lobe(w, 459.0, 0.0385, 0.0725)
    return x, y, z


def xyz_weights() -> list[list[float]]:
    """Per X, Y and Z, the weight of each wavelength under an equal-energy light, normalised by Y."""
    curves = list(zip(*(observer(w) for w in WAVELENGTHS), strict=True))
    norm = sum(curves[1])
    return [[v / norm for v in curve] for curve in curves]


def pigments_of_embeddings(embeddings: DataFrame) -> DataFrame:
    """Synthetic pigments for the sample tables: the vectors as absorption-to-scattering spectra, a number for each wavelength."""
    ks = F.transform(F.slice("embedding", 1, len(WAVELENGTHS)), lambda z: 0.02 + 4.0 * F.abs(z.cast("double")))
    pid = F.col("vec_id").cast("int")
    return embeddings.select(
        pid.alias("pid"), F.concat(F.lit("p"), pid.cast("string")).alias("id"), F.concat(F.lit("Pigment "), pid.cast("string")).alias("name"), (pid % 3 != 2).alias("essential"), ks.alias("k_over_s")
    )


def pigments_of_nations(nations: DataFrame, number: str = "n_nationkey") -> DataFrame:
    """A synthetic pigment of every nation, by ``number``: an absorption lobe at a place by its key, of a strength and width by its region."""
    place, key, region = F.col("n_nationkey"), F.col(number), F.col("n_regionkey").cast("double")
    lobes = [0.02 + 1.3 * (region + 1) * F.exp(-0.5 * F.pow((C.num(w - 400) - 12.5 * place) / (30.0 + 15 * region), C.num(2))) for w in WAVELENGTHS]
    return nations.select(key.alias("pid"), F.concat(F.lit("p"), key.cast("string")).alias("id"), F.col("n_name").alias("name"), (key % 3 != 2).alias("essential"), F.array(*lobes).alias("k_over_s"))


def pigments_of_nations_by_region(nations: DataFrame, regions: DataFrame) -> DataFrame:
    """Synthetic pigments of every nation in every region: ``pigments_of_nations`` as if each nation lay in each region in turn, numbered by nation, then region."""
    n = regions.count()
    every = nations.select("n_nationkey", "n_name").crossJoin(regions.select(F.col("r_regionkey").alias("n_regionkey")))
    pid = (F.col("n_nationkey") * n + F.col("n_regionkey")).cast("int")
    return pigments_of_nations(every.withColumns({"n_name": F.concat_ws(" ", "n_name", "n_regionkey"), "number": pid}), "number")


def pigment_fixture(spark: SparkSession) -> DataFrame:
    """A table of 78 synthetic pigments, the number of the reference: absorption lobes at 13 wavelengths in 6 strengths and widths."""
    rows = []
    for pid in range(78):
        level, place = divmod(pid, 13)
        ks = [0.02 + 4.0 * (level + 1) / 6 * math.exp(-0.5 * ((w - 400 - 25 * place) / (30 + 15 * level)) ** 2) for w in WAVELENGTHS]
        rows.append((pid, f"p{pid}", f"Pigment {pid}", pid % 3 != 2, ks))
    return spark.createDataFrame(rows, "pid int, id string, name string, essential boolean, k_over_s array<double>")


SPECTRAL_SCHEMA = """metadata map<string,string>, wavelengths array<int>, illuminantSpd array<double>, cmfX array<double>, cmfY array<double>, cmfZ array<double>,
  pigments array<struct<id:string,name:string,productNumber:int,essential:boolean,cielab:struct<L:double,a:double,b:double>,reflectance:array<double>,kOverS:array<double>>>"""


def file_weights() -> Column:
    """The weights of X, Y and Z from a light's power and matching curves, so that a perfect white has Y = 1; all 0 where it has no power."""

    def lit(curve: str) -> Column:
        return F.zip_with("illuminantSpd", curve, lambda p, v: p * v)

    norm = F.aggregate(lit("cmfY"), C.num(0), lambda a, v: a + v)
    return F.array(*[F.transform(lit(f"cmf{c}"), lambda v: F.when(norm > 0, v / norm).otherwise(C.num(0))) for c in "XYZ"])


def read_pigments(spark: SparkSession, path: str) -> DataFrame:
    """Pigments of a spectral JSON file, with their place in it and the file's own ``xyz_weights``; a file without pigments is an error."""
    rows = spark.read.schema(SPECTRAL_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.posexplode("pigments").alias("pid", "p"), file_weights().alias("xyz_weights")).select(
        "pid", "p.id", "p.name", F.col("p.productNumber").alias("product_number"), "p.essential", "p.cielab", "p.reflectance", F.col("p.kOverS").alias("k_over_s"), "xyz_weights"
    )


def reflectance(k: Column) -> Column:
    return F.when(k <= 0, C.num(1)).otherwise(1.0 + k - F.sqrt(k * k + 2.0 * k))


def k_over_s(r: Column) -> Column:
    r = C.clamp(r, 0.001, 0.999)
    return (1.0 - r) * (1.0 - r) / (2.0 * r)


def mix_k_over_s(parts: list[tuple[Column, Column]]) -> Column:
    """Spectra weighted by concentration, wavelength by wavelength."""
    (c0, s0), *rest = parts
    out = F.transform(s0, lambda k: k * c0)
    for c, s in rest:
        out = _plus(out, s, c)
    return out


def _plus(out: Column, spectrum: Column, c: Column) -> Column:
    return F.zip_with(out, spectrum, lambda x, k: x + k * c)


def xyz(spectrum: Column, weights: Column | None = None) -> list[Column]:
    """X, Y and Z of a reflectance spectrum, by ``weights`` or under an equal-energy light."""
    fixed = [F.array(*[C.num(w) for w in curve]) for curve in xyz_weights()] if weights is None else [weights[i] for i in range(3)]
    return [F.aggregate(F.zip_with(spectrum, w, lambda r, v: r * v), C.num(0), lambda acc, v: acc + v) for w in fixed]


def oklab_of_spectrum(ks: Column) -> list[Column]:
    """Colour of an absorption-to-scattering spectrum."""
    linear = [F.greatest(C.num(0), C.dot(m, xyz(F.transform(ks, reflectance)))) for m in FROM_XYZ]
    return C.oklab_of_linear(linear)


def with_colors(df: DataFrame, ks: str = "k_over_s") -> DataFrame:
    """``df`` with the colours of its spectra, by its own ``xyz_weights`` where it has them."""
    weights = F.col("xyz_weights") if "xyz_weights" in df.columns else None
    lit = df.withColumn("_xyz", F.array(*xyz(F.transform(ks, reflectance), weights)))  # once, not per use
    linear = [F.greatest(C.num(0), C.dot(m, [F.col("_xyz")[i] for i in range(3)])) for m in FROM_XYZ]
    return lit.withColumns(dict(zip(C.LAB, C.oklab_of_linear(linear), strict=True))).drop("_xyz")


def masstones(pigments: DataFrame) -> DataFrame:
    return with_colors(pigments).select("pid", "id", *C.LAB)


def steps(n: int, edges: bool = True) -> np.ndarray:
    """Amounts of ``n`` paints, 2 or 3, in eighths that sum to 8; without ``edges`` none is 0."""
    lo = 0 if edges else 1
    if n == 2:
        return np.array([(a, 8 - a, 0) for a in range(lo, 9 - lo)])
    return np.array([(a, b, 8 - a - b) for a in range(lo, 9) for b in range(lo, 9 - a) if 8 - a - b >= lo])


def lab_of_spectra(ks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Oklab of absorption-to-scattering spectra, one a row, by the weights of X, Y and Z."""
    r = 1.0 + ks - np.sqrt(ks * (ks + 2.0)) if (ks > 0).all() else np.where(ks <= 0, 1.0, 1.0 + ks - np.sqrt(np.maximum(0.0, ks * (ks + 2.0))))
    linear = np.maximum(0.0, r @ weights.T @ np.array(FROM_XYZ).T)
    return np.cbrt(linear @ np.array(C.TO_CONE).T) @ np.array(C.TO_LAB).T


@dataclass
class Pigments:
    """A pigment table as arrays, in the order of its numbers."""

    pid: np.ndarray
    ks: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, pigments: DataFrame, most: int = 255) -> Pigments:
        """Tens of pigments; ``most`` is what one byte of a mix file can number."""
        own = ["xyz_weights"] if "xyz_weights" in pigments.columns else []  # the same for all pigments of a file
        rows = pigments.select("pid", "k_over_s", *own).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} pigments")
        rows.sort(key=lambda r: r.pid)
        light = np.array(rows[0].xyz_weights if own and rows else xyz_weights(), float)
        return cls(np.array([r.pid for r in rows], np.int32), np.array([r.k_over_s for r in rows], float).reshape(len(rows), len(rows[0].k_over_s) if rows else len(WAVELENGTHS)), light)

    def mixes(self, places: np.ndarray, amounts: np.ndarray) -> np.ndarray:
        """Oklab of mixes by the places of their paints in the table and their amounts in eighths; both (mix, paint)."""
        ks = np.zeros((len(places), self.ks.shape[1]))
        for i in range(places.shape[1]):
            ks += self.ks[places[:, i]] * (amounts[:, i] / 8.0)[:, None]
        return lab_of_spectra(ks, self.weights)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.triu_indices(len(self.pid), 1)

    def count(self, paints: int = 3, edges: bool = True) -> int:
        """How many mixes there are."""
        n = len(self.pid)
        return n * (n - 1) // 2 * len(steps(2, edges)) + (n * (n - 1) * (n - 2) // 6 * len(steps(3, edges)) if paints >= 3 else 0)

    def sets(self, paints: int = 3, edges: bool = True, of: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (-1: none) and amounts of the mixes that begin with each pair, or with some by their number, about ``AT_ONCE`` at a time."""
        first, second = self.pairs()
        two, three = steps(2, edges), steps(3, edges)
        ids = np.arange(len(first)) if of is None else of
        more = len(self.pid) - 1 - second if paints >= 3 else np.zeros(len(first), np.int64)
        rows = np.cumsum(len(two) + more[ids] * len(three))
        for at in np.split(ids, np.flatnonzero(np.diff(rows // AT_ONCE)) + 1):
            both = np.stack([first[at], second[at], np.full(len(at), -1)], axis=1)
            k = more[at]
            third = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(second[at] + 1, k)
            triples = np.column_stack([np.repeat(both[:, :2], k, axis=0), third])
            sets = np.concatenate([np.repeat(both, len(two), axis=0), np.repeat(triples, len(three), axis=0)])
            yield sets, np.concatenate([np.tile(two, (len(at), 1)), np.tile(three, (len(triples), 1))])


MIXES = "i0 int, i1 int, i2 int, a0 int, a1 int, a2 int, ok_l double, ok_a double, ok_b double, n_paints int"
#: Mixes that a task makes at once.
AT_ONCE = 1 << 17


def mix_table(pigments: DataFrame, paints: int = 3, edges: bool = True) -> DataFrame:
    """All mixes of pairs, and triples if asked, of a pigment table: (i0, i1, i2, a0, a1, a2, ok_l, ok_a, ok_b, n_paints).

    The pigments, tens of rows, go to the tasks as arrays; a task takes a range of pairs and makes the pairs' mixes and those of all triples that
    begin with them, so every subset is made once and no row is joined.
    """
    table = Pigments.of(pigments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, amounts in table.sets(paints, edges, batch.column("id").to_numpy()):
                keys = np.where(places >= 0, table.pid[places], -1)
                columns = [*keys.T, *amounts.T.astype(np.int32), *table.mixes(places, amounts).T, (amounts > 0).sum(axis=1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[c.split()[0] for c in MIXES.split(", ")])

    n = len(table.pairs()[0])
    tasks = max(1, min(n, -(-table.count(paints, edges) // AT_ONCE)))
    return pigments.sparkSession.range(0, n, 1, tasks).mapInArrow(run, MIXES)


def decode_packed(packed: Column) -> list[Column]:
    """Amounts in eighths from a packed byte: high nibble, low nibble, and what is left of 8."""
    a0, a1 = F.shiftright(packed, 4), packed.bitwiseAND(15)
    return [a0, a1, 8 - a0 - a1]


ORDER = ["n_paints", "i0", "i1", "i2", "a0", "a1", "a2"]


def chroma_weight(color: np.ndarray) -> np.ndarray:
    """Weight of the squared chroma difference to a target, for colours along the last axis."""
    chroma = np.hypot(color[..., 1], color[..., 2])
    return np.where(chroma < 0.01, 0.08, np.minimum(32.0, 6 + 180 * chroma))


@dataclass
class Mix:
    """A mix near a colour, its amounts pruned of traces."""

    parts: dict[int, float]
    lab: tuple[float, float, float]
    delta_e: float


#: Mixes that a table in memory may hold, about 60 MB.
MAX_TABLE = 2_000_000


@dataclass
class Mixes:
    """A mix table as arrays, in the order that settles ties."""

    keys: dict[str, np.ndarray]
    lab: np.ndarray

    @classmethod
    def of(cls, mixes: DataFrame, most: int, bound: int = MAX_TABLE) -> Mixes:
        """The mixes of at most ``most`` paints, for tables that fit in memory; their number hangs on that of the pigments alone and is checked."""
        allowed = mixes.where(F.col("n_paints") <= most).select(*[F.col(c).cast("short") for c in ORDER], *C.LAB)
        rows = allowed.limit(bound + 1).toArrow()
        if rows.num_rows > bound:
            raise ValueError(f"more than {bound} mixes of at most {most} paints")
        keys = {c: rows.column(c).to_numpy() for c in ORDER}
        order = np.lexsort([keys[c] for c in reversed(ORDER)])
        return cls({c: v[order] for c, v in keys.items()}, np.stack([rows.column(c).to_numpy() for c in C.LAB], axis=1)[order])

    def only(self, pigments: list[int]) -> Mixes:
        """The mixes whose paints are all among ``pigments``."""
        ok = np.ones(len(self.lab), bool)
        for i in range(3):
            ok &= (self.keys[f"a{i}"] == 0) | np.isin(self.keys[f"i{i}"], pigments)
        return Mixes({c: v[ok] for c, v in self.keys.items()}, self.lab[ok])

    def search(self, color: np.ndarray) -> tuple[int, float]:
        """Place of the nearest mix, the first on ties, and its weighted distance."""
        w = chroma_weight(color)
        diff = self.lab - color
        d = np.round(diff[:, 0] ** 2 + w * (diff[:, 1] ** 2 + diff[:, 2] ** 2), 9)
        best = int(d.argmin())
        return best, math.sqrt(d[best])

    def nearest(self, color: np.ndarray, least: float = 0.02) -> Mix:
        at, distance = self.search(color)
        amounts = {int(self.keys[f"i{i}"][at]): int(self.keys[f"a{i}"][at]) / 8.0 for i in range(3) if self.keys[f"a{i}"][at] > 0}
        return Mix(pruned_parts(amounts, least), tuple(self.lab[at].tolist()), distance)

    def nearest_all(self, colors: np.ndarray) -> list[Mix]:
        return [self.nearest(c) for c in colors]


def pruned_parts(parts: dict[int, float], least: float) -> dict[int, float]:
    """``pruned`` of one recipe."""
    order = sorted(parts.items(), key=lambda p: (-p[1], p[0]))
    kept = [p for p in order if p[1] >= least] or order[:1]
    total = sum(c for _, c in kept)
    return {p: c / total for p, c in kept}


def only(mixes: DataFrame, pigments: list[int]) -> DataFrame:
    """The mixes whose paints are all among ``pigments``, by pid."""
    return mixes.where(reduce(lambda x, i: x & ((F.col(f"a{i}") == 0) | F.col(f"i{i}").isin(pigments)), range(3), F.lit(True)))


def components(mixes: DataFrame) -> DataFrame:
    """Mixes with ``components``: pigments with their concentrations, zero amounts left out."""
    parts = F.array(*[F.struct(F.col(f"i{i}").alias("pid"), (F.col(f"a{i}") / 8.0).alias("concentration")) for i in range(3)])
    return mixes.withColumn("components", F.filter(parts, lambda c: c["concentration"] > 0))


def pruned(parts: Column, least: float = 0.02) -> Column:
    """Components of at least ``least``, or the largest alone, scaled to sum 1 and ordered by concentration, then pid."""
    order = F.sort_array(F.transform(parts, lambda c: F.struct((-c["concentration"]).alias("neg"), c["pid"].alias("pid"))))
    kept = F.filter(order, lambda c: -c["neg"] >= least)
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.slice(order, 1, 1))
    total = F.aggregate(kept, C.num(0), lambda acc, c: acc - c["neg"])
    return F.transform(kept, lambda c: F.struct(c["pid"].alias("pid"), (-c["neg"] / total).alias("concentration")))
