"""DuckDB SQL of the studies, written from the definitions and not from the column expressions."""

from __future__ import annotations

import math

PIXEL = """pixel AS (SELECT image_id, idx, x, y, CAST(x * 5 + cust % 8 AS INT) AS r, CAST(y * 8 + cust % 16 AS INT) AS g,
  CAST(((x // 10) * 51 + (y // 10) * 17 + k % 5) % 256 AS INT) AS b, 255 AS alpha, CAST(least(255, x * 5 + cust % 6) AS INT) AS depth
  FROM (SELECT o_orderkey // 1500 AS image_id, CAST(o_orderkey % 1500 AS INT) AS idx, CAST((o_orderkey % 1500) % 50 AS INT) AS x,
        CAST((o_orderkey % 1500) // 50 AS INT) AS y, o_custkey AS cust, o_orderkey AS k FROM orders))"""


def r6(e: str) -> str:
    return f"(round({e}, 6) + 0.0)"


def lin(e: str) -> str:
    return f"(CASE WHEN {e} / 255.0 <= 0.04045 THEN CAST({e} AS DOUBLE) / 255.0 / 12.92 ELSE pow((CAST({e} AS DOUBLE) / 255.0 + 0.055) / 1.055, 2.4) END)"


def delin(e: str) -> str:
    return f"(CASE WHEN {e} <= 0.0031308 THEN {e} * 12.92 ELSE 1.055 * pow({e}, 1 / 2.4) - 0.055 END)"


def byte(e: str) -> str:
    return f"CAST(floor(greatest(0.0, least(1.0, {e})) * 255.0 + 0.5) AS INT)"


LAB = (
    PIXEL
    + f""",
linear AS (SELECT *, {lin("r")} AS lr, {lin("g")} AS lg, {lin("b")} AS lb FROM pixel),
cone AS (SELECT *, cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb) AS c1, cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb) AS c2,
  cbrt(0.0883024619 * lr + 0.2817188376 * lg + 0.6299787005 * lb) AS c3 FROM linear),
lab AS (SELECT image_id, idx, x, y, r, g, b, alpha, depth, lr, lg, lb, 0.2104542553 * c1 + 0.7936177850 * c2 - 0.0040720468 * c3 AS ok_l,
  1.9779984951 * c1 - 2.4285922050 * c2 + 0.4505937099 * c3 AS ok_a, 0.0259040371 * c1 + 0.7827717662 * c2 - 0.8086757660 * c3 AS ok_b FROM cone)"""
)

GRAY = {
    "luminance": "0.2126 * lr + 0.7152 * lg + 0.0722 * lb",
    "average": "(lr + lg + lb) / 3.0",
    "lightness": "(greatest(lr, lg, lb) + least(lr, lg, lb)) / 2.0",
}


def gray(kind: str) -> str:
    return f"gray AS (SELECT *, {byte(delin('m'))} AS gray FROM (SELECT *, {GRAY[kind]} AS m FROM lab))"


def bands(edges: list[int]) -> str:
    total = " + ".join(f"CAST(gray >= {t} AS INT)" for t in edges)
    return f"band AS (SELECT *, {total} AS band FROM gray)"


def rgb(light: str, a: str, b: str) -> list[str]:
    """sRGB bytes of an Oklab colour."""
    l1, m1, s1 = (f"pow({light} + {p} * {a} + {q} * {b}, 3)" for p, q in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480)))
    rows = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
    return [byte(delin(f"greatest(0.0, least(1.0, {x} * {l1} + {y} * {m1} + {z} * {s1}))")) for x, y, z in rows]


def dist(light: str, a: str, b: str, q: tuple, w: str) -> str:
    """Squared distance to a colour; ``w`` multiplies the squared lightness difference."""
    return f"round({w} * pow({light} - {q[0]}, 2) + pow({a} - {q[1]}, 2) + pow({b} - {q[2]}, 2), 9)"


def argmin(options: list[str]) -> str:
    """Index of the smallest option, the first on ties."""
    return f"CAST(list_position([{', '.join(options)}], list_min([{', '.join(options)}])) - 1 AS INT)"


PALETTE = [(0.25, 0.0, 0.0), (0.5, 0.1, 0.05), (0.6, -0.1, 0.1), (0.8, 0.02, 0.08)]
LABELLED = "labelled AS (SELECT *, " + argmin([dist("ok_l", "ok_a", "ok_b", q, "0.09") for q in PALETTE]) + " AS label FROM lab)"
CLUSTERS = """clusters AS (SELECT i.image_id, CAST(k.k AS INT) AS k, coalesce(l, 0.5) AS ok_l, coalesce(a, 0.0) AS ok_a, coalesce(b, 0.0) AS ok_b, CAST(coalesce(c, 0) AS BIGINT) AS cnt
  FROM (SELECT DISTINCT image_id FROM pixel) i, (SELECT unnest([0, 1, 2, 3]) AS k) k
  LEFT JOIN (SELECT image_id, label, avg(ok_l) AS l, avg(ok_a) AS a, avg(ok_b) AS b, count(*) AS c FROM labelled GROUP BY ALL) g ON g.image_id = i.image_id AND g.label = k.k)"""
SALIENT = """salient AS (SELECT c.*, greatest(0.75, least(2.0, 0.75 + 0.75 * least(sqrt(ok_a * ok_a + ok_b * ok_b), 0.2) / 0.2
  + 0.5 * least(pow(ok_l - ml, 2) + pow(ok_a - ma, 2) + pow(ok_b - mb, 2), 0.3) / 0.3)) AS salience
  FROM clusters c JOIN (SELECT image_id, sum(ok_l * cnt) / sum(cnt) AS ml, sum(ok_a * cnt) / sum(cnt) AS ma, sum(ok_b * cnt) / sum(cnt) AS mb FROM clusters GROUP BY image_id) m USING (image_id))"""


def bin_of(e: str, lo: float, hi: float, n: int) -> str:
    return f"greatest(0, least({n - 1}, CAST(floor(round(({e} - ({lo})) / ({hi} - ({lo})) * {n}, 9)) AS INT)))"


HISTOGRAM = f"""binned AS (SELECT image_id, ({bin_of("ok_l", 0.0, 1.0, 12)} * 24 + {bin_of("ok_a", -0.45, 0.45, 24)}) * 24 + {bin_of("ok_b", -0.45, 0.45, 24)} AS bin,
  count(*) AS n, avg(ok_l) AS ok_l, avg(ok_a) AS ok_a, avg(ok_b) AS ok_b FROM lab GROUP BY ALL),
hist AS (SELECT image_id, bin, n, ok_l, ok_a, ok_b, n * (1 + 2 * sqrt(ok_a * ok_a + ok_b * ok_b)) AS weight FROM binned WHERE n >= 4)"""


def seeding(k: int) -> str:
    """k seeds by unrolled steps."""
    steps = ["s0 AS (SELECT image_id, ok_l AS l, ok_a AS a, ok_b AS b FROM hist QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY round(weight, 9) DESC, ok_l DESC, ok_a DESC, ok_b DESC) = 1)"]
    near = None
    for i in range(1, k):
        d = f"0.09 * pow(h.ok_l - s.l, 2) + pow(h.ok_a - s.a, 2) + pow(h.ok_b - s.b, 2)"
        if near is None:
            steps.append(f"n1 AS (SELECT h.*, max(weight) OVER (PARTITION BY h.image_id) AS wmax, {d} AS m FROM hist h JOIN s0 s USING (image_id))")
        else:
            steps.append(f"n{i} AS (SELECT h.* REPLACE (least(h.m, {d}) AS m) FROM {near} h JOIN s{i - 1} s USING (image_id))")
        near = f"n{i}"
        steps.append(
            f"s{i} AS (SELECT image_id, ok_l AS l, ok_a AS a, ok_b AS b FROM {near} WHERE round(m, 9) > 1e-6 QUALIFY row_number() OVER (PARTITION BY image_id "
            "ORDER BY round(m * (0.35 + 0.65 * sqrt(weight / wmax)), 9) DESC, round(weight, 9) DESC, ok_l DESC, ok_a DESC, ok_b DESC) = 1)"
        )
    return ", ".join(steps)


DEPTH = "dc AS (SELECT image_id, depth, count(*) AS n FROM pixel GROUP BY ALL)"
RANGE = """dr AS (SELECT image_id, CASE WHEN hi - lo < 1 / 255.0 THEN greatest(0.0, (lo + hi) * 0.5 - 0.5 / 255.0) ELSE lo END AS lo,
  CASE WHEN hi - lo < 1 / 255.0 THEN least(1.0, (lo + hi) * 0.5 + 0.5 / 255.0) ELSE hi END AS hi
  FROM (SELECT image_id, min(depth) / 255.0 AS lo, max(depth) / 255.0 AS hi FROM pixel GROUP BY image_id))"""


def rank_value(p: float) -> str:
    return f"list_sort(list(depth))[CAST(floor((count(*) - 1) * {p} + 0.5) AS INT) + 1]"


def smooth(lo: str, hi: str, e: str) -> str:
    t = f"greatest(0.0, least(1.0, ({e} - ({lo})) / (({hi}) - ({lo}))))"
    return f"({t} * {t} * (3.0 - 2.0 * {t}))"


def reflect(k: str) -> str:
    return f"CASE WHEN {k} <= 0 THEN 1.0 ELSE 1.0 + {k} - sqrt({k} * {k} + 2.0 * {k}) END"


def _bump(w: float, at: float, left: float, right: float) -> float:
    return math.exp(-(((w - at) * (left if w < at else right)) ** 2) / 2)


#: The published fit of the colour-matching functions as (height, mean, inverse widths left and right), at 400, 410 ... 700 nm.
_FIT = [
    [(0.362, 442.0, 0.0624, 0.0374), (1.056, 599.8, 0.0264, 0.0323), (-0.065, 501.1, 0.0490, 0.0382)],
    [(0.821, 568.8, 0.0213, 0.0247), (0.286, 530.9, 0.0613, 0.0322)],
    [(1.217, 437.0, 0.0845, 0.0278), (0.681, 459.0, 0.0385, 0.0725)],
]
_MATCH = [[sum(h * _bump(w, *rest) for h, *rest in parts) for w in range(400, 701, 10)] for parts in _FIT]
WEIGHTS = [[v / sum(_MATCH[1]) for v in curve] for curve in _MATCH]


def _oklab_of_xyz(keys: str) -> str:
    return f"""rgbl AS (SELECT {keys}, greatest(0.0, 3.2404542 * vx - 1.5371385 * vy - 0.4985314 * vz) AS lr, greatest(0.0, -0.9692660 * vx + 1.8760108 * vy + 0.0415560 * vz) AS lg,
  greatest(0.0, 0.0556434 * vx - 0.2040259 * vy + 1.0572252 * vz) AS lb FROM tri),
cones AS (SELECT {keys}, cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb) AS c1, cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb) AS c2,
  cbrt(0.0883024619 * lr + 0.2817188376 * lg + 0.6299787005 * lb) AS c3 FROM rgbl),
tones AS (SELECT {keys}, 0.2104542553 * c1 + 0.7936177850 * c2 - 0.0040720468 * c3 AS ok_l, 1.9779984951 * c1 - 2.4285922050 * c2 + 0.4505937099 * c3 AS ok_a,
  0.0259040371 * c1 + 0.7827717662 * c2 - 0.8086757660 * c3 AS ok_b FROM cones)"""


def spectral_lab(source: str, keys: str, weights: list[list[float]] = WEIGHTS) -> str:
    """Oklab of every ``ks`` list of ``source``."""
    sums = ", ".join(f"list_sum([({reflect('ks[i]')}) * ([{', '.join(map(repr, w))}])[i] FOR i IN range(1, 32)]) AS {n}" for n, w in zip(("vx", "vy", "vz"), weights, strict=True))
    return f"""tri AS (SELECT {keys}, {sums} FROM {source}),
{_oklab_of_xyz(keys)}"""


def triples_lab() -> str:
    """Oklab of every triple of ``pig`` at every step, with a column for each wavelength, as DuckDB is slow in lists of so many mixes."""
    keys, n = "i0, i1, i2, a0, a1, a2", range(1, 32)
    wide = ", ".join(f"ks[{i}] AS k{i}" for i in n)
    mixed = ", ".join(f"p.k{i} * a / 8.0 + q.k{i} * e / 8.0 + o.k{i} * (8 - a - e) / 8.0 AS k{i}" for i in n)
    lit = ", ".join(f"{reflect(f'k{i}')} AS r{i}" for i in n)
    sums = ", ".join(" + ".join(f"r{i} * {w!r}" for i, w in zip(n, curve, strict=True)) + f" AS {v}" for v, curve in zip(("vx", "vy", "vz"), WEIGHTS, strict=True))
    return f"""wide AS (SELECT pid, {wide} FROM pig),
mixed AS (SELECT p.pid AS i0, q.pid AS i1, o.pid AS i2, CAST(a AS INT) AS a0, CAST(e AS INT) AS a1, CAST(8 - a - e AS INT) AS a2, {mixed}
  FROM wide p JOIN wide q ON p.pid < q.pid JOIN wide o ON q.pid < o.pid, (SELECT unnest(range(0, 9)) AS a) s, (SELECT unnest(range(0, 9)) AS e) t WHERE a + e <= 8),
lit AS (SELECT {keys}, {lit} FROM mixed), tri AS (SELECT {keys}, {sums} FROM lit),
{_oklab_of_xyz(keys)}"""


PIGMENTS = "pig AS (SELECT CAST(vec_id AS INT) AS pid, [0.02 + 4.0 * abs(CAST(z AS DOUBLE)) FOR z IN embedding[1:31]] AS ks FROM embeddings)"
#: 78 pigments: 13 places of the lobe in 6 strengths and widths.
FIXTURE = """pig AS (SELECT pid, [0.02 + 4.0 * (pid // 13 + 1) / 6 * exp(-0.5 * pow((w - 400 - 25 * (pid % 13)) / (30.0 + 15 * (pid // 13)), 2)) FOR w IN range(400, 701, 10)] AS ks
  FROM (SELECT CAST(unnest(range(78)) AS INT) AS pid))"""

#: A pigment of every nation: its key is the place of the lobe, its region the strength and width.
NATIONS = """pig AS (SELECT n_nationkey AS pid, [0.02 + 1.3 * (n_regionkey + 1) * exp(-0.5 * pow((w - 400 - 12.5 * n_nationkey) / (30.0 + 15 * n_regionkey), 2)) FOR w IN range(400, 701, 10)] AS ks FROM nation)"""

#: A pigment of every nation in every region's strength and width.
PAINTS = """pig AS (SELECT n_nationkey * (SELECT count(*)::INT FROM region) + r_regionkey AS pid, [0.02 + 1.3 * (r_regionkey + 1) * exp(-0.5 * pow((w - 400 - 12.5 * n_nationkey) / (30.0 + 15 * r_regionkey), 2)) FOR w IN range(400, 701, 10)] AS ks FROM nation, region)"""

#: Colour names, from the definitions.
VALUES = "CASE WHEN l < 0.20 THEN 'Near-Black' WHEN l < 0.35 THEN 'Dark' WHEN l < 0.55 THEN 'Deep' WHEN l < 0.72 THEN 'Mid' WHEN l < 0.86 THEN 'Light' ELSE 'Pale' END"
CHROMAS = "CASE WHEN c < 0.03 THEN 'Neutral' WHEN c < 0.06 THEN 'Dull' WHEN c < 0.10 THEN 'Muted' WHEN c < 0.16 THEN 'Soft' WHEN c < 0.24 THEN 'Clear' ELSE 'Bright' END"
HUES = """CASE WHEN h >= 350 OR h < 20 THEN 'Red' WHEN h < 45 THEN 'Orange' WHEN h < 70 THEN 'Gold' WHEN h < 95 THEN 'Yellow' WHEN h < 140 THEN 'Green'
  WHEN h < 185 THEN 'Teal' WHEN h < 255 THEN 'Blue' WHEN h < 315 THEN 'Violet' ELSE 'Rose' END"""
WARMTHS = """CASE WHEN h < 10 OR h >= 20 AND h < 82.5 OR h >= 95 AND h < 117.5 OR h >= 140 AND h < 162.5 OR h >= 220 AND h < 255 OR h >= 285 AND h < 315
  OR h >= 332.5 THEN 'Warm' ELSE 'Cool' END"""

#: Edges joined in a cell by which of its corners (8 top left, 4 top right, 2 bottom right, 1 bottom left) lie below the level.
CASES = {1: "LB", 2: "BR", 3: "LR", 4: "TR", 6: "TB", 7: "TL", 8: "TL", 9: "TB", 11: "TR", 12: "LR", 13: "BR", 14: "LB"}
TWO_LINES = {5: (("TR", "LB"), ("TL", "BR")), 10: (("TL", "BR"), ("TR", "LB"))}
