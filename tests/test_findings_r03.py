"""Large, ragged and tied inputs that once failed or gave other results."""

import itertools
import math
import tracemalloc

import numpy as np
from chromaframe.operators import cluster, depth, graph, lines, mixsearch, palette, spectral, tiles
from chromaframe.plans import registry


def plan(df):
    return df._jdf.queryExecution().toString()


def ragged(spark, w=11, h=7, last=4):
    """An image whose last row ends after ``last`` pixels."""
    rows = [(5, y * w + x, x, y, 3 * x, 5 * y, (x * y) % 256) for y in range(h) for x in range(w) if y < h - 1 or x < last]
    return spark.createDataFrame(rows, "image_id long, idx int, x int, y int, r int, g int, b int"), {(r[2], r[3]): r[4:] for r in rows}


def test_fields_are_resampled_without_joining_points(spark, monkeypatch):
    monkeypatch.setattr(lines, "BAND", 3, raising=False)
    pixels, _ = ragged(spark)
    field = pixels.selectExpr("image_id", "x", "y", "double(r + g) AS v")
    own = {(r.x, r.y): r.v for r in field.collect()}
    want = {}
    for x, y in itertools.product(range(21), range(13)):
        px, py = round(x * 10 / 20, 9), round(y * 6 / 12, 9)
        fx, fy = min(math.floor(px), 9), min(math.floor(py), 5)
        near = [(own[i, j], (1 - abs(px - i)) * (1 - abs(py - j))) for i in (fx, fx + 1) for j in (fy, fy + 1) if (i, j) in own]
        if near:  # as the SQL has it, also where the only ones weigh nothing
            want[x, y] = sum(v * s for v, s in near)
    found = lines.resampled(field, 21, 13)
    got = {(r.x, r.y): r.v for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert "Broadcast" not in plan(found)


def test_tiles_of_ragged_images_and_no_broadcast(spark):
    pixels, own = ragged(spark)
    found = tiles.tiles(pixels, 4, 1, 2)
    source = lambda t, p, size: (lambda c: min(c % (2 * (size - 1)), 2 * (size - 1) - c % (2 * (size - 1))))((lambda c, n: min(c % (2 * (n - 1)), 2 * (n - 1) - c % (2 * (n - 1))))(t * 4 + p - 1, -(-(size + 4) // 4) * 4) - 2)
    want = set()
    for tx, ty, u, v in itertools.product(range(4), range(3), range(6), range(6)):
        if (at := (source(tx, u, 11), source(ty, v, 7))) in own:
            want.add((5, tx, ty, u, v, *own[at]))
    assert set(map(tuple, found.collect())) == want and found.count() == len(want)
    double = lambda t: t.repeat(2, axis=-1).repeat(2, axis=-2)
    contract = tiles.Contract("m", 6, 2)
    for made in (tiles.transformed(pixels, double, 2, 4, 1, 2), tiles.by_contract(pixels, lambda: double, contract, 1, 2)):
        twice = {(5, (2 * y + j) * 22 + 2 * x + i, 2 * x + i, 2 * y + j, *rgb) for (x, y), rgb in own.items() for i in (0, 1) for j in (0, 1)}
        assert set(map(tuple, made.collect())) == twice and made.count() == len(twice)
        assert "Broadcast" not in plan(made)
    assert "Broadcast" not in plan(found)


def test_halves_of_resized_depth_do_not_hang_on_the_order_of_sums(spark):
    """Exact halves at nine places, which sums of doubles put on either side."""
    want, images, pixels = {}, [], []
    for n, (a, b, c, d) in enumerate(itertools.product(range(186, 190), range(200, 204), range(186, 190), range(200, 204))):
        images += [(n, 0, 0, a), (n, 1, 0, b), (n, 0, 1, c), (n, 1, 1, d)]
        pixels += [(n, x, y) for x in (0, 3, 7) for y in (0, 2, 5)]
    depths = spark.createDataFrame(images, "image_id long, x int, y int, depth int")
    got = depth.resized(depths, spark.createDataFrame(pixels, "image_id long, x int, y int"))
    own = {(i, x, y): v for i, x, y, v in images}
    nine = 10**9
    for n, x, y in pixels:
        px, py = (max(0, min(nine, ((2 * at + 1) * 2 * nine * 10 // (2 * size) + 5) // 10 - nine // 2)) for at, size in ((x, 8), (y, 6)))
        total = sum((px if i else nine - px) * (py if j else nine - py) * own[n, i, j] for i in (0, 1) for j in (0, 1))
        want[n, x, y] = ((total * 2 + nine) // (2 * nine) * 2 + nine) // (2 * nine)
    rows = got.collect()
    assert {(r.image_id, r.x, r.y): r.depth for r in rows} == want
    assert "decimal" in plan(got)


def test_seeds_tie_at_nine_places(spark):
    """A score lower by 5e-7 than the best is no tie, though its weight goes first."""
    lab = np.array([(0.5, 0.0, 0.0), (0.5, 0.2, 0.0), (0.5, -0.2, 0.0)])
    weight = np.array([100.0, 25.0, 25.0001])
    lab[2, 1] = -math.sqrt(0.04 - 1e-6)
    assert cluster.choose_seeds(lab, weight, 2, tie=0.0).tolist() == [0, 1]
    assert cluster.choose_seeds(lab, weight, 2).tolist() == [0, 2]


def test_pairs_are_mixed_of_every_nation_in_every_region(spark):
    found = registry.QUERIES["mix_pairs"](spark, "/root/testdata/sf0.001")
    assert found.count() == 125 * 124 // 2 * 9 and found.select("i0", "i1").distinct().count() == 125 * 124 // 2


def test_triples_are_mixed_of_every_nation_in_every_region(spark):
    found = registry.QUERIES["mix_triples"](spark, "/root/testdata/sf0.001")
    assert found.count() == 125 * 124 * 123 // 6 and found.where("n <> 45").isEmpty()


def test_contours_pass_nothing_through_the_driver(spark):
    field = spark.createDataFrame([(1, x, y, ((x - 4) ** 2 + (y - 3) ** 2) / 30.0) for x in range(9) for y in range(7)], "image_id long, x int, y int, v double")
    chains = lines.contour_chains(lines.contour_segments(lines.contour_cells(field, [0.2, 0.4]), 8, 6))
    assert chains.count() > 0 and "Broadcast" not in plan(chains)
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "image_id long, a long, b long")
    assert "Broadcast" not in plan(graph._star(edges, ["image_id"], True))


def test_recipes_are_merged_by_the_plain_loop(monkeypatch):
    """Also across blocks, and without touching what came in."""
    monkeypatch.setattr(palette, "AT_ONCE", 7, raising=False)
    rng = np.random.default_rng(3)
    rows = [palette.Recipe(i, {int(p): int(rng.integers(1, 9)) / 20 for p in rng.choice(4, rng.integers(1, 4), False)}, rng.random(3) * 0.2, int(rng.integers(0, 9)), 1.0, [i]) for i in range(90)]
    kept = []
    for r in (r for r in rows if r.cnt > 0):
        for i, k in enumerate(kept):
            if palette.similar(k, r, 0.015, 0.05):
                lead = k if k.cnt >= r.cnt else r
                kept[i] = palette.Recipe(k.id, lead.parts, lead.lab, k.cnt + r.cnt, k.importance + r.importance, k.members + r.members)
                break
        else:
            kept.append(palette.Recipe(r.id, r.parts, r.lab, r.cnt, r.importance, list(r.members)))
    for r in (r for r in rows if r.cnt <= 0):
        min(kept, key=lambda k: (round(palette._distance(k, r), 9), k.id)).members.extend(r.members)
    got = palette.merge(rows)
    assert [(r.id, r.parts, r.cnt, r.members) for r in got] == [(r.id, r.parts, r.cnt, r.members) for r in kept]
    assert all(r.members == [r.id] for r in rows)


def test_mixes_of_a_set_are_made_once_for_all_images(spark, monkeypatch):
    made = []
    of = spectral.Pigments.mixes
    monkeypatch.setattr(spectral.Pigments, "mixes", lambda self, places, amounts: made.append(len(places)) or of(self, places, amounts))
    pigments = spectral.Pigments.of(spectral.pigment_fixture(spark).where("pid < 12"))
    mixes = palette.InnerMixes(pigments)
    for color in (0.3, 0.6):
        minima = palette.SubsetMinima(pigments, np.array([(color, 0.05, 0.02)]), 3, mixes)
        palette.improve_tubes([0, 1, 2], list(range(12)), minima, np.ones(1))
    assert sum(made) <= 12 + 66 * 7 + 220 * 21


def test_held_mixes_take_few_bytes_and_images_are_dealt_out(spark):
    pigments = spectral.Pigments.of(spectral.pigment_fixture(spark).where("pid < 50"))
    tracemalloc.start()
    held = mixsearch.Held(pigments)
    size, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    n = pigments.count()
    assert len(held.lab) == n and size < 20 * n and peak < 48 * n
    # among mixes nearer to each other than single precision tells apart, as by double precision
    places, amounts = np.array([(0, 1, 2), (0, 2, 3)]), np.array([(3, 3, 2), (1, 5, 2)])
    for lab in pigments.mixes(places, amounts):
        best = held.nearest(lab)
        assert best.delta_e == 0 and np.abs(np.array(best.lab) - lab).max() < 1e-5
    few = spectral.Pigments.of(spectral.pigment_fixture(spark).where("pid < 4"))
    clusters = spark.range(40 * 3).selectExpr("id div 3 AS image_id", "int(id % 3) AS k", "0.2D + id % 7 / 10 AS ok_l", "id % 5 / 50D AS ok_a", "id % 3 / 50D AS ok_b", "id + 1 AS cnt", "1D AS salience")
    found = palette._palettes_held(clusters, few, 3, 2)
    assert found.select("image_id").distinct().count() == 40 and len(found.inputFiles()) > 1
