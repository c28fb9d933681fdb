"""Resampling, periodic runs and SimHash on one awkward table (nulls, empty, long, ties, repeated rows, clashing columns) against brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from chromaframe.llm import periodic, resampling, simhash
from chromaframe.llm.common import table

SCHEMA = "doc_id bigint, text string, lang string, rank int, range int, place int, fp string, component string, `group` int, least int, row string, `a.b` int"
EXTRA = ("en", 7, 7, 7, "clash", "clash", 7, 7, "clash", 7)
DIR = "/root/testdata/sf0.001"


def rows():
    r = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "ever.", "the", "of", "x" * 90] + [f"w{i}x" for i in range(60)]
    base = " ".join(r.choices(vocabulary, k=60))
    block = r.choices(vocabulary, k=37)
    texts = {
        0: None, 1: "", 2: " \n\t\x0b ", 3: base, 4: base, 5: base.upper(), 6: "one two", 7: "one two", 8: "z" * 60_000, 9: "la " * 3000,
        10: " ".join(r.choices(vocabulary, k=20_000)), 11: " ".join(block * 4 + ["odd"] + block * 3), 12: "a b c d e f g h " * 3, 13: "a b c d e f g h " * 3 + "z",
        14: "one two three four", 15: "日本語 текст ﬁ İstanbul 😀 é " * 12, 16: "a a b " * 12 + "c " * 30, 17: ("k l m " * 9 + "n ") * 5, 18: "-- ,, !!",
    }
    for i in range(20, 120):
        texts[i] = " ".join(r.choices(vocabulary, k=r.randint(1, 120)))
    out = [(k, v, *EXTRA) for k, v in texts.items()]
    return [*out, (3, base, *EXTRA), (3, "another text of id three " * 6, *EXTRA), (None, base, *EXTRA), (None, None, *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(found):
    return sorted(map(tuple, found), key=repr)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1))


def brute_draw(data, target):
    own, goal = [brute_features(t) for _, t in data], Counter()
    for t in target:
        goal += brute_features(t)[1]
    s = sum((f for _, f in own), Counter())
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (goal.total() + 10_000)))) for b in s}
    out = []
    for (doc, _), (n, f) in zip(data, own, strict=True):
        weight = sum(gain[b] * c for b, c in f.items())
        h = doc is not None and int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, f.total(), weight, None if doc is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((x for x in out if x[0] is not None and x[5] >= 20), key=lambda x: (-x[3], x[0]))
    for rank, x in enumerate(fit[: 5 * len(fit) // 100]):
        x[4] = rank + 1
    return [tuple(x[:5]) for x in out]


ITEMS = ["alpha the of w1x w2x w3x", None, "", "x" * 90 + " the " + "x" * 90, "la la la"]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(ITEMS)], "item_id bigint, text string, weight int")


def test_draw(docs, items, empty):
    want = brute_draw([r[:2] for r in rows()], ITEMS)
    assert sum(r[4] is not None for r in want) > 2
    assert plain(resampling.query(docs, items).collect()) == plain(want)
    none = resampling.query(empty, items)
    assert none.count() == 0 and none.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    evenly = resampling.query(docs, empty.select("doc_id", "text")).collect()
    assert plain(evenly) == plain(brute_draw([r[:2] for r in rows()], []))


def test_ranks_over_many_ranges(spark, docs, items):
    scored = resampling.weights(docs, items).where("doc_id is not null")
    got = resampling.ranked(scored, 40, range_rows=9).collect()
    order = sorted(scored.collect(), key=lambda r: (-r.score, r.doc_id))
    assert [tuple(r)[:5] for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [tuple(r) for r in order[:40]]
    assert len(got) == len(order) and [r.rank for r in got if r.rank is not None] and resampling.ranked(scored.where("false"), 3).count() == 0


def test_resample_keeps_rows_whole(docs, items):
    wanted = {r.doc_id for r in resampling.draw(docs, items, 30).collect() if r.rank}
    got = resampling.resample(docs, items, 30)
    assert got.columns == docs.columns and wanted
    assert plain(got.collect()) == plain(r for r in rows() if r[0] in wanted)


@given(st.lists(st.lists(st.integers(0, 2000), min_size=1, max_size=40), min_size=1, max_size=4), st.lists(st.integers(-12_000, 12_000), min_size=5, max_size=5))
@settings(max_examples=60, deadline=None)
def test_bit_slices_sum_exactly(counts, gains):
    table, gain = np.zeros((len(counts), 10_000), np.int64), np.zeros(10_000, np.int64)
    for i, c in enumerate(counts):
        table[i, [7 * j * j for j in range(len(c))]] = c
    gain[: 7 * 1600] = np.resize(gains, 7 * 1600)[:10_000]
    assert resampling.weigh(table, *resampling.gain_planes(gain)).tolist() == (table @ gain).tolist()


def brute_runs(w):
    """By every lag and every stretch without a mismatch; of equal stretches the smallest lag."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_report(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *best, runs and 1000 * best[1] // best[2] or None, hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_rows(docs, empty):
    want = [brute_report(*r[:2]) for r in rows() if len(r[1] or "") < 100_000]
    assert sum(r[1] > 0 for r in want) > 8
    got = [r for r in periodic.query(docs).collect() if r.doc_id != 10]
    assert plain(got) == plain(want)
    assert periodic.query(empty).count() == 0


@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=24), st.integers(1, 6), st.integers(0, 24)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_runs_by_every_lag(parts):
    words = [w for block, times, more in parts for w in block * times + block[:more]]
    want = brute_runs(words)
    assert periodic.runs(words) == want
    named = [b"%d" % w for w in words]
    assert not want or periodic.suspects([[b"x"], named, []]).tolist() == [1]


def test_runs_of_one_word_alone():
    assert periodic.runs([b"a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs([b"a"] * 23) == [] and periodic.runs([]) == []


def test_de_bruijn_period():
    """Every pair of blocks comes twice within the period, so the nearest occurrence of 16 words alone would miss it."""
    block = [[f"{b}{i}" for i in range(40)] for b in range(2)]
    words = [w for b in [0, 0, 0, 1, 0, 1, 1, 1] * 4 for w in block[b]]
    assert periodic.runs(words) == brute_runs(words) and (0, 1280, 320) in periodic.runs(words)


def test_collapse(docs):
    got = periodic.collapse(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[9] == "la" and texts[0] is None and texts[2] == rows()[2][1] and texts[12] == "a b c d e f g h"
    assert plain(r[2:] for r in got.collect()) == plain(r[2:] for r in rows())


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, budget):
    """The smallest index that each of these numbers reaches."""
    label = list(range(len(prints)))
    p = np.array(prints, np.uint64)
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= budget).tolist():
            low, high = sorted((label[i], label[j]))
            if low != high:
                label = [low if x == high else x for x in label]
    return label


def test_simhash(docs, empty):
    data = [r[:2] for r in rows()]
    prints = [brute_fingerprint(t) for _, t in data]
    label = brute_components(prints, 4)
    least = {}
    for (doc, _), c in zip(data, label, strict=True):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    want = [(doc, f"{f:016x}", least.get(c)) for (doc, _), f, c in zip(data, prints, label, strict=True)]
    assert plain(simhash.query(docs).collect()) == plain(want)
    assert simhash.query(empty).count() == 0
    left = simhash.deduplicate(docs)
    assert left.columns == docs.columns and plain(left.collect()) == plain(r for r, w in zip(rows(), want, strict=True) if r[0] is None or r[0] == w[2])


def crowds(r):
    """Random numbers, chains of single bits, and crowds around a few centres."""
    out = [r.getrandbits(64) for _ in range(200)]
    for centre in out[:3]:
        out += [centre ^ sum(1 << r.randrange(64) for _ in range(r.randint(1, 4))) for _ in range(150)]
    for step in range(40):
        out.append(out[-1] ^ (0b10111 << step))
    return sorted({x & (1 << 64) - 1 for x in out})


@pytest.mark.parametrize("budget", [1, 3, 4])
@pytest.mark.parametrize("portion", [7, 1 << 18])
def test_trie_of_crowds(monkeypatch, budget, portion):
    monkeypatch.setattr(simhash, "PORTION", portion)
    first, second = crowds(random.Random(budget)), crowds(random.Random(9))
    got = simhash.trie_links(np.array([*first, *second], np.uint64), np.array([len(first), len(first) + len(second)]), budget)
    assert got.tolist() == brute_components(first, budget) + [len(first) + c for c in brute_components(second, budget)]


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_linked_fingerprints_agree_in_a_choice(blocks):
    r = random.Random(blocks)
    for _ in range(200):
        differ = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not differ & m for m in simhash.masks(blocks))
    assert len(simhash.masks(blocks)) == math.comb(blocks, 4)


@pytest.mark.parametrize(("limit", "rows_of_group"), [(20, 64), (8192, 1)])
def test_large_groups_are_joined_in_parts(spark, monkeypatch, limit, rows_of_group):
    monkeypatch.setattr(simhash, "GROUP_ROWS", rows_of_group)
    prints = crowds(random.Random(3))
    signed = [x - (x >> 63 << 64) for x in prints]
    got = {r.node: r.component for r in simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 4, limit).collect()}
    together = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == c) for c in set(labels))
    assert together([got.get(x, x) for x in signed]) == together(brute_components(prints, 4))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="sample tables are not there")
@pytest.mark.parametrize("name", ["resampling", "periodic"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    module = {"resampling": resampling, "periodic": periodic}[name]
    got = module.query(table(spark, DIR, "documents"), *[table(spark, DIR, "benchmark")] * (name == "resampling"))
    want = con.sql(module.SQL)
    assert plain(got.collect()) == plain(want.select(*got.columns).fetchall())
