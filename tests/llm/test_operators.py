"""Each corpus operator on one awkward table (nulls, empty, long, ties, repeated rows, clashing columns) against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chromaframe.llm import bpe, components, decontamination, exact_dedup, katz, licenses, ngram_join, packing, pii, quality, token_counts, token_files

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, spans string, token string, digest string, score double"
EXTRA = ("en", "s", 0, 7, "clash", "clash", "clash", 0.5)


def rows():
    r = random.Random(11)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "ever.", "the", "of", "and", "zone", "Quick"] + [f"w{i}x" for i in range(60)]
    base = " ".join(r.choices(vocabulary, k=80))
    near = base.split()
    near[40] = "CHANGED"
    texts = {
        0: None, 1: "", 2: "   \n\t ", 3: base, 4: base, 5: " ".join(near), 6: base.upper(), 7: "one two", 8: "one two", 9: "a" * 50_000,
        10: " ".join(r.choices(vocabulary, k=20_000)), 11: "mail a.b@x.org or +1 (743) 555-3824, ip 10.0.0.256 1.2.3.4 card 4111 1111 1111 1111",
        12: "Under the MIT license.\nSPDX-License-Identifier: (GPL-2.0 OR Apache-2.0) AND MIT WITH x\ncc-by-nc", 13: "x  <|endoftext|>  y　z \x1c q don't",
        14: "the quick brown fox jumps over the lazy dog near the river bank today", 15: "日本語 текст ﬁ İstanbul 😀 é", 16: "0" * 3000 + "@" + "b" * 3000,
    }
    for i in range(20, 60):
        texts[i] = " ".join(r.choices(vocabulary, k=r.randint(1, 120)))
    out = [(k, v, *EXTRA) for k, v in texts.items()]
    return [*out, (3, base, *EXTRA), (None, "no id at all here now", *EXTRA), (None, None, *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def by_row(result, *columns):
    """Counter of (doc_id, columns): rows may repeat."""
    return Counter((r.doc_id, *(r[c] for c in columns)) for r in result.collect())


# decontamination

ITEMS = [(1, "Quick brown fox jumps over the lazy dog near the river bank today maybe"), (2, "one two"), (3, ""), (4, None), (2, "one two"), (None, "ever the of")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def brute_contamination(text):
    words, hit, found = alnum_words(text), set(), set()
    for item, t in ITEMS:
        w = alnum_words(t)
        n = min(10, len(w))
        for window in (w[i : i + n] for i in range(len(w) - n + 1) if n):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == window:
                    hit |= set(range(i, i + n))
                    found |= set() if item is None else {item}
    ids = ",".join(sorted(map(str, found)))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_decontamination(docs, items, empty):
    want = Counter((r[0], *brute_contamination(r[1])) for r in rows())
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_row(decontamination.query(docs, items), *columns) == want
    assert decontamination.query(empty, items).isEmpty()
    assert not decontamination.query(docs, items.where("false")).where("contaminated").count()
    shuffled = decontamination.contamination(docs, items, max_windows=1).collect()
    direct = decontamination.contamination(docs, items).collect()

    def key(r):
        return r.doc_id is None, r.doc_id or 0, r.n_words, r.spans, r.item_ids

    assert sorted(map(key, shuffled)) == sorted(map(key, direct))


def test_decontaminate_by_join_as_by_broadcast(spark):
    leak = " ".join(f"leak{i}" for i in range(12))
    data = [(None, f"a {leak} b", 1), (1, f"c, {leak}. d", 2), (1, "a clean text of the same id", 3), (None, "clean", 4), (2, None, None), (3, f"{leak}\n{leak}", 5), (4, f"\u00e9 {leak}", 6)]
    frame = spark.createDataFrame(data, "doc_id long, text string, n_chars int").repartition(3)
    bench = spark.createDataFrame([(9, leak)], "item_id long, text string")
    for remove, n in (("documents", 3), ("spans", 7)):
        direct, joined = (decontamination.decontaminate(frame, bench, remove=remove, max_windows=m) for m in (1000, 1))
        assert joined.schema == direct.schema
        assert sorted(map(repr, joined.collect())) == sorted(map(repr, direct.collect())) and joined.count() == n
    assert not joined.where("text like '%leak%'").count()


ODD = "doc_id long, text string, _row long, _file string, _spans string, _metadata string, row int, spans int, `all` string, `a.b` int, n_chars int"


@pytest.mark.parametrize("max_windows", [1000, 1])
@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_decontaminate_carries_columns_of_any_name(spark, max_windows, remove):
    leak = " ".join(f"leak{i}" for i in range(12))
    odd = (88, "f", "s", "m", 1, 2, "w", 3)
    frame = spark.createDataFrame([(1, f"a {leak} b", *odd, 0), (2, "clean", *odd, 5), (None, None, *odd, None)], ODD).repartition(2)
    out = decontamination.decontaminate(frame, spark.createDataFrame([(9, leak)], "item_id long, text string"), remove=remove, max_windows=max_windows)
    assert out.schema == frame.schema
    want = [(2, "clean", *odd, 5), (None, None, *odd, None)] + [(1, "a  b", *odd, 4)] * (remove == "spans")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_join_merges_spans_of_long_texts(spark):
    """A text that is one passage after the other, with items that overlap, by join as by broadcast."""
    passages = [" ".join(f"p{i}w{j}" for j in range(15)) for i in range(4)]
    text = " ".join([*passages * 40, "apart", *passages[:1], *(p[4:] for p in passages)])
    frame = spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(i, p) for i, p in enumerate(passages)] + [(9, "apart p0w0"), (10, None)], "item_id long, text string")
    direct, joined = (sorted(map(repr, decontamination.contamination(frame, items, max_windows=m).collect())) for m in (1000, 1))
    assert direct == joined


def test_decontaminate_removes(docs, items):
    bad = {r[0] for r in rows() if brute_contamination(r[1])[-1]}
    kept = decontamination.decontaminate(docs, items)
    assert kept.schema == docs.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows() if not brute_contamination(r[1])[-1])
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items, remove="spans").collect()}
    assert cut[7] == "" and "fox" not in cut[14] and cut[0] is None
    assert 14 in bad


# tokens


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path):
    library, own = Tokenizer.from_file(path), bpe.Encoder(path)
    r = random.Random(2)
    letters = list("ab12 '!.\n\t  \r　 \xa0éßñ中😀́​\x1c\x85ﬁİΣ") + ["<|endoftext|>", "<|startoftext|>", "'ll", " the", "͸", "  ", "   "]
    texts = ["".join(r.choices(letters, k=r.randint(0, 25))) for _ in range(3000)] + [t[1] or "" for t in rows()]
    for t in texts:
        assert own.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(BYTE)
    want = Counter()
    for r in rows():
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 512] += 1
    assert by_row(token_counts.query(docs, BYTE), "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.query(empty, BYTE).isEmpty()
    whole = token_counts.whole_tokens(BYTE)
    assert " the" in whole and all(len(library.encode(t).ids) == 1 for t in list(whole)[:500])


def test_simple8b():
    r = np.random.default_rng(0)
    for n in (0, 1, 59, 61, 3000):
        for top in (1, 2, 300, 50257, 2**31, 2**60, 2**63):
            x = r.integers(0, top, n, dtype=np.uint64)
            x[::5] = 0
            assert (token_files.decode(token_files.encode(x), n) == x).all()
    x = np.array([2**64 - 1, 2**60, 0, 2**63], np.uint64)
    assert (token_files.decode(token_files.encode(x), 4) == x).all()


def test_token_files(spark, docs, empty, tmp_path):
    library = Tokenizer.from_file(BYTE)
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for r in order:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.query(docs, BYTE).orderBy("start").collect()]
    assert got == want
    token_files.write(docs, str(tmp_path / "f"), BYTE)
    read = {r.start: r.ids for r in token_files.read(spark, str(tmp_path / "f")).collect()}
    assert all(len(read[w[1]]) == w[2] for w in want)
    assert token_files.query(empty, BYTE).isEmpty()


def test_packing(docs, empty):
    library = Tokenizer.from_file(WORD)
    pieces = packing.pack(docs, WORD, with_ids=True, group=2).collect()
    whole = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        whole[p.doc_id].append(p)
    for r in rows():
        if sum(x[0] == r[0] for x in rows()) == 1:
            ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
            mine = sorted(whole[r[0]], key=lambda p: p.start)
            assert [i for p in mine for i in p.ids] == ids and {p.doc_tokens for p in mine} == {len(ids)}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert sum(p.length for p in pieces) == sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows())
    assert packing.pack(empty, WORD).isEmpty()


def test_windows_are_nearly_full_and_nearly_equal(spark):
    """Over a whole run: little padding beyond the last group of a partition, and windows of one group of nearly equal length."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    windows = Counter()
    for p in packing.pack(docs, WORD, group=16).select("sequence_id", "length").collect():
        windows[p.sequence_id] += p.length
    lengths = [windows[s] for s in sorted(windows)]
    assert max(lengths) <= 4096 and len(lengths) > 40
    padding = sum(4096 - n for n in lengths)
    assert padding <= 0.01 * 4096 * len(lengths) + 4096, padding / (4096 * len(lengths))
    short = sum(n < 0.97 * 4096 for n in lengths)
    assert short <= 16, short  # the last group has what is left, shared out evenly


def test_differencing_levels_windows():
    r = random.Random(1)
    sizes = [r.randint(1, 900) for _ in range(300)]
    groups = packing.differencing(sizes, 12)
    assert sorted(i for g in groups for i in g) == list(range(300))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) - min(sums) <= 10
    assert len(packing.windows([60, 60, 60], 100)) == 3 and packing.windows([], 100) == []


# deduplication


def brute_exact():
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_exact_dedup(docs, empty):
    groups = brute_exact()
    got = exact_dedup.query(docs).collect()
    assert len(got) == len(rows())
    texts = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == texts[r.text_sha256]
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(texts))
    kept = exact_dedup.deduplicate(docs)
    assert kept.schema == docs.schema and Counter(r.text or "" for r in kept.collect()) == Counter(list(groups))
    assert exact_dedup.query(empty).isEmpty()


@pytest.mark.parametrize("file", [False, True])
def test_exact_dedup_carries_columns_of_any_name(spark, tmp_path, file):
    """Columns named like locators are the user's, with equal values, different ones, or of other types."""
    rows = [(2, "x y z", 1, "f"), (3, "x y z", 2, "f"), (4, "q", 1, "f"), (5, "q", 1, "f"), (6, "", 1, "g"), (7, None, 1, None)]
    for schema in ("doc_id long, text string, _row int, _file string", "doc_id long, text string, _metadata int, _row string", "doc_id long, text string, row int, keep string", "doc_id long, text string, `a.b` int, digest string"):
        frame = spark.createDataFrame(rows, schema)
        if file:
            path = str(tmp_path / str(hash(schema)))
            frame.repartition(2).write.parquet(path)
            frame = spark.read.parquet(path)
        out = exact_dedup.deduplicate(frame)
        assert out.columns == frame.columns and sorted(map(tuple, out.collect())) == [(3, "x y z", 2, "f"), (5, "q", 1, "f"), (7, None, 1, None)]
    every = exact_dedup.deduplicate(frame.select(F.explode(F.array("doc_id", F.col("doc_id") * 10)).alias("doc_id"), "text"))
    assert sorted(r.doc_id for r in every.collect()) == [30, 50, 70]


def test_exact_dedup_goes_on_over_frames(spark, tmp_path):
    runs = [[(1, "one"), (9, "same")], [(4, "one"), (6, "same"), (5, "new")]]
    kept = [sorted(map(tuple, exact_dedup.deduplicate(spark.createDataFrame(r, "doc_id long, text string"), str(tmp_path / "state")).collect())) for r in runs]
    assert kept == [[(1, "one"), (9, "same")], [(4, "one"), (5, "new")]]


def test_exact_dedup_with_colliding_digests(docs):
    weak = lambda text: exact_dedup.sha256(F.length(text).cast("string"))
    groups = brute_exact()
    sizes = Counter((r.keep_id, r.group_size) for r in exact_dedup.decisions(docs, digest=weak).collect())
    want = Counter(groups[r[1] or ""] for r in rows())
    assert sizes == want


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_goes_on_from_state(spark, tmp_path, weak):
    """A second run compares bytes with rows that the first one kept, under full digests and under ones that collide."""
    digest = (lambda text: exact_dedup.sha256(F.length(text).cast("string"))) if weak else exact_dedup.sha256
    runs = [[(1, "one"), (2, "two"), (9, "same"), (3, "four")], [(4, "one"), (5, "new"), (6, "same"), (7, "same"), (8, "diff")]]
    got = []
    for i, data in enumerate(runs):
        spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"run {i}"))
        found = exact_dedup.decisions(spark.read.parquet(str(tmp_path / f"run {i}")), state=str(tmp_path / "state"), digest=digest)
        got.append({r.doc_id: (r.keep_id, r.kept) for r in found.collect()})
    assert got[0] == {1: (1, True), 2: (2, True), 3: (3, True), 9: (9, True)}
    assert got[1][6] == got[1][7] == (9, False) and got[1][4] == (4, True)
    assert got[1][5] == (5, True) and got[1][8] == (8, True)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(30)] + [(1000 + i, 1001 + i) for i in range(20)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {c.node: c.component for c in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(v == find(k) for k, v in got.items()) and {x for a, b in edges if a != b for x in (a, b)} == set(got)


def brute_near():
    sets = {}
    for r in rows():
        w = space_words(r[1])
        s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        if r[0] is not None:
            sets[r[0]] = s
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def test_near_duplicates(docs, empty):
    want = brute_near()
    got = ngram_join.query(docs).collect()
    assert len(got) == len(rows())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = ngram_join.deduplicate(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {None} | {k for k, (_, c) in want.items() if c == k}
    assert ngram_join.query(empty).isEmpty()


def test_linked_sets_share_a_signature():
    r = random.Random(3)
    for _ in range(400):
        n = r.choice([1, 2, 3, 5, 8, 20, 33, 60, 130, 300])
        universe = r.sample(range(1, 10**9), 3 * n)
        x = set(universe[:n])
        y = set(x)
        while True:
            z = set(y)
            (z.discard if r.random() < 0.5 else z.add)(r.choice(list(z)) if r.random() < 0.5 else r.choice(universe))
            if not z or 100 * len(x & z) < 75 * len(x | z) or r.random() < 0.02:
                break
            y = z
        df = {t: r.choice([2, 5, 17, 400]) for t in x & y} | {t: r.choice([1, 3, 90]) for t in x ^ y}
        sigs = []
        for s in (x, y):
            shared = [t for t in s if df[t] > 1]
            sigs.append(set(ngram_join.signatures(len(s), np.array([df[t] for t in shared], np.int64), np.array(shared, np.uint64)).tolist()))
        assert sigs[0] & sigs[1], (len(x), len(y))


# personal data and licences

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_base_spans_by_brute_force():
    r = random.Random(1)
    letters = list("a.@@b1.2+ -()5") + ["25", "4111 1111 1111 1111", "@a.b", "1.2.3.4", "+1 (743) 555-3824", "00"]
    for _ in range(5000):
        t = "".join(r.choices(letters, k=r.randint(0, 14)))
        assert sorted(pii.base_spans(t)) == brute_spans(t), t


def test_pii(docs, empty):
    want = Counter()
    for r in rows():
        text = r[1] or ""
        spans = brute_spans(text) if len(text) < 4000 else pii.base_spans(text)
        said = ",".join(f"{BASE[k][0]}:{a}:{b}" for k, a, b in spans)
        want[(r[0], *(sum(s[0] == k for s in spans) for k in range(4)), hashlib.sha256(said.encode()).hexdigest())] += 1
    got = pii.query(docs)
    assert by_row(got, "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    assert pii.query(empty).isEmpty()
    clean = {r.doc_id: r.text for r in pii.redact(docs.where("doc_id in (0, 3, 11)").dropDuplicates(["doc_id"])).collect()}
    assert clean[11].startswith("mail <email> or <phone>, ip 10.0.0.256 <ip> card <card>") and clean[0] is None


def planted_spans(r):
    """A text with personal data of every kind and with things that only look like it; the true spans (kind, start, end)."""

    def digits(n):
        return "".join(r.choices("0123456789", k=n))

    def card(n, right=True):
        while pii.luhn(d := r.choice("3456") + digits(n - 1)) != right:
            pass
        return d

    def iban():
        body = digits(16)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    yes = [
        ("email", lambda: f"{r.choice(['ann', 'bob.x', 'eve_1'])}@mail{digits(1)}.example.{r.choice(['com', 'org', 'de'])}"), ("ip", lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))),
        ("card", lambda: card(16)), ("card", lambda: card(15)), ("phone", lambda: f"+1 ({r.randint(200, 999)}) 555-{digits(4)}"), ("phone", lambda: f"{r.randint(200, 999)}-{r.randint(200, 999)}-{digits(4)}"),
        ("iban", iban), ("ssn", lambda: f"{r.randint(100, 600)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"), ("secret", lambda: f'api_key = "{r.randbytes(20).hex()}'),
    ]
    lead = {"iban": "iban", "ssn": "ssn", "phone": "call", "card": "card"}
    no = [lambda: card(16, False), lambda: card(14, False), lambda: f"version {r.randint(256, 900)}.1.{digits(1)}.2", lambda: f"commit {r.randbytes(20).hex()}", lambda: f"order 0{digits(2)}-{r.randint(200, 999)}-{digits(4)}", lambda: f"@{r.choice(['ann', 'bob'])}x@host "]
    text, spans = "some words", []
    for _ in range(r.randint(0, 5)):
        if r.random() < 0.55:
            kind, make = r.choice(yes)
            text += f" {lead[kind]} " if kind in lead and r.random() < 0.6 else " about "
            found = make()
            spans.append((kind, len(text), len(text) + len(found)))
            text += found
        else:
            text += " with " + r.choice(no)()
    return text + " end", spans


def test_pii_spans_of_planted_kinds(spark):
    r = random.Random(8)
    planted = [planted_spans(r) for _ in range(1500)]
    found, model = pii.detect(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted)], "doc_id long, text string").repartition(3))
    want = {(i, *s) for i, (_, spans) in enumerate(planted) for s in spans}
    rows_ = found.collect()
    got = {(d.doc_id, pii.KINDS[c.kind], c.start, c.end) for d in rows_ for c in d.spans}
    rejected = {(d.doc_id, pii.KINDS[c.kind], c.start, c.end) for d in rows_ for c in d.rejected}
    assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got), (len(want), len(got), len(want & got))
    for kind in pii.KINDS:
        mine = {w for w in want if w[1] == kind}
        assert len(mine & got) >= 0.9 * len(mine), (kind, len(mine), len(mine & got))
    # without the classifier all candidates would stay, and many of them are wrong
    assert len(rejected) > 500 and len(want & rejected) < 0.1 * len(rejected) and len(want & (got | rejected)) < 0.8 * len(got | rejected)
    right = model.reliabilities()
    assert right["pattern"][0] > 0.8 and right["pattern"][1] > 0.8, right


def test_redact_of_awkward_rows(spark):
    data = [(None, "mail a.b@x.org", "x"), (1, "ip 1.2.3.4 a", "y"), (1, "a clean text", "z"), (2, None, None)]
    frame = spark.createDataFrame(data, "doc_id long, text string, spans string")
    got = pii.redact(frame)
    assert got.schema == frame.schema
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(None, "mail <email>", "x"), (1, "ip <ip> a", "y"), (1, "a clean text", "z"), (2, None, None)]))
    assert pii.redact(frame.where("false")).isEmpty()


def test_pii_secret_spans_the_whole_value():
    for n in (16, 256, 257, 5000):
        text = f"see api_key={'a1B2' * n}"[: 12 + n] + " end"
        assert pii.loose_spans(text) == [(pii.KINDS.index("secret"), 4, 12 + n)], n


def test_reliabilities_separate_good_labelers():
    r = random.Random(4)
    counted = Counter()
    for _ in range(4000):
        y = r.random() < 0.6
        said = [(1 if y else -1) if r.random() < q else (-1 if y else 1) for q in (0.95, 0.9, 0.85)] + [r.choice([-1, 0, 1]), 0]
        counted[pii._key(0, said, 10)] += 1
    model = pii.fit(sorted(counted.items()))
    assert model.reliability[0, 1, 2] > 0.85 and model.reliability[0, 0, 0] > 0.8 and abs(model.prior - 0.6) < 0.1
    assert abs(model.reliability[3, 1, 2] - model.reliability[3, 0, 2]) < 0.1


def test_licenses(docs, empty):
    want = Counter()
    for r in rows():
        w = alnum_words(r[1])
        at, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        want[r[0], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))] += 1
    got = licenses.query(docs)
    assert by_row(got, "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert got.where("doc_id = 12").first().labels == "apache-2.0,cc-by-nc,gpl-2.0,mit"
    assert got.where("score < 0 or score > 1").isEmpty() and licenses.query(empty).isEmpty()


#: What some phrases mean.
MEANING = {
    "under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc", "apache license version 2 0": "apache-2.0", "gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl", "creative commons attribution": "cc-by", "creative commons attribution noncommercial": "cc-by-nc", "all rights reserved": "all-rights-reserved",
    "creative commons attribution sharealike": "cc-by-sa", "redistribution and use in source and binary forms": "bsd", "the software is provided as is without warranty of any kind": "", "isc license": "isc",
    "mozilla public license": "mpl", "released into the public domain": "public-domain", "this is free and unencumbered software released into the public domain": "public-domain",
}


def brute_license(text):
    """Labels, score and verdict by looking for every phrase at every word, and Python's own evaluation of tag expressions."""
    w, doubt = alnum_words(text), 1.0
    places = [(i, i + len(p.split()), p) for p in MEANING for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    within = {(a, b, p) for a, b, p in places for c, d, _ in places if c <= a and b <= d and (a, b) != (c, d)}
    seen = {p for a, b, p in places if (a, b, p) not in within or p in licenses.BASE_PHRASES}
    for _, _, n in {(p in licenses.BASE_PHRASES, MEANING[p], len(p.split())) for p in seen}:
        doubt *= licenses.WORD_DOUBT**n
    labels = {MEANING[p] for p in seen} - {""}
    named, fits = set(), True
    for tail in sorted({t.strip() for t in re.findall(r"(?i)SPDX-License-Identifier\s*:([^\r\n]*)", text)}):
        tokens = re.findall(r"[()]|[^\s()]+", tail)
        if "foo" in tail:
            doubt *= licenses.BROKEN_DOUBT
            continue
        code, ids, skip = [], [], False
        for t in tokens:
            if t.upper() == "WITH":
                skip = True
            elif t in "()" or t.upper() in ("AND", "OR"):
                code.append(t.lower())
            elif skip:
                skip = False
            else:
                ids.append(t.lower())
                code.append(str(t.lower() in licenses.PERMISSIVE))
        try:
            fits &= eval(" ".join(code))  # noqa: S307
        except SyntaxError:
            doubt *= licenses.BROKEN_DOUBT
            continue
        named |= set(ids)
        doubt *= licenses.TAG_DOUBT
    if labels | named != {"all-rights-reserved"}:
        labels -= {"all-rights-reserved"}
    loose = {p for p in labels if not any(i == p or i.startswith(p + "-") for i in named)}
    told = None if not labels | named else "permissive" if fits and loose <= licenses.PERMISSIVE else "restricted"
    return ",".join(sorted(labels | named)), round(1 - doubt, 9), told


def test_license_labels_scores_and_verdicts(spark):
    r = random.Random(6)
    phrases = list(MEANING)
    tags = ["foo", "MIT OR foo-2.0", "MIT", "GPL-2.0 OR MIT", "(MIT AND GPL-3.0-only) OR Apache-2.0", "LGPL-2.1 WITH x-exception AND MIT", "MIT AND", "", "BSD-3-Clause", "(ISC"]
    texts = ["", "no licence here", "under the mit licensed", "SPDX-License-Identifier: GPL-2.0 OR MIT\nGNU General Public License"]
    for _ in range(400):
        parts = [r.choice(phrases).upper().replace(" ", r.choice([" ", "  ", ", "])) for _ in range(r.randint(0, 3))]
        parts += [f"\nSPDX-License-Identifier: {r.choice(tags)}\n" for _ in range(r.choice([0, 0, 1, 2]))]
        r.shuffle(parts)
        texts.append(" some ".join(["a", *parts, "b"]))
    got = licenses.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {x.doc_id: (x.labels, round(x.score, 9), x.verdict) for x in got.collect()} == {i: brute_license(t) for i, t in enumerate(texts)}
    assert {x.verdict for x in got.collect()} == {None, "permissive", "restricted"}


#: Ordinary notices, with the labels and the verdict that they must get.
NOTICES = [
    ("Copyright (c) 2020, X. All rights reserved.\nRedistribution and use in source and binary forms, with or without modification, are permitted", "bsd", "permissive"),
    ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc", "restricted"),
    ('Boost Software License - Version 1.0. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED', "bsl", "permissive"),
    ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND', "mit", "permissive"),
    ("// SPDX-License-Identifier: foo\n", "", None),
    ("// SPDX-License-Identifier: LicenseRef-house\n", "licenseref-house", "restricted"),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later+ OR BSD-3-Clause */ All rights reserved", "bsd-3-clause,gpl-2.0-or-later+", "permissive"),
    ("Copyright X. All rights reserved.", "all-rights-reserved", "restricted"),
    ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND", "", None),
]


@pytest.mark.parametrize(("text", "labels", "told"), NOTICES)
def test_ordinary_notices(text, labels, told):
    found = licenses.scan_text(text.encode())
    assert ",".join(found[5]) == labels and found[8] == told


@pytest.mark.parametrize(
    "text, allowed, expected",
    [("MIT", {"mit"}, True), ("MIT AND (X OR Apache-2.0)", {"mit", "apache-2.0"}, True), ("A OR B AND C", {"b"}, False), ("A OR B AND C", {"a"}, True), ("GPL-2.0 WITH exc", {"gpl-2.0"}, True)],
)
def test_expressions(text, allowed, expected):
    assert licenses.evaluate(licenses.parse_expression(text), frozenset(allowed)) is expected


@pytest.mark.parametrize("text", ["", "AND", "MIT AND", "(MIT", "MIT)", "MIT Apache-2.0", "()"])
def test_bad_expressions(text):
    assert licenses.parse_expression(text) is None


# models


def test_trees_learn_and_flatten():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert quality.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert (quality.fit(x, np.ones(3000)).score(x) > 0.99).all()


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20, 60)] + [(None, 1, 0), (25, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.query(docs, labels).collect()
    assert len(got) == len(rows())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert quality.query(docs, labels.where("false")).where("score <> 0.5").isEmpty()
    assert quality.query(empty, labels).isEmpty()
    assert quality.filter_quality(docs, labels).schema == docs.schema


def test_flat_trees_by_a_plain_walk():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 6)).round(1)
    model = quality.fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float), trees=12, depth=3)
    for row, score in zip(x, model.score(x), strict=True):
        margin = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += value[node - 7]
        assert math.isclose(score, 1 / (1 + math.exp(-margin)), rel_tol=1e-12)


def test_training_labels(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20, 60)] + [(21, 1, 0), (21, 1, 0), (None, 1, 0), (25, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    every = Counter((r.doc_id, r.y) for r in quality.training_labels(docs, labels).collect())
    usable = [i for i in range(20, 60) if zlib.crc32(str(i).encode()) % 5 != 0]
    assert every == Counter([(i, i % 2) for i in usable if i != 25] + [(21, 1), (21, 1)] * (21 in usable) + [(25, 1)] * (25 in usable))
    some = [(r.doc_id, r.y) for r in quality.training_labels(docs, labels, max_train=7).collect()]
    assert len(some) == 7 and not Counter(some) - every


def test_training_takes_one_row_of_a_label(spark):
    many = spark.createDataFrame([(1, f"text {i % 3} of one") for i in range(300)] + [(2, "another"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    once = many.where("text is null or text like '%0%' or doc_id = 2").dropDuplicates()
    few = [quality.score(once, quality.train(m, labels)).orderBy("doc_id").collect() for m in (many, once)]
    assert few[0] == few[1]


def test_katz_beyond_the_most_partitions(docs, monkeypatch):
    want = katz.score(docs).collect()
    monkeypatch.setattr(katz, "MOST_PARTITIONS", 2)
    monkeypatch.setattr(katz, "BUCKET_GRAMS", 1000)
    same_scores(katz.score(docs).collect(), want)
    assert not [t for t in docs.sparkSession.catalog.listTables() if t.name.startswith("katz_blocks")]


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in found if r.quality == 1]
    bad = [r.score for r in found if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def brute_katz(data, order):
    """Scores of all texts by a Katz model of n-grams up to ``order``, and the model's discounts; every n-gram is kept."""
    end, begin = object(), object()
    docs = [(d, [*space_words(t), end]) for d, t in data]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs]
    counts = [Counter() for _ in range(order + 1)]
    for (_, w), out in zip(docs, held):
        if not out:
            counts[1].update((x,) for x in w)
            for k in range(2, order + 1):
                x = [begin, *w]
                counts[k].update(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    n, v = sum(counts[1].values()), len(counts[1])
    ratios = [None, *(katz.discounts([sum(c == r for c in t.values()) for r in range(1, 7)]) for t in counts[1:])]

    def cut(c, k):
        return c * (ratios[k][c - 1] if c <= 5 else 1)

    mass = sum(cut(c, 1) for c in counts[1].values())
    unknown = (n - mass + 1) / (n + 1)
    followers = defaultdict(list)
    for k in range(2, order + 1):
        for g in counts[k]:
            followers[g[:-1]].append(g[-1])

    def occurs(h):
        c = counts[1][(end,)] if h == (begin,) else counts[len(h)][h]
        return c + any(d == 1 for d in ratios[len(h) + 1][: min(c, 5)]) if c <= 5 else c + 1

    weights = {}

    def weight(h):
        if h not in weights:
            some = followers.get(h, [])
            gone = sum(cut(counts[len(h) + 1][(*h, w)], len(h) + 1) for w in some) / occurs(h) if some else 0
            weights[h] = (1 - gone) / (1 - sum(prob(h[1:], w) for w in some))
        return weights[h]

    def prob(h, w):
        k = len(h) + 1
        if k == 1:
            return cut(counts[1][(w,)], 1) / mass * (1 - unknown) if (w,) in counts[1] else unknown
        if (*h, w) in counts[k]:
            return cut(counts[k][(*h, w)], k) / occurs(h)
        return weight(h) * prob(h[1:], w)

    words = [w for (w,) in counts[1]]
    for h in [h for k in range(1, order) for h in list(f for f in followers if len(f) == k)[:15]]:
        assert math.isclose(sum(prob(h, w) for w in words) + prob(h, object()), 1, rel_tol=1e-9)
    out = []
    for (d, w), o in zip(docs, held):
        base = sum(math.log10((counts[1].get((x,), 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        x = [begin, *w]
        score = sum(math.log10(prob(tuple(x[max(0, i - order + 1) : i]), x[i])) for i in range(1, len(x)))
        out.append((d, o, len(w), sum((x,) in counts[1] for x in w), n, base, score))
    return ratios, out


def same_scores(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(a, b, rel_tol=1e-9) for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz(docs, order):
    same_scores(katz.score(docs, order).collect(), brute_katz([(r[0], r[1]) for r in rows()], order)[1])


def test_katz_without_rows(spark, docs, empty):
    assert katz.score(empty).isEmpty()
    assert all(r.score == 0 for r in katz.score(docs.where("doc_id in (6, 12)")).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def test_katz_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(katz, "BUCKET_GRAMS", 700)
    rng = np.random.default_rng(4)
    data = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) if x < 400)) for i in range(120)] + [(None, "w1 w2 once"), (7, ""), (3, "w1 w1 w1")]
    data += [(1000 + i, data[i][1]) for i in range(0, 120, 7)]
    ratios, want = brute_katz(data, 3)
    assert ratios[2][0] < 1 and ratios[3][0] < 1, ratios  # the discount of the count 1 is used
    same_scores(katz.query(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect(), want)
