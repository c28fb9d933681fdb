"""Jaccard join on word shingles by token-combination prefixes.

A document's set holds its distinct shingles as 64-bit hashes. Two documents link when 100 * |intersection| >= percent * |union|.

1. Documents with the same words form a class; its smallest doc_id stands for it, and only that one goes on.
2. Screen: in hash order, two linked sets share at least ``ell`` of the first (missing + ell) shingles of the smaller prefix,
   where ``missing`` shingles of a set may be absent from its partner. Sets with too few shared shingles in that prefix link
   with nothing; they are most of a corpus, and leave here after one shuffle of prefixes.
3. Prefixes: with document frequencies among the classes, shingles are ordered rare first. Rare ones are indexed singly; frequent
   ones in 2-combinations within hash buckets, for which the prefix is extended until no partner can escape: leaving every bucket
   with at most one common shingle must cost more than ``missing``. Buckets depend on the size class of the smaller set.
4. Candidates of a signature are first compared with one leader only, the one whose shingles are most common, and linked ones
   merged. Where a signature still holds several components, members outside the largest try a few members of it, in ``ROUNDS``
   rounds; what then still stands apart is compared in blocks with the signature's other members, sets against sets in numpy, and
   only links leave a block. So a group of thousands of near copies costs a few comparisons each, candidate pairs never become
   rows, and no link between different components is left unchecked.
5. Candidates are verified on whole sets.

Frequencies are grouped sums, which Spark adds up before it shuffles; they return to their shingles in joins, whose large
partitions adaptive execution splits. Somewhere in a large corpus two shingles will have one hash; that can only add candidates. The verdict
on a pair hangs on the hashes of its own shingles alone, at most n^2 / 2^64 likely to be equal in two sets of n.

Edge cases: texts without words (null, empty) have n_shingles 0 and link with nothing, each its own component. Texts of fewer words
than a shingle are one shingle, the whole sequence. Rows whose doc_id is null link with nothing and have a null component. Rows that repeat
a doc_id each have their own n_shingles; their links are those of the text whose digest is smallest. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.bpe import _Aged
from chromaframe.llm.common import SPACE_WORDS, arrow, columns, record_batch, remove, slices, text_bytes, written
from chromaframe.llm.components import components

WORDS = 5
PERCENT = 75
#: Ids of screened documents are broadcast up to this many (about 24 MB as a hash relation), joined by a shuffle beyond.
MAX_BROADCAST_IDS = 500_000
#: Shingles in at most so many classes are indexed singly.
RARE = 16
#: Rounds in which members apart try this many others each, before all pairs across components are compared.
ROUNDS, TRIES = 2, 4
#: Sets compared as one block, on either side.
BLOCK = 256
#: Sets under 2^SMALL shingles use single shingles only.
SMALL = 5

_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_hashes = _Aged(lambda w: xxhash.xxh64_intdigest(w), 200_000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of a shorter, not empty sequence the one hash of all of it."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        total = _mix(total + h[j : len(h) - k + 1 + j] * np.uint64(_MULTIPLIERS[j % 5] + 2 * (j // 5)))
    return np.unique(total)


def missing(n: int, percent: int = PERCENT) -> int:
    """How many elements of a set of n may be absent from a linked set."""
    return n - -(-percent * n // 100)


def _ell(n: int) -> int:
    return max(1, n // 10)


SIZES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
)
SETS = T.StructType([T.StructField("rep", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])


def _digest(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _sizes(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Every row's set size, with the digest of its words and the prefix to screen by; null and empty without words or doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(SIZES)
        for batch in slices(batches, "text", 4 << 20):
            sizes, digests, prefixes = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text.translate(SPACE_WORDS).split()
                s = shingles(words, width)
                sizes.append(len(s))
                known = len(words) > 0 and doc is not None
                digests.append(_digest(words) if known else None)
                prefixes.append(s[: missing(len(s), percent) + _ell(len(s))] if known else s[:0])
            yield record_batch(schema, [batch.column("doc_id"), sizes, digests, _lists(prefixes).cast(schema.field(3).type)])

    return texts.mapInArrow(run, SIZES)


def _frequent(tokens: DataFrame) -> DataFrame:
    """``tokens`` that occur in more than one row, with the number ``df`` of these."""
    return tokens.join(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "token")


def _few(ids: DataFrame) -> DataFrame:
    """``ids`` to be broadcast where they are few."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def _screen(sizes: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """Classes (rep, digest) that share enough prefix shingles with others to link with anything."""
    copies = member.where("doc_id <> rep").select("doc_id")
    prefixes = sizes.join(_few(copies), "doc_id", "left_anti").select(F.col("doc_id").alias("rep"), F.explode("prefix").alias("token"))
    shared = _frequent(prefixes).groupBy("rep").count()
    least = F.ceil(F.col("n") * percent / 100)  # of the smallest partner
    need = sizes.groupBy(F.col("doc_id").alias("rep")).agg(F.min(F.greatest(F.lit(1), F.floor(least / 10))).alias("need"))
    classes = member.where("doc_id = rep").select("rep", "digest")
    return classes.join(shared, "rep").join(need, "rep").where(F.col("count") >= F.col("need")).select("rep", "digest")


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The shingles of the wanted classes."""
    marked = texts.join(_few(wanted), F.col("doc_id") == F.col("rep")).select("rep", "text", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(SETS)
        for batch in slices(batches, "text", 4 << 20):
            reps, sets = [], []
            for rep, text, digest in zip(*(batch.column(c).to_pylist() for c in ("rep", "text", "digest")), strict=True):
                words = text.translate(SPACE_WORDS).split()
                if _digest(words) == digest:
                    reps.append(rep)
                    sets.append(shingles(words, width))
            yield record_batch(schema, [reps, [len(s) for s in sets], _lists(sets).cast(schema.field(2).type)])

    return marked.mapInArrow(run, SETS).dropDuplicates(["rep"])


SIGNATURES = T.StructType(
    [T.StructField("sig", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shared", T.LongType()), T.StructField("common", T.DoubleType())]
)


def signatures(n: int, df: np.ndarray, tokens: np.ndarray, percent: int = PERCENT, rare: int = RARE) -> np.ndarray:
    """Signatures of a set of ``n`` shingles, of which ``tokens`` occur in ``df`` > 1 sets, all others in this one only.

    Linked sets have a signature in common. A set is indexed under the size class of the smaller of any pair that it can be in:
    its own, and the one below if a partner can be there.
    """
    lost = missing(n, percent)
    alone = n - len(tokens)
    if alone > lost:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    own = n.bit_length() - 1
    out = []
    for size_class in (own, own - 1) if -(-percent * n // 100) < 1 << own and own else (own,):
        need = lost + 1 - alone  # what the shared part of the prefix must still cost
        seed = np.uint64((size_class + 1) * _MULTIPLIERS[1] & 0xFFFFFFFFFFFFFFFF)
        single = len(tokens) if size_class < SMALL else int(np.searchsorted(df, rare, side="right"))
        single = min(single, need)
        out.append(_mix(tokens[:single] + seed))
        need -= single
        if need <= 0:
            continue
        rest = tokens[single:]
        bucket = (_mix(rest ^ seed) % np.uint64(max(1, 1 << (size_class - 2)))).astype(np.int64)
        seen: dict[int, list[int]] = {}
        first, second = [], []
        for i, b in enumerate(bucket.tolist()):
            others = seen.setdefault(b, [])
            if others:
                first += others
                second += [i] * len(others)
                need -= 1
            others.append(i)
            if need <= 0:
                break
        a, b = rest[first], rest[second]
        out.append(_mix(_mix(np.minimum(a, b) + seed) + np.maximum(a, b)))
    return np.unique(np.concatenate(out))


def _signature_rows(classes: DataFrame, percent: int) -> DataFrame:
    tokens = _frequent(classes.select("rep", "n", F.explode("tokens").alias("token")))
    own = tokens.groupBy("rep", "n").agg(F.collect_list("token").alias("tokens"), F.collect_list("df").alias("df"))  # bounded by a document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(SIGNATURES)
        for batch in batches:
            for rep, n, token, df in zip(*(batch.column(c) for c in ("rep", "n", "tokens", "df")), strict=True):
                token = token.values.to_numpy(zero_copy_only=False).view(np.uint64)
                sigs = signatures(n.as_py(), df.values.to_numpy(zero_copy_only=False), token, percent)
                if len(sigs):
                    k = len(sigs)
                    common = df.values.to_numpy(zero_copy_only=False).sum() / n.as_py()
                    yield record_batch(schema, [sigs.view(np.int64), np.full(k, rep.as_py()), np.full(k, n.as_py()), np.full(k, len(token)), np.full(k, common)])

    return own.mapInArrow(run, SIGNATURES)


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    sets = classes.select("rep", "tokens")
    both = pairs.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(100 * common >= percent * (F.size("ta") + F.size("tb") - common)).select("a", "b")


def _fits(a: str, b: str, percent: int):
    """Whether sets a and b can link by size (n) and by how many of their shingles occur in other sets at all (shared)."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    return (100 * na >= percent * nb) & (100 * nb >= percent * na) & ((100 + percent) * F.least(f"{a}shared", f"{b}shared") >= percent * (na + nb))


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _counts(u: np.ndarray, ends: np.ndarray, holders: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """How many of ``tokens`` each of n sets holds, from the sorted tokens ``u`` with the sets that hold each."""
    at = np.minimum(np.searchsorted(u, tokens), len(u) - 1)
    at = at[u[at] == tokens]
    size = ends[at + 1] - ends[at]
    total = int(size.sum())
    if not total:
        return np.zeros(n, np.int64)
    where = np.repeat(ends[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)
    return np.bincount(holders[where], minlength=n)


def _block_links(apart: list[dict], others: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of sets, one for each set apart and component of the others."""
    tokens = [np.asarray(s["tokens"]) for s in apart]
    flat = np.concatenate(tokens)
    order = np.argsort(flat, kind="stable")
    holders = np.repeat(np.arange(len(apart)), [len(t) for t in tokens])[order]
    u, first = np.unique(flat[order], return_index=True)
    ends = np.append(first, len(flat))
    n = np.array([len(t) for t in tokens])
    components_apart = np.array([s["component"] for s in apart])
    found: dict[tuple[int, int], int] = {}
    for other in others:
        mine = np.asarray(other["tokens"])
        common = _counts(u, ends, holders, mine, len(apart))
        hit = (100 * common >= percent * (n + len(mine) - common)) & (components_apart != other["component"])
        for i in np.flatnonzero(hit).tolist():
            found.setdefault((apart[i]["rep"], other["component"]), other["rep"])
    return [(min(a, b), max(a, b)) for (a, _), b in found.items()]


def _across(placed: DataFrame, mains: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All links between components that share a signature, one for each set apart and component.

    A set is apart where it does not belong to the signature's main component. Of two sets with a common signature and different
    components one is apart, and the other is apart or a member of that main component, so the blocks of each main component
    hold every candidate.
    """
    here = placed.join(mains.select("sig", "main"), "sig").select("main", "rep", "component").distinct()
    here = written(here.withColumn("apart", F.col("component") != F.col("main")), "ngram-apart")
    sizes = here.groupBy("main").agg(F.count(F.lit(1)).alias("n_all"), F.sum(F.col("apart").cast("int")).alias("n_apart"))
    cut = [F.ceil(F.col(c) / F.lit(BLOCK)).cast("int") for c in ("n_all", "n_apart")]
    sets = here.join(sizes.select("main", cut[0].alias("all_blocks"), cut[1].alias("apart_blocks")), "main").join(classes.select("rep", "tokens"), "rep")
    one = F.struct("rep", "component", "tokens")  # a block holds about BLOCK of them
    block = F.pmod(F.xxhash64("rep"), F.col("all_blocks")).alias("block")
    others = sets.select("main", block, one.alias("s")).groupBy("main", "block").agg(F.collect_list("s").alias("others"))
    own = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("apart_blocks")).alias("own")
    apart = sets.where("apart").select("main", own, "all_blocks", one.alias("s")).groupBy("main", "own", "all_blocks").agg(F.collect_list("s").alias("sets"))
    pairs = apart.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_blocks") - 1))).join(others, ["main", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(LINKS)
        for batch in batches:
            for i in range(batch.num_rows):
                links = _block_links(batch.column("sets")[i].as_py(), batch.column("others")[i].as_py(), percent)
                if links:
                    yield record_batch(schema, [list(c) for c in zip(*links, strict=True)])

    return pairs.select("sets", "others").mapInArrow(run, LINKS).distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (rep, component) after ``links`` (a, b) have merged components."""
    of = labels.withColumnRenamed("component", "c")
    edges = links.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(edges).toDF("component", "into")
    out = written(labels.join(merged, "component", "left").select("rep", F.coalesce("into", "component").alias("component")), "ngram-labels")
    remove(labels.sparkSession, merged)
    return out


def _open(placed: DataFrame, *order) -> DataFrame:
    """Signatures with several components: their largest one, and one member (a, na) of it."""
    per = placed.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(*order, "rep", "n", "shared")).alias("lead"))
    mains = per.groupBy("sig").agg(F.max(F.struct("k", "component", "lead")).alias("m"), F.count(F.lit(1)).alias("components")).where("components > 1")
    return mains.select("sig", F.col("m.component").alias("main"), F.col("m.lead.rep").alias("a"), F.col("m.lead.n").alias("an"), F.col("m.lead.shared").alias("ashared"))


def linked_classes(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Components (rep, component) of classes (rep, n, tokens), and the links that were verified."""
    rows = written(_signature_rows(classes, percent), "ngram-signatures")
    labels = rows.select("rep", F.col("rep").alias("component")).distinct()
    leaders = rows.groupBy("sig").agg(F.max(F.struct("common", -F.col("rep"), "rep", "n", "shared")).alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1")
    leaders = leaders.select("sig", F.col("lead.rep").alias("a"), F.col("lead.n").alias("an"), F.col("lead.shared").alias("ashared"))
    pairs = rows.join(leaders, "sig").where((F.col("rep") != F.col("a")) & _fits("", "a", percent)).select("a", F.col("rep").alias("b"))
    tested = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ngram-pairs")
    links = written(_verified(tested, classes, percent), "ngram-links")
    labels = _joined(labels, links)
    for turn in range(ROUNDS):
        placed = rows.join(labels, "rep")
        mains = _open(placed, F.xxhash64("sig", "rep", F.lit(turn)))
        order = Window.partitionBy("rep").orderBy(F.xxhash64("sig", F.lit(turn)))
        apart = placed.join(mains, "sig").where((F.col("component") != F.col("main")) & _fits("", "a", percent))
        tries = apart.withColumn("try", F.row_number().over(order)).where(F.col("try") <= TRIES)
        pairs = tries.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
        new = written(pairs.join(tested, ["a", "b"], "left_anti"), "ngram-pairs")
        more = written(_verified(new, classes, percent), "ngram-links")
        tested, links = tested.unionByName(new), links.unionByName(more)
        if not more.isEmpty():
            labels = _joined(labels, more)
    placed = written(rows.join(labels, "rep"), "ngram-placed")
    last = written(_across(placed, _open(placed, F.xxhash64("rep")), classes, percent), "ngram-links")
    return (labels if last.isEmpty() else _joined(labels, last)), links.unionByName(last)


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Per row doc_id, n_shingles, component_id; and the verified links between class representatives (a, b).

    The links hold every pair compared and found similar; pairs inside a component that a leader already joined are not listed.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    sizes = written(_sizes(texts, width, percent), "ngram-sizes")
    one = sizes.where("digest is not null").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    reps = written(one.groupBy("digest").agg(F.min("doc_id").alias("rep")), "ngram-reps")  # so that a join can split a digest of many rows
    member = written(one.join(reps, "digest").select("doc_id", "digest", "rep"), "ngram-members")
    wanted = written(_screen(sizes, member, percent), "ngram-wanted")
    counted = written(sizes.select("doc_id", F.col("n").alias("n_shingles")), "ngram-counts")
    remove(spark, sizes)
    classes = written(_sets(texts, wanted, width), "ngram-classes")
    merged, links = linked_classes(classes, percent)
    component = member.select("doc_id", "rep").join(merged, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    out = counted.join(component, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    found = written(out, "ngram-components")
    for table in (reps, member, wanted, counted, classes, merged):
        remove(spark, table)
    return found, links


def deduplicate(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the smallest doc_id; rows without a doc_id stay, all columns stay."""
    found, _ = near_duplicates(docs, width, percent)
    drop = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "ngram-dropped")
    return docs.join(_few(drop), "doc_id", "left_anti").select(*columns(docs))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)[0]


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n AS na ON a = na.doc_id JOIN n AS nb ON b = nb.doc_id WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id
"""
