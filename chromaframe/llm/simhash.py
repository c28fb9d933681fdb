"""SimHash near-duplicates by a self-join of a binary trie.

A fingerprint has a bit set where over half of the hashes of a document's shingles, repeats included, have it. Fingerprints link at ``BUDGET``
or fewer differing bits.

1. Rows with one fingerprint form a class; only distinct fingerprints are joined.
2. The trie is cut where it can be cut without loss: the 64 bits are dealt to ``blocks`` blocks, and two linked fingerprints agree in all but
   ``BUDGET`` of them at least. So for each choice of blocks - BUDGET blocks, fingerprints that agree in these are one trie, a row of a
   group keyed by the bits of the chosen blocks. More fingerprints take more blocks, so that a group stays near ``GROUP_ROWS``.
3. In a task its groups are sorted arrays, in which a range with a common prefix is a node. Pairs of nodes go down together bit by bit: a pair's
   children differ in one bit more or in none, and a pair over the budget is dropped. Pairs wait on a stack in portions of ``PORTION``, so the
   memory of a task is bounded.
4. Budgets rise from 1 to ``BUDGET``. What a smaller one linked is one component, and a pair of nodes that lies in one component is dropped: a
   crowd of near copies is joined by its close neighbours and never compared pair by pair. A task gives a forest of links.
5. A group beyond ``GROUP_LIMIT`` rows, a key of many different fingerprints, is cut into parts by hash; each two parts are a task. Parts grow
   only where there would be more than ``MOST_PARTS``, up to ``PART_ROWS`` rows, so the memory stays bounded.
6. The links of all tasks are joined into components by alternating stars.

Nothing is dropped: any two fingerprints within the budget end in one component.

Edge cases: a text of fewer words than a shingle is one shingle; texts without words, null ones too, have fingerprint zero and are linked like others.
Rows whose doc_id is null have a fingerprint and link, but don't name a component; one of such rows only has a null component. Rows that repeat
a doc_id are rows like others, each by its own text. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.common import SPACE_WORDS, arrow, columns, record_batch, remove, slices, text_bytes, written
from chromaframe.llm.components import components

WORDS = 4
SEED = 42
BUDGET = 4
#: Rows that a group of evenly spread fingerprints has at most; beyond, the bits are dealt to one block more, up to 8 (70 choices of 32 bits).
GROUP_ROWS = 64
MOST_BLOCKS = 8
#: Rows of a group that are one task's, parts of larger ones, and what parts may grow to.
GROUP_LIMIT, MOST_PARTS, PART_ROWS = 8192, 64, 1 << 20
#: Large groups that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_GROUPS = 100_000
#: Pairs of nodes that go down together, and pairs of fingerprints below which two nodes are compared outright.
PORTION, OUTRIGHT = 1 << 18, 16
#: Rows that a task's groups are put together to.
BATCH_ROWS = 1 << 16


def fingerprints(texts: list[bytes], width: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Fingerprints of UTF-8 texts."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = text.translate(SPACE_WORDS).split()
        if not words:
            continue
        line = b" ".join(words)
        k = min(width, len(words))
        ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))  # where each word ends in the line
        starts = itertools.chain((0,), (e + 1 for e in ends))
        h = np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)), np.uint64, len(words) - k + 1)
        ones = np.zeros(64, np.int64)
        for first in range(0, len(h), 1 << 16):  # bounds the bits of a very long text
            ones += np.unpackbits(h[first : first + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def _fingerprinted(docs: DataFrame, width: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            yield record_batch(arrow(FINGERPRINTS), [batch.column("doc_id"), fingerprints(batch.column("text").to_pylist(), width, seed).view(np.int64)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, FINGERPRINTS)


def masks(blocks: int, budget: int = BUDGET) -> list[int]:
    """The bits of each choice of ``blocks - budget`` blocks. Two numbers within the budget agree in all bits of one of them."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edge)]
    return [sum(chosen) for chosen in itertools.combinations(block, blocks - budget)]


def _blocks(n: int, budget: int) -> int:
    """Into how many blocks the bits are dealt for n fingerprints."""
    for blocks in range(budget + 1, MOST_BLOCKS):
        if n >> (64 * (blocks - budget) // blocks) < GROUP_ROWS:
            return blocks
    return max(MOST_BLOCKS, budget + 1)


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components ``label``, each its smallest index, after links a - b."""
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, before[side], least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _within(fp: np.ndarray, pairs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among pairs of small nodes (a, a's end, b, b's end), every fingerprint of one with every one of the other."""
    a, a_end, b, b_end = pairs[:4]
    wide = b_end - b
    size = (a_end - a) * wide
    pair = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    i, j = a[pair] + place // wide[pair], b[pair] + place % wide[pair]
    near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
    return i[near], j[near]


def trie_links(fp: np.ndarray, ends: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Components, each its smallest index, of the fingerprints of several groups under links of ``budget`` differing bits.

    ``fp`` holds the groups one behind the other, each sorted and distinct; ``ends`` holds where they end.
    """
    n = len(fp)
    label = np.arange(n)
    zeros = {}  # per bit: how many of the first i fingerprints have it clear
    for most in range(1, budget + 1):
        def mixed() -> np.ndarray:
            return np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))

        change = mixed()  # a node lies in one component where it doesn't change between its ends
        starts = np.concatenate(([0], ends[:-1]))
        big = ends - starts > 1
        root = np.stack([starts[big], ends[big], starts[big], ends[big], np.zeros(int(big.sum()), np.int64)])
        stack = [(63, root)]
        while stack:
            bit, pairs = stack.pop()
            if pairs.shape[1] > PORTION:
                half = pairs.shape[1] // 2
                stack += [(bit, pairs[:, half:]), (bit, pairs[:, :half])]
                continue
            a, a_end, b, b_end, _ = pairs
            one = (label[a] == label[b]) & (change[a_end - 1] == change[a]) & (change[b_end - 1] == change[b])
            pairs = pairs[:, ~one]
            small = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= OUTRIGHT
            i, j = _within(fp, pairs[:, small], most)
            if len(i):
                label = _merged(label, i, j)
                change = mixed()
            pairs = pairs[:, ~small]
            if not pairs.shape[1]:
                continue
            if bit not in zeros:
                zeros[bit] = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit) & np.uint64(1)) == 0)))
            a, a_end, b, b_end, spent = pairs
            a_mid, b_mid = a + zeros[bit][a_end] - zeros[bit][a], b + zeros[bit][b_end] - zeros[bit][b]
            same = a == b  # a node with itself: its two mixed pairs are one
            down = np.concatenate(
                [np.stack([a, a_mid, b, b_mid, spent]), np.stack([a_mid, a_end, b_mid, b_end, spent]), np.stack([a, a_mid, b_mid, b_end, spent + 1]),
                 np.stack([a_mid, a_end, b, b_mid, spent + 1])[:, ~same]], axis=1
            )
            stack.append((bit - 1, down[:, (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= most)]))
    return label


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _group_links(rows: DataFrame, budget: int) -> DataFrame:
    """Links (a, b) of sorted rows (group, fp): of each fingerprint to the first of its component in its group."""

    def found(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
        fp = fp.view(np.uint64)
        start = np.repeat(np.append(0, ends[:-1]), np.diff(ends, prepend=0))
        order = np.lexsort((fp, start))
        fp = fp[order]
        label = trie_links(fp, ends, budget)
        i = np.flatnonzero(label != np.arange(len(fp)))
        return record_batch(arrow(LINKS), [fp[i].view(np.int64), fp[label[i]].view(np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, fps, held = [], [], 0
        for batch in batches:
            group, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "fp"))
            groups.append(group)
            fps.append(fp)
            held += len(fp)
            if held >= BATCH_ROWS and group[0] != group[-1]:  # all but the last group is whole
                g, f = np.concatenate(groups), np.concatenate(fps)
                cut = int(np.flatnonzero(g != g[-1])[-1]) + 1
                yield found(g[:cut], f[:cut])
                groups, fps, held = [g[cut:]], [f[cut:]], len(g) - cut
        if held:
            yield found(np.concatenate(groups), np.concatenate(fps))

    return rows.mapInArrow(run, LINKS)


def linked(fps: DataFrame, budget: int = BUDGET, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """node and component of every fingerprint of ``fps`` (fp, distinct) that links with another."""
    spark = fps.sparkSession
    n = fps.count()
    choices = masks(_blocks(n, budget), budget)
    signed = [F.lit(m - (m >> 63 << 64)) for m in choices]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(m).alias("key")) for i, m in enumerate(signed)]))
    keyed = fps.select("fp", keys.alias("k")).select("fp", F.xxhash64("k.choice", "k.key").alias("group"))
    sizes = keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    large = written(sizes.where(F.col("n") > group_limit), "simhash-large")
    if large.isEmpty():
        rows = keyed
    else:
        parts = F.greatest(F.least(F.ceil(F.col("n") / group_limit), F.lit(MOST_PARTS)), F.ceil(F.col("n") / F.lit(PART_ROWS)), F.lit(2))
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).alias("own")
        few = F.broadcast if large.count() <= MAX_BROADCAST_GROUPS else lambda df: df
        of = keyed.join(few(large.select("group", parts.alias("parts"))), "group").select("group", "fp", "parts", own)
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
        pairs = of.select("group", "fp", "own", other).where("own <> other")
        split = pairs.select("fp", F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("group"))
        rows = keyed.join(few(large.select("group")), "group", "left_anti").select("fp", "group").unionByName(split)
    dealt = rows.select("group", "fp").repartition("group").sortWithinPartitions("group")
    links = written(_group_links(dealt, budget).distinct(), "simhash-links")
    remove(spark, large)
    merged = components(links)
    remove(spark, links)
    return merged


def near_duplicates(docs: DataFrame, width: int = WORDS, budget: int = BUDGET, seed: int = SEED, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Per row doc_id, fp (signed) and component_id."""
    spark = docs.sparkSession
    rows = written(_fingerprinted(docs, width, seed), "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    merged = written(linked(classes.select("fp"), budget, group_limit), "simhash-components")
    placed = classes.join(merged.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    names = written(placed.join(named, "component").select("fp", "component_id"), "simhash-names")
    out = written(rows.join(names, "fp").select("doc_id", "fp", "component_id"), "simhash-result")
    for table in (rows, classes, merged, names):
        remove(spark, table)
    return out


def deduplicate(docs: DataFrame, width: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """``docs`` with one document of each component, the smallest doc_id, in each of its rows; rows without a doc_id stay, all columns stay."""
    found = near_duplicates(docs, width, budget)
    drop = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*columns(docs))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
