"""Quality classifier: histogram gradient-boosted trees over document statistics.

Of the labels that may be learned from, at most ``MAX_TRAIN`` are taken in the order of a hash of doc_id (the one bounded sample here);
the statistics of their texts go to the driver, where the trees are fitted. Trees are complete and flattened into arrays, so
scoring is a few numpy look-ups per level for a whole batch. Then every text is read once: its statistics are computed and scored in the
same pass. labels, lang, source and doc_id are never inputs of a score.

Edge cases: null text counts as empty and is scored. Labels that are null, or whose doc_id is null or unknown, are ignored;
repeated labels of a doc_id count once each, and once per row where the doc_id repeats. Without usable labels, or with one class only, every score is that class's share
(0.5 without any). Repeated documents get equal scores. Other columns are kept by ``filter_quality`` and not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.common import SPACE_WORDS, arrow, crc_remainder, record_batch, slices, text_bytes, whole_rows, written

MAX_TRAIN = 40_000
THRESHOLD = 0.3
HELD_OUT_MOD = 5

_CLASS = np.zeros((256, 6), bool)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (_c.isascii() and _c.isupper(), _c.isascii() and _c.islower(), _c.isascii() and _c.isdigit(), _b >= 0x80, _c in " \t\r\n\v\f", _c in ".,;:'\"?-")
_SYMBOL = ~_CLASS.any(axis=1)


def statistics(raw: bytes) -> list[float]:
    """Numbers about one text, all finite."""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    per_class = (counts @ _CLASS) / n
    words = raw.translate(SPACE_WORDS).split()
    k = max(1, len(words))
    tally = Counter(words)
    top = max(tally.values(), default=0)
    lengths = np.array(list(map(len, words)), np.float64) if words else np.zeros(1)
    cased = raw.split()
    lines = raw.split(b"\n")
    line_tally = Counter(lines)
    repeats = sum(map(bytes.__eq__, words[1:], words))
    capitals = sum(map(bytes.isupper, cased))
    titles = sum(map(bytes.istitle, cased))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), *per_class.tolist(), float(counts[_SYMBOL].sum() / n),
        counts[ord("!")] / n, counts[ord("|")] / n, counts[ord("#")] / n, counts[ord(".")] / k, counts[ord(",")] / k,
        float(lengths.mean()), float(lengths.std()), float((lengths <= 3).sum() / k), float((lengths >= 15).sum() / k), len(tally) / k, top / k, repeats / k,
        capitals / k, titles / k, len(lines) / k, 1 - len(line_tally) / len(lines), max(line_tally.values()) / len(lines), np.log1p(max(map(len, lines))),
    ]


N_FEATURES = len(statistics(b""))


@dataclass
class Trees:
    """Complete trees of one depth: per tree and inner node a feature and threshold, per leaf a value."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for the log loss, grown level by level from histograms of binned features."""
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else min(max(float(y[0]), 1e-3), 1 - 1e-3)
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best = np.full(wide, 1e-6)
            split = np.full((wide, 2), -1)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = (node - first) * bins + binned[:, j]
                gs = np.bincount(key, g, wide * bins).reshape(wide, bins).cumsum(axis=1)
                hs = np.bincount(key, h, wide * bins).reshape(wide, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(e) :] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(wide), at] > best
                best[better] = gain[np.arange(wide), at][better]
                split[better] = np.stack((np.full(wide, j), at), axis=1)[better]
            for k, (j, b) in enumerate(split.tolist()):
                if j >= 0:
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


STATISTICS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.DoubleType()), T.StructField("x", T.ArrayType(T.FloatType()))])


def _statistics(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float32).reshape(-1, N_FEATURES)


def training_labels(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Labels (doc_id, y) of rows of ``docs`` whose crc32 of doc_id is not 0 modulo ``HELD_OUT_MOD``: the first ``max_train`` by hash."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).dropna()
    usable = usable.where(crc_remainder("doc_id", HELD_OUT_MOD) != 0).withColumn("h", F.xxhash64("doc_id"))
    usable = written(usable.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"), "quality-labels")
    n = usable.count()
    if n > max_train:  # a bound on the hash leaves little more than is taken, so no task sorts more than that
        bound = -(2**63) + int(2**64 * min(1.0, 1.1 * max_train / n + 100 / n))
        usable = usable.where(F.col("h") < F.lit(min(bound, 2**63 - 1)))
    return usable.orderBy("h", "doc_id", "y").limit(max_train).select("doc_id", "y")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Trees from the texts of at most ``max_train`` labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(STATISTICS)
        for batch in slices(batches, "text"):
            x = _statistics(batch.column("text").to_pylist()).ravel()
            lists = pa.ListArray.from_arrays(np.arange(0, len(x) + 1, N_FEATURES, dtype=np.int32), pa.array(x))
            yield record_batch(schema, [batch.column("doc_id"), batch.column("y"), lists.cast(schema.field(2).type)])

    chosen = F.broadcast(training_labels(docs, labels, max_train))  # max_train rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(chosen, "doc_id").select("doc_id", "y", "text")
    # of rows that repeat a doc_id, one: a row a label at most, about 12 MB at 40,000
    rows = texts.mapInArrow(run, STATISTICS).groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, N_FEATURES)
    y = np.array(rows.column("y").to_pylist(), np.float64)
    order = np.lexsort((*x.T, y))  # the same trees in whatever order the rows came
    return fit(x[order], y[order])


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id and score of every row."""
    trees = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB by its depth and number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(SCORED)
        for batch in slices(batches, "text"):
            x = _statistics(batch.column("text").to_pylist()).astype(np.float64)
            yield record_batch(schema, [batch.column("doc_id"), trees.value.score(x)])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, SCORED)


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """``docs`` without the rows scored under ``threshold``; all columns stay."""
    trees = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_train))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = _statistics([(t or "").encode() for t in batch.column("text").to_pylist()]).astype(np.float64)
            yield batch.filter(pa.array(trees.value.score(x) >= threshold))

    return whole_rows(docs, keep)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(crc_remainder("doc_id", HELD_OUT_MOD) == 0, F.lit(False))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
