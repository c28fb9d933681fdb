"""Importance resampling of documents towards a target text, by hashed n-gram features and bit-sliced weights.

Features of a text are its runs of 1 to ``WIDTH`` words, repeats counted, each in the bucket crc32 modulo ``BUCKETS``. The gain of a bucket is the
log-ratio of its smoothed shares in the target and in the documents, in whole thousandths; the weight of a document is the sum of the
gains of its features.

Weights come from bit-sliced aggregation: the bucket counts of a document are bit planes of ``BUCKETS`` bits (plane j holds bit j of
every count), the gains are planes of their positive and of their negative bits. One AND of a count plane with a gain plane and a popcount gives
how often 2^j * 2^k is to be added, so the sum is exact in integers.

Features are not hashed one by one: crc32 is linear, so the crc of a run of words is that of its first words shifted by the length of
the last one, xor the crc of that one; shifts are four table look-ups per word.

The draw takes the highest scores, weight plus Gumbel noise of the id, without replacement. Rows are sorted by ranges of (score, id); a
rank is the place within a range plus the sizes of the ranges above, so no task sees more than its range. Only the sizes of ranges, and the
``BUCKETS`` totals, reach the driver.

Edge cases: a null text has no words; a text without words has no features and weight 0. An empty target or an empty table has no features either,
and its shares are even. Rows whose doc_id is null have a weight, but a null score and are never drawn. Rows that repeat a doc_id and text tie,
and any of them comes first. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.common import ALNUM_WORDS, arrow, columns, record_batch, remove, slices, text_bytes, written

BUCKETS = 10_000
#: Longest run of words that is a feature.
WIDTH = 3
#: Documents of fewer words are not drawn.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Documents whose planes are met with those of the gains at once; their planes take about 7 MB.
AT_ONCE = 64
#: Rows of one range of the ranking.
RANGE_ROWS = 500_000
#: Longest word, in bytes with its space, that is shifted by tables; of a longer one crc32 reads the bytes again.
TABLE_BYTES = 64


@functools.cache
def _shift_tables() -> np.ndarray:
    """What 0 to ``TABLE_BYTES`` bytes behind it do to a crc32, for each value of each of its four bytes."""
    out = np.empty((TABLE_BYTES + 1, 4, 256), np.uint32)
    for n in range(TABLE_BYTES + 1):
        zeros = bytes(n)
        least = zlib.crc32(zeros)
        out[n] = [[zlib.crc32(zeros, byte << 8 * at) ^ least for byte in range(256)] for at in range(4)]
    return out


def _appended(crc: np.ndarray, word: np.ndarray, length: np.ndarray, tail: np.ndarray, spaced: list[bytes]) -> np.ndarray:
    """crc32 of texts with one more word: from the crc of each text and the index of its word in ``spaced``, words behind a space."""
    n, shift = np.minimum(length[word], TABLE_BYTES), _shift_tables()
    out = shift[n, 0, crc & 255] ^ shift[n, 1, crc >> 8 & 255] ^ shift[n, 2, crc >> 16 & 255] ^ shift[n, 3, crc >> 24] ^ tail[word]
    for i in np.flatnonzero(length[word] > TABLE_BYTES).tolist():
        out[i] = zlib.crc32(spaced[word[i]], int(crc[i]))
    return out


def features(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 texts: the number of words of each, and row and bucket of every feature."""
    known: dict[bytes, int] = {}
    index: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.translate(ALNUM_WORDS).split()
        counts[i] = len(words)
        index += [known.setdefault(w, len(known)) for w in words]
    word = np.array(index, np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    spaced = [b" " + w for w in known]
    length = np.fromiter(map(len, spaced), np.int64, len(spaced))
    tail = np.fromiter(map(zlib.crc32, spaced), np.uint32, len(spaced))
    first = np.fromiter(map(zlib.crc32, known), np.uint32, len(spaced))
    start, crc = np.arange(len(word)), first[word]
    rows, buckets = [row], [crc % np.uint32(BUCKETS)]
    for k in range(1, width):
        go_on = start + k < len(word)
        go_on[go_on] = row[start[go_on] + k] == row[start[go_on]]
        start = start[go_on]
        crc = _appended(crc[go_on], word[start + k], length, tail, spaced)
        rows.append(row[start])
        buckets.append(crc % np.uint32(BUCKETS))
    return counts, np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


def planes(counts: np.ndarray) -> np.ndarray:
    """Bit planes of rows of ``BUCKETS`` counts: [row, bit, 64-bit word of buckets]."""
    bits = max(1, int(counts.max(initial=0)).bit_length())
    sliced = (counts[:, None, :] >> np.arange(bits)[None, :, None] & 1).astype(bool)
    packed = np.packbits(sliced, axis=-1, bitorder="little")
    spare = -packed.shape[-1] % 8
    return np.pad(packed, ((0, 0), (0, 0), (0, spare))).view(np.uint64)


def gain_planes(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of the bits of positive and of negative gains, and the signed power of two that each stands for."""
    up, down = (planes(np.maximum(sign * gains, 0)[None])[0] for sign in (1, -1))
    value = [sign << k for sign, p in ((1, up), (-1, down)) for k in range(len(p))]
    return np.concatenate([up, down]), np.array(value, np.int64)


def weigh(counts: np.ndarray, gain: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Exact sums of counts times gains, for rows of ``BUCKETS`` counts."""
    total = np.zeros(len(counts), np.int64)
    sliced = planes(counts)
    for j in range(sliced.shape[1]):
        row = np.flatnonzero(sliced[:, j].any(axis=1))
        hits = np.bitwise_count(sliced[row, j, None, :] & gain[None]).sum(axis=-1, dtype=np.int64)
        total[row] += (hits @ value) << j
    return total


TOTALS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])


def _totals(table: DataFrame, width: int) -> np.ndarray:
    """How often each bucket occurs in a table; every task adds up its rows, and ``BUCKETS`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "text", 4 << 20):
            total += np.bincount(features(batch.column("text").to_pylist(), width)[2], minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield record_batch(arrow(TOTALS), [there, total[there]])

    out = np.zeros(BUCKETS, np.int64)
    for r in table.select(text_bytes().alias("text")).mapInArrow(run, TOTALS).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket from the numbers of its features in the documents and in the target."""
    all_s, all_t = int(documents.sum()), int(target.sum())
    share = ((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)) for s, t in zip(documents.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in share], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    """Gumbel noise of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


WEIGHTS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])


def weights(docs: DataFrame, target: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of ``docs`` towards the texts of ``target``."""
    gain, value = gain_planes(bucket_gains(_totals(docs, width), _totals(target, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(WEIGHTS)
        for batch in slices(batches, "text", 4 << 20):
            words, row, bucket = features(batch.column("text").to_pylist(), width)
            found = np.zeros(len(words), np.int64)
            order = np.argsort(row, kind="stable")
            row, bucket = row[order], bucket[order]
            for first in range(0, len(words), AT_ONCE):
                n = min(AT_ONCE, len(words) - first)
                a, b = np.searchsorted(row, (first, first + n))
                counts = np.bincount((row[a:b] - first) * BUCKETS + bucket[a:b], minlength=n * BUCKETS).reshape(n, BUCKETS)
                found[first : first + n] = weigh(counts, gain, value)
            ids = batch.column("doc_id").to_pylist()
            score = [None if i is None else w + noise(i, seed) for i, w in zip(ids, found.tolist(), strict=True)]
            yield record_batch(schema, [batch.column("doc_id"), words, np.bincount(row, minlength=len(words)), found, score])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, WEIGHTS)


def ranked(scored: DataFrame, draw: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``scored`` with ``rank`` from 1 for the ``draw`` highest scores, ties to the smaller doc_id, else null."""
    n = scored.count()
    order = [F.col("score").desc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    ranges = scored.repartitionByRange(-(-n // range_rows) or 1, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the number of the range in its upper bits, the place in it in the lower 33
    placed = written(ranges.withColumn("range", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND((1 << 33) - 1)), "resampling-ranges")
    sizes = sorted(map(tuple, placed.groupBy("range").count().collect()))
    above = itertools.accumulate((k for _, k in sizes), initial=0)
    before = scored.sparkSession.createDataFrame(list(zip((r for r, _ in sizes), above, strict=False)), "range bigint, above bigint")
    rank = F.col("above") + F.col("place") + 1
    return placed.join(F.broadcast(before), "range").select(*scored.columns, F.when(rank <= draw, rank).cast("long").alias("rank"))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight and score, and its rank where it is drawn.

    ``percent`` of the rows with an id and ``least_words`` words or more are drawn, rounded down.
    """
    spark = docs.sparkSession
    scored = written(weights(docs, target, seed=seed), "resampling-weights")
    fit = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    n = scored.where(fit).count()
    drawn = ranked(scored.where(fit), percent * n // 100)
    out = written(drawn.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))), "resampling-drawn")
    remove(spark, scored)
    remove(spark, drawn)
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns. Of rows that repeat a doc_id, one drawn takes the others with it."""
    wanted = draw(docs, target, percent, seed=seed).where("rank is not null").select("doc_id").distinct()
    return docs.join(wanted, "doc_id", "left_semi").select(*columns(docs))


def query(docs: DataFrame, target: DataFrame) -> DataFrame:
    return draw(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 byte by byte over a table of 256 steps that the first part makes from the polynomial.
SQL = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda c, b: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM (SELECT unnest(range(256)) AS i))),
texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
w AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
p AS (SELECT side, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)),
g AS (SELECT side, doc_id, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS n FROM p GROUP BY ALL),
h AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(g))), lambda j: ('0x' || hex(encode(g))[2 * j + 1:2 * j + 2])::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM (SELECT DISTINCT g FROM g), crc),
f AS (SELECT side, doc_id, b, sum(n)::BIGINT AS n FROM g JOIN h USING (g) GROUP BY ALL),
b AS (SELECT b, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 't'), 0)::BIGINT AS t FROM f GROUP BY b),
a AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM b),
gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM b, a),
x AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN gain USING (b) WHERE side = 'd' GROUP BY doc_id),
y AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || w.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN x USING (doc_id) WHERE w.side = 'd'),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS rank, count(*) FILTER (n_words >= 20) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND rank <= 5 * n // 100 THEN rank END AS rank FROM r
"""
