"""Periodic runs of words: stretches that repeat themselves word by word, found by a sparse diagonal table.

A run is a stretch with smallest period q of at least ``TIMES`` periods and ``LEAST`` words that no neighbouring word extends. Two equal words q apart
are a cell of diagonal q; a run is a diagonal of length - q cells in a row.

The table is online: going through the words, an earlier occurrence of a word enters its lag, each further word that matches at an active lag makes
it one longer, and a lag that ends emits its run if it is long enough. It is kept sparse, also for a text of one word alone, by what runs are:

- A run of period q has at least max(LEAST - q, (TIMES - 1) * q) cells in a row, 16 at least. So a cell is entered only where the k words from it on
  stand k words long at the earlier place too, k = 16 for q up to 16, else the power of two from q on.
- Of these occurrences only the nearest can be on a run's diagonal: with k >= q, a nearer one inside the run would give it a smaller period
  (theorem of Fine and Wilf). So each k has one active lag at a time, and a text of n words at most n cells for each of log2(n) lengths k.

Occurrences are told by names of stretches of k words, equal for equal stretches: the names of 2k words are the pairs of names of k words. A text in
which no 16 words come again, nearly every one, is passed over by hashes; a text with a hit is worked out exactly.

Edge cases: a null or empty text has no words and no runs; its two digests are those of nothing. A null doc_id alters nothing in its text. Rows that repeat
a doc_id are each worked out. Other columns are not read; ``collapse`` keeps them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.bpe import _Aged
from chromaframe.llm.common import arrow, columns, record_batch, slices, text_bytes

#: Words a run has at least, and how many times its period.
LEAST, TIMES = 24, 3
#: Words from which on a cell is entered at the shortest; every run has so many cells in a row.
SEED_WORDS = 16

_SPACES = bytes(0x20 if c == 0x20 or 0x09 <= c <= 0x0D else c for c in range(256))
_hashes = _Aged(xxhash.xxh64_intdigest, 200_000)


def cut(text: bytes) -> list[bytes]:
    """Words of a text; their case is kept."""
    return text.translate(_SPACES).split()


def altered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document, of which one in ten is made periodic from some word on."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _names(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, return_inverse=True)[1]


def _nearest(names: np.ndarray) -> np.ndarray:
    """How far back each name stands last; 0 where it is new."""
    order = np.argsort(names, kind="stable")
    out = np.zeros(len(names), np.int64)
    again = names[order[1:]] == names[order[:-1]]
    out[order[1:][again]] = (order[1:] - order[:-1])[again]
    return out


def _emitted(lag: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, length, period) of the lags of one length k, each a diagonal that is active from where the lag appears to where it changes."""
    ends = np.flatnonzero(np.diff(lag, prepend=-1, append=-1))
    first, stop = ends[:-1], ends[1:]
    q = lag[first]
    length = stop - first + k - 1 + q
    good = (q > 0) & (length >= np.maximum(LEAST, TIMES * q))
    yield from zip((first - q)[good].tolist(), length[good].tolist(), q[good].tolist(), strict=True)


def runs(words: list) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, by start, then period."""
    n, known = len(words), {}
    names = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    found, k = [], 1
    while k <= SEED_WORDS or TIMES * (k // 2 + 1) <= n:  # lags of the next k start behind half of it
        if k >= SEED_WORDS:
            lag = _nearest(names)
            if not lag.any():
                break  # longer stretches don't come again either
            lag[(lag > k) | (lag <= (k // 2 if k > SEED_WORDS else 0))] = 0
            found += _emitted(lag, k)
        if len(names) <= k:
            break
        names = _names(names[:-k] * (names.max() + 1) + names[k:])
        k *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def suspects(docs: list[list[bytes]]) -> np.ndarray:
    """Indices of the documents in which ``SEED_WORDS`` words in a row come again, by hashes; now and then one in which none do."""
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    doc = np.repeat(np.arange(len(docs)), size)
    h = np.fromiter((_hashes[w] for words in docs for w in words), np.uint64, len(doc))
    k = 1
    while k < SEED_WORDS and len(h) > k:
        h = (h[:-k] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[k:] + np.uint64(0xD6E8FEB86659FD93))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        k *= 2
    if k < SEED_WORDS:
        return np.zeros(0, np.int64)
    whole = doc[: len(h)] == doc[k - 1 :]
    h, doc = h[whole] ^ (doc[: len(h)][whole].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), doc[: len(h)][whole]
    ordered = np.sort(h)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return np.unique(doc[np.isin(h, again)]) if len(again) else np.zeros(0, np.int64)


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def greatest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length for its period; of those that tie, the first, then the shorter period."""
    best = None
    for run in found:  # in that order
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


REPORT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")]
)


def report(docs: DataFrame, alter: bool = False) -> DataFrame:
    """Per row the number of runs, the greatest of them, and digests of all runs and of the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(REPORT)
        for batch in slices(batches, "text", 4 << 20):
            ids = batch.column("doc_id").to_pylist()
            texts = [cut(t) for t in batch.column("text").to_pylist()]
            if alter:
                texts = [altered(words, i) for words, i in zip(texts, ids, strict=True)]
            found = {i: runs(texts[i]) for i in suspects(texts).tolist()}
            rows = []
            for i, words in enumerate(texts):
                own = found.get(i, [])
                best = greatest(own)
                if own:
                    words = [words[j] for j in np.flatnonzero(kept(len(words), own)).tolist()]
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in own)
                rows.append((ids[i], len(own), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(), sha256(b" ".join(words)).hexdigest()))
            yield record_batch(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(schema))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, REPORT)


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with each run cut to its first period; a text with a run has its kept words joined by one space, other texts stay as they are."""
    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields)), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            words = [cut((t or "").encode()) for t in texts]
            for i in suspects(words).tolist():
                own = runs(words[i])
                if own:
                    texts[i] = b" ".join(words[i][j] for j in np.flatnonzero(kept(len(words[i]), own)).tolist()).decode()
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, batch.schema.field("text").type)], schema=batch.schema)

    one = docs.select(F.struct(*columns(docs)).alias("row"), F.col("text").alias("text"))
    out = one.mapInArrow(run, schema)
    return out.select(*[F.col("text") if c == "text" else own for c, own in zip(docs.columns, columns(docs, "row"), strict=True)])


def query(docs: DataFrame) -> DataFrame:
    return report(docs, alter=True)


#: Candidate lags of a document are the distances of equal stretches of 16 words; of each, stretches without a mismatch are runs where no run of
#: a smaller period holds them. crc32 is computed bit by bit.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
      xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(doc_id::VARCHAR)), lambda j: ascii((doc_id::VARCHAR)[j + 1])::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, e: xor(d >> 1, (d & 1) * 3988292384))), 4294967295) AS h FROM documents),
m AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, h // 10 % 8 + 3 AS d FROM w),
t AS (SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // d) END]) ELSE w END AS w FROM m),
s AS (SELECT doc_id, n, w, i, hash(w[i + 1:i + 16]) AS k FROM (SELECT doc_id, n, w, unnest(range(0, n - 15)) AS i FROM t)),
c AS (SELECT DISTINCT x.doc_id, y.i - x.i AS q FROM (SELECT doc_id, i, k, n FROM s) x JOIN (SELECT doc_id, i, k FROM s) y
      ON x.doc_id = y.doc_id AND x.k = y.k AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
e AS (SELECT doc_id, q, n, i, w[i + 1] = w[i + 1 - q] AS same FROM (SELECT t.doc_id, q, n, w, unnest(range(q, n)) AS i FROM t JOIN c USING (doc_id))),
z AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e WHERE same),
r AS (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length FROM z GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
u AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.start <= r.start AND o.start + o.length >= r.start + r.length)),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines,
      min_by({s: start, l: length, q: q}, {x: -length::DOUBLE / q, y: start, z: q}) AS best, list(start + q) AS drop_from, list(start + length) AS drop_to FROM u GROUP BY doc_id),
x AS (SELECT doc_id, len(list_filter(list_zip(drop_from, drop_to), lambda p: i >= p[1] AND i < p[2])) = 0 AS kept, i, word
      FROM (SELECT doc_id, drop_from, drop_to, unnest(range(0, n)) AS i, unnest(w) AS word FROM t JOIN b USING (doc_id))),
y AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) FILTER (kept) AS words FROM x GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, array_to_string(w, ' '))) AS collapsed_sha256
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN y USING (doc_id)
"""
