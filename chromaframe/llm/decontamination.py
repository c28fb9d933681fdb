"""Benchmark decontamination: n-gram windows of test items, looked up in every training text.

The windows of the items (``n`` consecutive words; a shorter item is one window) form a hash set that is broadcast after its
size has been checked. Each text is scanned once: words become item-vocabulary numbers, a rolling hash proposes windows, and the
exact window is compared before a hit counts. Beyond ``MAX_BROADCAST_WINDOWS`` the same windows are joined by a shuffle.

Edge cases: a null or empty text has no words and no hits. Items without words are ignored; items whose ``item_id`` is null still
mark words but are not listed. Repeated items count once per ``item_id``. Repeated documents are reported once per row. Other
columns of either table are neither read nor altered.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.common import ALNUM_WORDS, arrow, ascii_lower, columns, slices, text_bytes, whole_rows, written

#: A window takes at most about 300 bytes on the driver and in each worker, so the set stays under about 60 MB.
MAX_BROADCAST_WINDOWS = 200_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_column(name: str = "text") -> F.Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(F.col(name), F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, n: int = 10) -> DataFrame:
    """``window`` (array of words) and ``item_id``, each pair once."""
    words = items.select("item_id", words_column().alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(n)))).alias("window")).distinct()


class _Matcher:
    """The windows as arrays of word numbers by length, with their rolling hashes."""

    def __init__(self, windows: list[tuple[list[str], int | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for words, item in windows:
            key = tuple(self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1) for w in words)
            self.items[key].update(() if item is None else (item,))
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for key in self.items:
            by_length[len(key)].append(key)
        self.hashes = {n: np.unique(self._rolled(np.array(keys, np.uint64))) for n, keys in by_length.items()}

    @staticmethod
    def _rolled(windows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(windows), np.uint64)
        for k in range(windows.shape[1]):
            out = out * _BASE + windows[:, k]
        return out

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word spans [start, end) inside occurrences, and the items that occur."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        spans, found = [], set()
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            rolled = self._rolled(np.lib.stride_tricks.sliding_window_view(ids, n)[at])
            for i in at[hashes[np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)] == rolled].tolist():
                if (items := self.items.get(tuple(ids[i : i + n].tolist()))) is not None:
                    spans.append((i, i + n))
                    found |= items
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, found


REPORT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("item_ids", T.ArrayType(T.LongType())),
    ]
)


def _too_many(windows: DataFrame, bound: int) -> bool:
    return windows.limit(bound + 1).count() > bound


def _broadcast_matcher(docs: DataFrame, windows: DataFrame):
    rows = [(r.window, r.item_id) for r in windows.collect()]  # at most the checked bound
    return docs.sparkSession.sparkContext.broadcast(_Matcher(rows))


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, max_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): words, merged word spans inside item windows, and the items found."""
    windows = item_windows(items, n).cache()
    try:
        if _too_many(windows, max_windows):
            return _contamination_by_join(docs, item_windows(items, n))
        matcher = _broadcast_matcher(docs, windows)
    finally:
        windows.unpersist()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher.value.find
        schema = arrow(REPORT)
        for batch in slices(batches, "text"):
            counts, spans, found = [], [], []
            for text in batch.column("text").to_pylist():
                words = text.translate(ALNUM_WORDS).split()
                at, ids = find(words)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in at])
                found.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, schema.field(k).type) for k, x in ((1, counts), (2, spans), (3, found)))], schema=schema
            )

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(scan, REPORT)


def _contamination_by_join(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same report for item sets of any size: windows of the texts meet those of the items in a shuffled join.

    A window leaves its text as a row of its own, and spans are merged by a window over the hits of a text, which spills; no task holds all windows or
    all hits of a long text.
    """
    lengths = [r[0] for r in windows.select(F.size("window")).distinct().collect()]  # at most n numbers
    rows = docs.select(F.col("doc_id").cast("long"), words_column().alias("w")).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "decontam-words")  # row numbers must not change between the two reads
    none = [F.expr(f"cast(array() as {REPORT[c].dataType.simpleString()})").alias(c) for c in ("spans", "item_ids")]
    if not lengths:
        return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), *none)
    keyed = windows.groupBy(F.sha2(F.array_join("window", " "), 256).alias("key")).agg(F.collect_set("item_id").alias("ids"))
    each = rows.select("row", "w", F.explode(F.array(*map(F.lit, sorted(lengths)))).alias("k")).where(F.size("w") >= F.col("k"))
    starts = each.select("row", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i"))
    cand = starts.select("row", (F.col("i") - 1).cast("long").alias("start"), (F.col("i") - 1 + F.col("k")).cast("long").alias("end"), F.sha2(F.array_join(F.slice("w", F.col("i"), F.col("k")), " "), 256).alias("key"))
    hits = written(cand.join(keyed, "key").select("row", "start", "end", "ids"), "decontam-hits")
    along = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))  # how far the hits before this one go
    apart = hits.select("row", "start", "end").distinct().withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    island = F.sum("new").over(along).alias("island")
    spans = apart.select("row", "start", "end", island).groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    found = hits.select("row", F.explode("ids").alias("id")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("id")).alias("item_ids"))
    joined = rows.join(spans, "row", "left").join(found, "row", "left")
    return joined.select("doc_id", F.size("w").cast("long").alias("n_words"), *[F.coalesce(c, e).alias(c) for c, e in zip(("spans", "item_ids"), none, strict=True)])


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, remove: str = "documents", max_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the contaminated words cut out of the text.

    All columns of ``docs`` stay; with ``spans``, an ``n_chars`` column follows the new text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    windows = item_windows(items, n).cache()
    try:
        if _too_many(windows, max_windows):
            return _decontaminate_by_join(docs, item_windows(items, n), remove)
        matcher = _broadcast_matcher(docs, windows)
    finally:
        windows.unpersist()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher.value.find
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            spans = [find((t or "").encode().translate(ALNUM_WORDS).split())[0] for t in texts]
            if remove == "documents":
                yield batch.filter(pa.array([not s for s in spans], pa.bool_()))
                continue
            yield _with_cuts(batch, texts, spans)

    return whole_rows(docs, clean)


def _decontaminate_by_join(docs: DataFrame, windows: DataFrame, remove: str) -> DataFrame:
    """The same rows for item sets of any size; rows are told apart by number, as ids may be null or repeated, and carried whole, whatever their columns."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns(docs)).alias("all")), "decontam-rows")  # numbers must not change between the two reads
    report = _contamination_by_join(rows.select(F.col("row").alias("doc_id"), F.col("all.text").alias("text")), windows)
    hit = report.where(F.size("spans") > 0).select(F.col("doc_id").alias("row"), "spans")
    if remove == "documents":
        return rows.join(hit, "row", "left_anti").select(*columns(docs, "all"))
    schema = T.StructType([rows.schema["all"]])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(x["start"], x["end"]) for x in s or []] for s in batch.column("spans").to_pylist()]
            whole = pa.RecordBatch.from_struct_array(batch.column("all"))
            cut = _with_cuts(whole, whole.column("text").to_pylist(), spans)
            yield pa.RecordBatch.from_arrays([cut.to_struct_array()], schema=arrow(schema))

    return rows.join(hit, "row", "left").select("all", "spans").mapInArrow(clean, schema).select(*columns(docs, "all"))


def _with_cuts(batch: pa.RecordBatch, texts: list, spans: list) -> pa.RecordBatch:
    """``batch`` with the spans cut out of its texts, and ``n_chars`` of the new ones."""
    new = [_cut(t.encode(), s).decode() if s else t for t, s in zip(texts, spans, strict=True)]
    columns = dict(zip(batch.schema.names, batch.columns, strict=True))
    columns["text"] = pa.array(new, columns["text"].type)
    if "n_chars" in columns:
        columns["n_chars"] = pa.array([None if t is None else len(t) for t in new]).cast(columns["n_chars"].type)
    return pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at = [m.span() for m in _RAW_WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return contamination(docs, items).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


#: Windows of 10 words (an item of fewer is one window) joined to the words of the texts.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
             FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN f ON d.doc_id = f.doc_id
"""
