"""Exact deduplication with streaming state on disk; DataFrame and SQL functions only.

Every text is reduced to its SHA-256. A structured stream reads (digest, doc_id, locator) and keeps, without expiry, one state row
per digest in the RocksDB state store: how many rows, and the row that stays (largest doc_id) with the locator of its content (file
and row in it). The state lives in the shared folder, so later runs with the same ``state`` path go on from it; the
digests of all rows lie beside it. Rows whose digest was seen more than once are hits: their full bytes are compared with the bytes of the row that stays, which are read by its
locator where an earlier run kept it. Should bytes ever differ under one digest, those digests are grouped again by the text itself,
among the rows of this run and the one kept before.

Hot groups: state updates are summed before the shuffle; full texts of hits meet the row that stays in sort-merge joins, whose
large partitions adaptive execution splits.

Edge cases: a null text counts as empty, and equals an empty one. Of rows with equal text the largest doc_id stays, null ids being
smallest; of rows that tie in that, the largest locator. With a ``state`` of earlier runs, groups count their rows too, and a row stays
only where no earlier one of its text had a larger doc_id. An empty table gives an empty result. Other columns are not read, whatever their
names and types, those of locators included; ``deduplicate`` keeps them all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from chromaframe.llm.common import columns, new_path, written

#: State on disk, and a bound for what all state partitions of an executor hold in memory.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every state partition reserves megabytes it never fills
}


def _place() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def _whole(docs: DataFrame) -> Column:
    return F.struct(*columns(docs)).alias("row")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _reads_files(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` is a row of a file of its own: nothing but columns chosen and rows left out since it was read."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation" and not any(c.lower() == "_metadata" for c in docs.columns)


#: Name of tables that hold rows whole, in a column ``row``.
OWN = "dedup-docs"


def located(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole in ``row``, with the file and place that they were read from; what was not read from files is first written.

    Columns of ``docs`` are never taken for locators, whatever their names.
    """
    if _reads_files(docs):
        try:
            return docs.select(_whole(docs), *_place())
        except AnalysisException:  # a table that isn't files
            pass
    return written(docs.select(_whole(docs)), OWN).select("row", *_place())


def _stream_state(spark: SparkSession, rows: DataFrame, path: str, state: str) -> DataFrame:
    """Run the keyed state over the files of ``rows`` at ``path``; the latest state row of each digest in them."""
    out = new_path(spark, "dedup-state-rows")
    keyed = (
        spark.readStream.schema(T.StructType([*rows.schema.fields, T.StructField("run", T.StringType())]))
        .parquet(path)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(_order()).alias("keep"))
    )
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        query = (
            keyed.writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    wanted = "digest binary, group_size bigint, keep struct<order:bigint,doc_id:bigint,_file:string,_row:bigint>, batch int"
    if query.lastProgress is None or not any(p["numInputRows"] for p in query.recentProgress):
        return spark.createDataFrame([], wanted)
    updates = spark.read.schema(wanted).parquet(out)
    if len(query.recentProgress) > 1:  # a digest's last update is its state
        updates = updates.groupBy("digest").agg(F.max_by(F.struct("group_size", "keep"), "batch").alias("s")).select("digest", "s.*")
    return updates


def _order() -> Column:
    return F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("order"), "doc_id", "_file", "_row")


def decisions(docs: DataFrame, state: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row of ``docs`` with its group: doc_id, _file, _row, digest, keep_id, group_size, kept."""
    return _decisions(located(docs), state, digest)


def _decisions(placed: DataFrame, state: str | None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    spark = placed.sparkSession
    full = placed.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"), "_file", "_row")
    full = full.withColumn("digest", digest(F.col("text")))
    slim = full.drop("text")
    at = (state or new_path(spark, "dedup-state")).rstrip("/")
    path = f"{at}-rows"  # every run of a state adds its rows to what the stream has read
    one = f"{path}/run={uuid.uuid4().hex}"
    slim.write.option("compression", "zstd").parquet(one)
    rows = spark.read.schema(slim.schema).parquet(one)
    kept = _stream_state(spark, rows, path, at)
    result = _decided(rows, kept, "digest")

    # full bytes of every hit against the bytes of the row that stays
    hits = written(full.join(kept.where("group_size > 1").select("digest", "keep"), "digest"), "dedup-hits")
    stays = hits.where(_is_kept())
    earlier = _kept_before(hits, stays) if state else None
    if earlier is not None:
        stays = stays.unionByName(earlier)
    differ = hits.join(stays.select("digest", F.col("text").alias("kept_text")), "digest").where("text <> kept_text").select("digest").distinct()
    if differ.isEmpty():
        return result
    differ = written(differ, "dedup-collisions")
    clashing = hits.join(differ, "digest", "left_semi").drop("keep")
    every = clashing if earlier is None else clashing.unionByName(earlier.join(differ, "digest", "left_semi").drop("keep"))
    by_text = every.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("group_size"), F.max(_order()).alias("keep"))
    return result.join(differ, "digest", "left_anti").unionByName(_decided(clashing, by_text, "digest", "text"))


def _kept_before(hits: DataFrame, stays: DataFrame) -> DataFrame | None:
    """The rows that an earlier run kept and hits of this one equal by digest, read from their files; None without any."""
    lost = hits.join(stays.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("keep").alias("keep"))
    lost = written(lost, "dedup-earlier")
    files = [unquote(r[0]) for r in lost.select("keep._file").distinct().collect()]  # names of files, not rows
    if not files:
        return None
    own = [f for f in files if f"/{OWN}-" in f]
    read = [(F.col("text"), [f for f in files if f not in own]), (F.col("row.text"), own)]
    some = [hits.sparkSession.read.parquet(*there).select(F.coalesce(text, F.lit("")).alias("text"), *_place()) for text, there in read if there]
    texts = reduce(DataFrame.unionByName, some)
    found = lost.join(texts, (F.col("keep._file") == F.col("_file")) & (F.col("keep._row") == F.col("_row")))
    return written(found.select("digest", F.col("keep.doc_id").alias("doc_id"), "text", "_file", "_row", "keep"), "dedup-earlier-texts")


def _is_kept() -> Column:
    return (F.col("_file") == F.col("keep._file")) & (F.col("_row") == F.col("keep._row"))


def _decided(rows: DataFrame, kept: DataFrame, *keys: str) -> DataFrame:
    return rows.join(kept.select(*keys, "group_size", "keep"), [*keys]).select(
        "doc_id", "_file", "_row", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", _is_kept().alias("kept")
    )


def deduplicate(docs: DataFrame, state: str | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay."""
    placed = located(docs)
    dropped = _decisions(placed, state).where("not kept").select("_file", "_row")
    return placed.join(dropped, ["_file", "_row"], "left_anti").select(*columns(docs, "row"))


def query(docs: DataFrame) -> DataFrame:
    return decisions(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
