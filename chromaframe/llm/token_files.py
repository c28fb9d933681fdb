"""Token ids as word-aligned Simple-8b blocks.

Format, version 1. A dataset is a folder of Parquet files; a row is one block of whole documents: ``shard`` and ``first``, the ids
of the shard before it (their order is the order of the documents), ``doc_ids``, ``lengths`` (ids per document), ``word_offsets`` (first 64-bit word of each part
of ``PART`` ids, so parts decode on their own) and ``words``, little-endian 64-bit. A word's top 4 bits are
its selector; selector s >= 1 holds COUNTS[s] ids of BITS[s] bits, the first id lowest, and may be filled up with zeros at a
block's end. Selector 0 is the escape: the next word is one id of up to 64 bits as it is. A block starts a new word.

Documents are dealt to shards by ranges of doc_id, so ascending order needs no global sort; rows of one doc_id (and null ids,
which come first) are ordered by their text. Edge cases: null and empty texts hold only the end id. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.bpe import encoder
from chromaframe.llm.common import arrow, new_path, record_batch, slices

#: Fixed values of the format: ids per word and bits per id, by selector; selector 0 escapes.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

PART = 1 << 16
BLOCK_IDS = 1 << 17
END_ID = 2
#: Chunks that a worker keeps, about 350 MB: nothing else runs beside this operator's tasks.
KEPT_CHUNKS = 1_400_000


#: Bits of every number under 2^16; a word has no more than ``COUNTS[1]`` ids.
_WIDTHS = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
_AHEAD = 64


def _width(ids: np.ndarray) -> np.ndarray:
    """Bits of every id."""
    out = np.zeros(len(ids), np.uint8)
    for shift in range(0, 64, 16):
        above = ids >> np.uint64(shift)
        if shift and not above.any():
            break
        bits = _WIDTHS[(above & np.uint64(0xFFFF)).astype(np.uint16)]
        out = np.where(bits > 0, bits + np.uint8(shift), out) if shift else bits
    return out


def _later(a: np.ndarray, by: int) -> np.ndarray:
    """``a`` moved forward by ``by`` places; zeros follow its end."""
    return np.concatenate((a[by:], np.zeros(min(by, len(a)), a.dtype)))


def _starts(step: np.ndarray) -> np.ndarray:
    """Where words start if one that starts at i is followed by one at i + step[i]: pointers are doubled to ``_AHEAD`` words ahead."""
    n = len(step)
    to = np.append(np.minimum(np.arange(n) + step, n), n).astype(np.int32)
    far = to
    for _ in range(_AHEAD.bit_length() - 1):
        far = far.take(far)
    every, i = [], 0
    while i < n:
        every.append(i)
        i = int(far[i])
    at = np.empty((_AHEAD, len(every)), np.int32)
    at[0] = every
    for j in range(1, _AHEAD):
        at[j] = to.take(at[j - 1])
    at = at.T.ravel()
    return at[at < n]


def encode(ids: np.ndarray) -> np.ndarray:
    """Ids (unsigned, up to 64 bits) as words: each word takes as many of the next ids as fit."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    # widest id among the next 2^k, to choose for every start the selector with most ids
    spans = [_width(ids)]
    while 1 << len(spans) <= COUNTS[1]:
        spans.append(np.maximum(spans[-1], _later(spans[-1], 1 << (len(spans) - 1))))
    # where a selector fits all later ones do, so the first that fits is told by how many do; none: 0, the escape
    fits = np.zeros(n, np.uint8)
    for s in range(1, len(COUNTS)):
        k = int(COUNTS[s]).bit_length() - 1
        rest = int(COUNTS[s]) - (1 << k)
        widest = np.maximum(spans[k], _later(spans[k], rest)) if rest else spans[k]
        fits += widest <= BITS[s]
    choice = (len(COUNTS) - fits) % len(COUNTS)
    at = _starts(COUNTS[choice])
    chosen = choice[at]
    escaped = chosen == 0
    place = np.arange(len(at)) + np.concatenate(([0], np.cumsum(escaped)[:-1]))
    words = np.zeros(len(at) + int(escaped.sum()), np.uint64)
    padded = np.concatenate((ids, np.zeros(COUNTS[1], np.uint64)))
    for s in np.unique(chosen[~escaped]).tolist():
        rows = np.flatnonzero(chosen == s)
        word = np.full(len(rows), np.uint64(s) << np.uint64(60))
        for j in range(int(COUNTS[s])):
            word |= padded[at[rows] + j] << np.uint64(j * int(BITS[s]))
        words[place[rows]] = word
    words[place[escaped] + 1] = ids[at[escaped]]
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids held by ``words``."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == 0).any():  # a word after an escape is raw, whatever its top bits say
        head = np.ones(len(words), bool)
        i = 0
        for i in np.flatnonzero(selector == 0).tolist():
            if head[i]:
                head[i + 1] = False
    else:
        head = np.ones(len(words), bool)
    at = np.flatnonzero(head)
    s = selector[at]
    first = np.concatenate(([0], np.cumsum(COUNTS[s])))
    out = np.zeros(first[-1] + 1, np.uint64)
    for k in range(1, len(COUNTS)):
        rows = np.flatnonzero(s == k)
        if len(rows):
            j = np.arange(int(COUNTS[k]))
            bits = np.uint64((1 << int(BITS[k])) - 1)
            out[first[rows][:, None] + j] = (words[at[rows]][:, None] >> (j * int(BITS[k])).astype(np.uint64)) & bits
    rows = np.flatnonzero(s == 0)
    out[first[rows]] = words[at[rows] + 1] if len(rows) else 0
    return out[:n]


BLOCKS = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("word_offsets", T.ArrayType(T.LongType())),
        T.StructField("words", T.BinaryType()),
    ]
)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Tokenize ``docs`` (doc_id, text) and write the blocks, in ascending doc_id order over shards and blocks."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, enc = arrow(BLOCKS), encoder(tokenizer, KEPT_CHUNKS)
        end = np.array([end_id], enc.dtype).tobytes()
        shard, first = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        data: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            return _block(schema, shard, first, names, [len(d) // enc.dtype.itemsize for d in data], np.frombuffer(b"".join(data), enc.dtype))

        for batch in slices(batches, "text", 4 << 20):
            for name, doc in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                one = enc.data(doc) + end
                names.append(name)
                data.append(one)
                held += len(one) // enc.dtype.itemsize
                if held >= BLOCK_IDS:
                    yield block()
                    names, data, held, first = [], [], 0, first + held
        if names:
            yield block()

    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "uncompressed").parquet(path)


def _block(schema: pa.Schema, shard: int, first: int, names: list, lengths: list[int], ids: np.ndarray) -> pa.RecordBatch:
    parts = [encode(ids[i : i + PART]) for i in range(0, len(ids), PART)]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
    words = np.concatenate(parts).astype("<u8").tobytes()
    return record_batch(schema, [[shard], [first], [names], [lengths], [offsets.tolist()], [words]])


def block_ids(lengths: list[int], offsets: list[int], words: bytes) -> np.ndarray:
    """All ids of a block, part by part."""
    n, data = sum(lengths), np.frombuffer(words, "<u8")
    ends = [*offsets[1:], len(data)]
    return np.concatenate([decode(data[a:b], min(PART, n - k * PART)) for k, (a, b) in enumerate(zip(offsets, ends, strict=True))])


READ = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
    ]
)
DIGESTS = T.StructType([*READ.fields[:2], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _blocks_with_start(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``base``, the ids of all blocks before: sums over shards, a row each, and the block's place in its shard."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    shards = blocks.groupBy("shard").agg(F.sum(size).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per task of the writer: bounded by its number of partitions
    return blocks.join(F.broadcast(shards.select("shard", before.alias("before"))), "shard").withColumn("base", F.col("before") + F.col("first"))


def _per_document(spark: SparkSession, path: str, schema: T.StructType, make) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow(schema)
        for batch in batches:
            for r in batch.to_pylist():
                ids = block_ids(r["lengths"], r["word_offsets"], r["words"])
                ends = np.cumsum(r["lengths"])
                starts = ends - np.array(r["lengths"])
                docs = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield record_batch(out, [r["doc_ids"], (starts + r["base"]).tolist(), *make(docs)])

    return _blocks_with_start(spark, path).select("doc_ids", "lengths", "word_offsets", "words", "base").mapInArrow(rows, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and the ids of every document in the files."""
    return _per_document(spark, path, READ, lambda docs: [[d.astype(np.int64) for d in docs]])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document in the files: start, n_tokens and the crc32 of its ids as little-endian 32-bit numbers."""
    return _per_document(spark, path, DIGESTS, lambda docs: [[len(d) for d in docs], [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]])


def query(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = new_path(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer)
    return digests(docs.sparkSession, path)
