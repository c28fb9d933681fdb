"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Byte tables for ``bytes.translate``: lower-case A-Z and turn every separator into a space. Bytes from 0x80 on belong to
#: words in both definitions, so UTF-8 can be cut into words without decoding it.
ALNUM_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
SPACE_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c == 0x20 or 0x09 <= c <= 0x0D else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where none is set and Spark itself runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chromaframe-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting to delete an execution's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Executions inside leave no shuffle files behind; what they wrote to the shared folder is all that later steps read."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there, lost executors cost one re-read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with brief_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by ``written``, once nothing needs it any more."""
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def columns(df: DataFrame, within: str = "") -> list[Column]:
    """All columns of ``df`` under their own names, dots and back quotes in them included; fields of struct ``within`` if one is named."""
    names = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    return [F.col(f"{within}.{n}" if within else n).alias(c) for n, c in zip(names, df.columns, strict=True)]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(name: str = "text") -> Column:
    """A text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def crc_remainder(doc_id: str, mod: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches where the running size of a text column passes a bound; a longer row stands alone."""
    for batch in batches:
        start = 0
        size = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            size += n or 0
            if size >= most_bytes:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def whole_rows(docs: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``make`` over batches of all columns of ``docs``, which it gives back changed or fewer; columns may have any names."""
    schema = StructType([StructField("all", docs.schema, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in make(pa.RecordBatch.from_struct_array(b.column(0)) for b in batches):
            yield pa.RecordBatch.from_arrays([batch.to_struct_array()], schema=arrow(schema))

    return docs.select(F.struct(*columns(docs)).alias("all")).mapInArrow(run, schema).select(*columns(docs, "all"))


def arrow(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A batch of Python lists, numpy arrays or Arrow arrays, in the order of the schema."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
