"""Mix tables as a data source, ``spark.read.format("mixfile").load(path)``: the mixes with ``entry``, their place in the table.

A table is one file of ``mixfile``'s format, or a folder that the source has written: the header, and parts named by their first entry. A read is split into
ranges of entries, each read by its bytes; conditions on ``entry`` and on ``i0``, the first pigment, cut down the ranges before anything is read. Pushing them down
needs ``spark.sql.python.filterPushdown.enabled``, which ``read_mixes`` sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from chromaframe.functions import color as C
from chromaframe.sources.mixfile import EIGHTHS, ENTRY, HEADER, MIXES, PAIR_STEPS, TRIPLE_STEPS
from chromaframe.sources.staging import Staged, Staging, filesystem

SCHEMA = f"entry bigint, {MIXES}"
#: Entries of one partition of a read, 2.6 MB.
SPLIT = 1 << 18
HEADER_NAME = "header.bin"


def two_of(n):
    return n * (n - 1) // 2


def three_of(n):
    return n * (n - 1) * (n - 2) // 6


def header(pigments: int) -> bytes:
    return HEADER.pack(b"KMLT", 1, pigments, EIGHTHS, two_of(pigments), three_of(pigments), PAIR_STEPS, TRIPLE_STEPS)


def entry_of(pigments: int) -> Column:
    """The place of a mix (i0, i1, i2, a0, a1) of numbered pigments in the table."""
    i0, i1, i2, a0, a1 = (F.col(c).cast("long") for c in ("i0", "i1", "i2", "a0", "a1"))
    n = F.lit(pigments).cast("long")

    def two(c: Column) -> Column:
        return F.floor(c * (c - 1) / 2)

    def three(c: Column) -> Column:
        return F.floor(c * (c - 1) * (c - 2) / 6)

    pair = (two(n) - two(n - i0) + i1 - i0 - 1) * PAIR_STEPS + a0
    triple = (three(n) - three(n - i0) + two(n - i0 - 1) - two(n - i1) + i2 - i1 - 1) * TRIPLE_STEPS + a0 * (EIGHTHS + 1) - two(a0) + a1
    return F.when(i2 < 0, pair).otherwise(two(n) * PAIR_STEPS + triple)


@dataclass
class Range(InputPartition):
    """Entries [first, end) of a file that starts with entry ``base`` behind ``skip`` bytes."""

    path: str
    base: int
    skip: int
    first: int
    end: int
    pairs: int


class MixReader(DataSourceReader):
    def __init__(self, path: str, split: int = SPLIT):
        self.path, self.split = path, split
        self.low, self.high, self.first_paint = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", None)
            value = getattr(f, "value", None)
            if column == ("i0",) and isinstance(f, EqualTo):
                self.first_paint = value if self.first_paint in (None, value) else -1
            elif column == ("entry",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    def _wanted(self, pigments: int, total: int) -> list[tuple[int, int]]:
        """Ranges of entries that the conditions leave."""
        ranges = [(0, total)]
        if (i := self.first_paint) is not None:
            ends = [two_of(pigments) - two_of(pigments - k) for k in (i, i + 1)], [three_of(pigments) - three_of(pigments - k) for k in (i, i + 1)]
            pairs = two_of(pigments) * PAIR_STEPS
            ranges = [tuple(e * PAIR_STEPS for e in ends[0]), tuple(pairs + e * TRIPLE_STEPS for e in ends[1])] if 0 <= i < pigments else []
        high = total if self.high is None else self.high
        return [(max(a, self.low), min(b, high)) for a, b in ranges if max(a, self.low) < min(b, high)]

    def partitions(self) -> list[Range]:
        system, root = filesystem(self.path)
        info = system.get_file_info(root)
        folder = info.type == fs.FileType.Directory
        if info.type == fs.FileType.NotFound or (folder and system.get_file_info(f"{root}/{HEADER_NAME}").type == fs.FileType.NotFound):
            raise ValueError(f"no mix table at {self.path}")
        with system.open_input_file(f"{root}/{HEADER_NAME}" if folder else root) as f:
            head = f.read(HEADER.size)
        if len(head) < HEADER.size or head[:4] != b"KMLT":
            raise ValueError("not a mix table")
        _, _, pigments, _, pairs, triples, pair_steps, triple_steps = HEADER.unpack(head)
        pairs, total = pairs * pair_steps, pairs * pair_steps + triples * triple_steps
        if folder:
            parts = sorted((int(p.base_name.split("-")[1]), p.path, p.size) for p in system.get_file_info(fs.FileSelector(root)) if p.is_file and p.base_name.startswith("entries-"))
            files = [(path, base, 0, size // ENTRY.itemsize) for base, path, size in parts]
        else:
            files = [(root, 0, HEADER.size, (info.size - HEADER.size) // ENTRY.itemsize)]
        if sum(n for *_, n in files) < total:
            raise ValueError("mix table cut short")
        out = []
        for a, b in self._wanted(pigments, total):
            for path, base, skip, n in files:
                for first in range(max(a, base), min(b, base + n), self.split):
                    out.append(Range(path, base, skip, first, min(b, base + n, first + self.split), pairs))
        return out or [Range("", 0, 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.end:
            return
        system, _ = filesystem(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(partition.skip + (partition.first - partition.base) * ENTRY.itemsize)
            rows = np.frombuffer(f.read((partition.end - partition.first) * ENTRY.itemsize), ENTRY)
        entry = np.arange(partition.first, partition.end)
        i2 = np.where(entry < partition.pairs, -1, rows["i2"].astype(np.int32)).astype(np.int32)
        a0, a1 = (rows["packed"] >> 4).astype(np.int32), (rows["packed"] & 15).astype(np.int32)
        amounts = [a0, a1, EIGHTHS - a0 - a1]
        count = sum((a > 0).astype(np.int32) for a in amounts)
        columns = [entry, rows["i0"].astype(np.int32), rows["i1"].astype(np.int32), i2, *amounts, *(rows[c].astype(np.float64) for c in C.LAB), count.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])


class MixWriter(DataSourceArrowWriter):
    """Parts of consecutive entries, from rows that come in the order of ``entry``; the header comes last, so a table without one is none."""

    def __init__(self, path: str, pigments: int, overwrite: bool):
        self.staging, self.pigments, self.overwrite = Staging(path), pigments, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files = self.staging.attempt()
        for batch in iterator:
            entry = batch.column("entry").to_numpy()
            out = np.zeros(len(entry), ENTRY)
            i2, a0, a1 = (batch.column(c).to_numpy() for c in ("i2", "a0", "a1"))
            for c in ("i0", "i1"):
                out[c] = batch.column(c).to_numpy()
            out["i2"], out["packed"] = np.maximum(i2, 0), a0 << 4 | a1
            for c in C.LAB:
                out[c] = batch.column(c).to_numpy()
            for part in np.split(np.arange(len(entry)), np.flatnonzero(np.diff(entry) != 1) + 1):
                if len(part):
                    files.add(f"entries-{entry[part[0]]:012d}", out[part].tobytes())
        return files.message()

    def commit(self, messages: list[Staged | None]) -> None:
        self.staging.commit(messages, self.overwrite)
        system, root = filesystem(self.staging.path)
        with system.open_output_stream(f"{root}/{HEADER_NAME}") as out:
            out.write(header(self.pigments))

    def abort(self, messages: list[Staged | None]) -> None:
        self.staging.abort()


class MixFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mixfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MixReader:
        return MixReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> MixWriter:
        return MixWriter(self.options["path"], int(self.options["pigments"]), overwrite)


def write_mixes(mixes: DataFrame, pigments: int, path: str) -> None:
    """A complete mix table of numbered pigments (0, 1, ..., up to 255) as a folder, every task its range of entries."""
    if pigments > 255:
        raise ValueError("a pigment's number is one byte")
    mixes.sparkSession.dataSource.register(MixFile)
    numbered = mixes.select(entry_of(pigments).alias("entry"), *[c.split()[0] for c in MIXES.split(", ")])
    parts = max(1, (two_of(pigments) * PAIR_STEPS + three_of(pigments) * TRIPLE_STEPS) // SPLIT)
    numbered.repartitionByRange(parts, "entry").sortWithinPartitions("entry").write.format("mixfile").option("pigments", pigments).mode("overwrite").save(path)


def read_mixes(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MixFile)
    return spark.read.format("mixfile").option("split", split).load(path)
