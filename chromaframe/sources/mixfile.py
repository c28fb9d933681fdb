"""Mix tables as binary files: a header, then ten bytes per mix.

Fixed values of the format, little-endian: "KMLT", version 1, number of pigments (one byte each), steps of an amount (two bytes), then four
bytes each for pairs, triples, steps of a pair, steps of a triple. A mix is three pigment numbers, the amounts packed in a byte (high nibble
first, low nibble second, the rest of 8 third) and L, a, b as 16-bit floats. All pairs come before all triples, each in the order
of their pigments and amounts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaframe.functions import color as C

HEADER = struct.Struct("<4sBBHIIII")
ENTRY = np.dtype([("i0", "u1"), ("i1", "u1"), ("i2", "u1"), ("packed", "u1"), *[(c, "<f2") for c in C.LAB]])
EIGHTHS, PAIR_STEPS, TRIPLE_STEPS = 8, 9, 45
MIXES = "i0 int, i1 int, i2 int, a0 int, a1 int, a2 int, ok_l double, ok_a double, ok_b double, n_paints int"


def encode(mixes: DataFrame, pigments: int) -> bytes:
    """The file of a complete mix table of up to 255 pigments; its size hangs on their number alone (35 MB for 78)."""
    pairs, triples = pigments * (pigments - 1) // 2, pigments * (pigments - 1) * (pigments - 2) // 6
    if pigments > 255:
        raise ValueError("a pigment's number is one byte")
    rows = mixes.select(*[F.col(c).cast("short") for c in ("i0", "i1", "i2", "a0", "a1")], *C.LAB).toArrow()
    if rows.num_rows != pairs * PAIR_STEPS + triples * TRIPLE_STEPS:
        raise ValueError("not all mixes of these pigments")
    column = {c: rows.column(c).to_numpy() for c in rows.column_names}
    order = np.lexsort([column[c] for c in ("a1", "a0", "i2", "i1", "i0")] + [column["i2"] >= 0])
    out = np.zeros(rows.num_rows, ENTRY)
    for c in ("i0", "i1"):
        out[c] = column[c][order]
    out["i2"] = np.maximum(column["i2"], 0)[order]
    out["packed"] = (column["a0"] << 4 | column["a1"])[order]
    for c in C.LAB:
        out[c] = column[c][order]
    return HEADER.pack(b"KMLT", 1, pigments, EIGHTHS, pairs, triples, PAIR_STEPS, TRIPLE_STEPS) + out.tobytes()


def decode(data: bytes) -> pd.DataFrame:
    """All mixes of a file; a file that is too short or of another kind is an error."""
    if len(data) < HEADER.size:
        raise ValueError("too small for a mix table")
    magic, _, _, _, pairs, triples, pair_steps, triple_steps = HEADER.unpack_from(data)
    if magic != b"KMLT":
        raise ValueError("not a mix table")
    n = pairs * pair_steps + triples * triple_steps
    if len(data) < HEADER.size + n * ENTRY.itemsize:
        raise ValueError("mix table cut short")
    rows = np.frombuffer(data, ENTRY, n, HEADER.size)
    out = pd.DataFrame({c: rows[c].astype(np.int32) for c in ("i0", "i1", "i2")})
    out["a0"], out["a1"] = (rows["packed"] >> 4).astype(np.int32), (rows["packed"] & 15).astype(np.int32)
    out["a2"] = EIGHTHS - out["a0"] - out["a1"]
    out.loc[: pairs * pair_steps - 1, "i2"] = -1
    for c in C.LAB:
        out[c] = rows[c].astype(np.float64)
    out["n_paints"] = (out[["a0", "a1", "a2"]] > 0).sum(axis=1).astype(np.int32)
    return out


def entry(data: bytes, at: int) -> tuple:
    """One mix by its place: (i0, i1, i2, packed, L, a, b)."""
    return tuple(np.frombuffer(data, ENTRY, 1, HEADER.size + at * ENTRY.itemsize)[0].tolist())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The mixes of every file at ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield decode(bytes(data))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, MIXES)
