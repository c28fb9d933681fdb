"""Packing of tokenized documents into windows of near-equal length by Karmarkar-Karp multiway differencing.

Each partition of the input packs on its own, in one pass without a shuffle: documents are tokenized, whole windows are cut from
long ones, and the remaining pieces fill groups of ``GROUP`` windows. A group is closed by cutting its last piece so that its total
is ``GROUP * capacity`` less a small slack, and its longest pieces, ``CRUMB_SHARE`` of its ids, are cut into crumbs that can level windows out.
Then partial partitions, each a tuple of windows, are merged largest difference first, the fullest windows of one with the emptiest
of the other. If a window comes out over capacity, the number of windows rises by one
and the differencing runs again. So a task holds the ids of one group, and padding stays near the slack.

Edge cases: a null or empty text is the end id alone, one piece. No document is dropped or shortened. Repeated rows are packed once
per row. Other columns are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.bpe import encoder
from chromaframe.llm.common import arrow, record_batch, slices

CAPACITY = 4096
END_ID = 2
#: Windows packed together, and the share of them left free so that differencing can meet the capacity.
GROUP = 48
SLACK = 0.006
#: Crumbs are shorter than twice a window's slack; their share covers what the other pieces leave uneven.
CRUMB = 32
CRUMB_SHARE = 0.04


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``k`` groups of near-equal sums."""
    heap = []
    for i, n in enumerate(sizes):
        heap.append((-n, i, [(n, (i, None))] + [(0, None)] * (k - 1)))
    heapq.heapify(heap)
    if not heap:
        return [[] for _ in range(k)]
    number = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = [(x + y, (p, q) if p and q else p or q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)]
        merged.sort(key=lambda w: -w[0])
        number += 1
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], number, merged))
    return [_members(tree) for _, tree in heap[0][2]]


def _members(tree) -> list[int]:
    out, left = [], [tree]
    while left:
        node = left.pop()
        if node is None:
            continue
        if isinstance(node[0], int):
            out.append(node[0])
        else:
            left += node
    return sorted(out)


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups within ``capacity``: as few as the total allows, then one more each time a group comes out too long."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        k += 1


PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with their place: sequence_id, offset; ``with_ids`` adds the ids themselves."""
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    target = int(group * capacity * (1 - SLACK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, out = encoder(tokenizer).ids, arrow(schema)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held: list[tuple] = []  # doc_id, start, ids, doc_tokens, row
        total = number = 0

        def place(members: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            joined: list[tuple] = []
            for doc, start, ids, n, row in sorted(members, key=lambda p: (p[4], p[1])):
                if joined and joined[-1][4] == row and joined[-1][1] + len(joined[-1][2]) == start:
                    ids = np.concatenate((joined[-1][2], ids))
                    start = joined.pop()[1]
                joined.append((doc, start, ids, n, row))
            for doc, start, ids, n, _ in joined:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, offset, *([ids.astype(np.int32)] if with_ids else [])))
                offset += len(ids)
            sequence += 1

        def close() -> None:
            nonlocal held
            held.sort(key=lambda p: -len(p[2]))
            crumbs, cut = [], 0
            while held and cut < CRUMB_SHARE * total and len(held[0][2]) > CRUMB:
                doc, start, ids, n, row = held.pop(0)
                cut += len(ids)
                crumbs += [(doc, start + a, ids[a : a + CRUMB], n, row) for a in range(0, len(ids), CRUMB)]
            held += crumbs
            for members in windows([len(p[2]) for p in held], capacity):
                place([held[i] for i in members])

        def batch_of() -> pa.RecordBatch:
            return record_batch(out, [list(c) for c in zip(*rows, strict=True)])

        for batch in slices(batches, "text", 4 << 20):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(ids_of(text), np.uint32(end_id)).astype("<u4")
                number += 1
                whole = len(ids) // capacity * capacity
                for a in range(0, whole, capacity):
                    place([(doc, a, ids[a : a + capacity], len(ids), number)])
                start = whole
                while start < len(ids):
                    end = min(len(ids), start + target - total)
                    held.append((doc, start, ids[start:end], len(ids), number))
                    total += end - start
                    start = end
                    if total == target:
                        close()
                        held, total = [], 0
            if rows:
                yield batch_of()
                rows = []
        if held:
            close()
        if rows:
            yield batch_of()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
