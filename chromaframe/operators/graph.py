"""Connected components of edge tables, within groups, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaframe.sources.store import stored


def _star(edges: DataFrame, keys: list[str], large: bool) -> DataFrame:
    """Ties every node's larger (``large``) or other smaller neighbours to the smallest node in its reach; edges are (keys, a > b)."""
    both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    if large:
        moved = both.where("b > a").join(least.hint("merge"), [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = both.join(least.hint("merge"), [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(*keys, "a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, keys: list[str], most_rounds: int = 60) -> DataFrame:
    """(keys, node, component) of every node of ``edges`` (keys, a, b) but the components' smallest nodes themselves; a component is its smallest node.

    Joins are by shuffles, whatever their sizes on disk: packed files of numbers would look small enough to pass through the driver. Every round is written to the shared folder; a round that changes nothing, told by a count and a sum, is the last.
    """
    now = stored(edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now.select(*keys, F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark
        now = stored(_star(_star(now, keys, True), keys, False), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
