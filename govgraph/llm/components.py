"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import mapped, stash

#: Edges that one task may hold: about 100 MB.
FEW_EDGES = 1 << 20


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the not larger) neighbours of each node on its smallest one."""
    both = _directed(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    if large:
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def _mark(edges: DataFrame) -> tuple:
    found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(found)


def _united(edges: DataFrame) -> DataFrame:
    """The same for few edges, in one task: union-find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = above[up]
                x = above[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = find(a), find(b)
                above[max(a, b)] = min(a, b)
        nodes = list(above)
        for lo in range(0, len(nodes), 100_000):
            some = nodes[lo : lo + 100_000]
            yield pa.record_batch([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], names=["node", "root"])

    return mapped(edges.select("a", "b").repartition(1), run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node that has an edge (a, b); order and repeats don't matter.

    Up to ``FEW_EDGES`` edges, counted first, go to one task.  Beyond, each round is aggregations with
    map-side combining and joins whose hot keys Spark can split, and a round's edges are written to
    the shared folder; rounds grow as the logarithm of the longest shortest path, and only a count
    and a checksum come to the driver.
    """
    now = stash(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    if mark[0] <= FEW_EDGES:
        return _united(now)
    while mark[0]:
        now = stash(_star(_star(now, True), False))
        if (new := _mark(now)) == mark:
            break
        mark = new
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
