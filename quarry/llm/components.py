"""Connected components of a graph whose edges stay distributed: alternating large and small stars.

Each round makes every edge point nearer to the smallest node of its component; a round is two
aggregations (with map-side combine, so a star's centre is no hot key) and two joins that AQE can
split.  Rounds end when the edges stay the same.  Nothing but a count and a checksum reaches the driver.

Before the rounds each task joins what up to PER_TASK edges hold together and passes on a tree of it, so that many edges among few nodes
(a group of near copies) become about as many as nodes; a graph of so few edges is done then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import checkpointed

#: Edges that one task joins (some 100 bytes of memory each).
PER_TASK = 1_000_000


def _least(edges: DataFrame) -> DataFrame:
    """To each edge (a, b), the least node m of a and its neighbours in b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges.join(least, "a")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _trees(edges: DataFrame, parts: int) -> DataFrame:
    """Of the edges in each of so many parts, an edge from each node to the least one that they join it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, kind = {}, None

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            kind = batch.schema.field("a").type
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = top(up.setdefault(x, x)), top(up.setdefault(y, y))
                if x != y:
                    up[max(x, y)] = min(x, y)
        low = [x for x in up if up[x] != x]
        for i in range(0, len(low), 10_000):
            some = low[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([top(x) for x in some], kind)], ["a", "b"])

    return edges.coalesce(parts).mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", per_task: int = PER_TASK) -> DataFrame:
    """Nodes with an edge to another node: (node, root), root the smallest node of the component.

    Nulls, loops and repeated edges are left out.  An empty table gives an empty table."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x <> y")
    e = checkpointed(e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    parts = -(-e.count() // per_task)
    if parts:
        e = checkpointed(_trees(e, parts))
    mark = _mark(e) if parts > 1 else (0,)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).filter("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = _least(large)  # its edges all point down
        small = near.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a > b").distinct()
        e, before = checkpointed(small), mark
        mark = _mark(e)
        if mark == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
