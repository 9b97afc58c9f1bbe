"""Connected components of an edge table by alternating large and small stars.

Every step is an aggregation and a join, so a node with very many neighbours is combined map-side
and its edges may be split; no neighbour list is gathered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywork.llm.frames import released, written


class Forest:
    """Union by smallest root, for the links of one task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


def _forests(batches):
    """Edges of this task, less those that close a circle."""
    forest, schema = Forest(), pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    found = [(x, r) for x in forest.parent if (r := forest.root(x)) != x]
    for k in range(0, len(found), 50_000):
        part = found[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (two long columns); the root is the component's smallest node.

    Null ends and loops are left out; repeated edges count once.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b")
    now = written(edges.mapInArrow(released(_forests), "a long, b long"), "links")
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(low).distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select("b", "b").distinct())
        seen = state
