"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step keeps the components and brings every node nearer to its smallest node; edges are
re-pointed with joins on aggregated minima, so no node's neighbours are gathered in one place, and
each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeingraph.runtime import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), where root is the component's smallest node and
    isn't listed itself. Nulls and loops are left out; an empty table gives an empty one."""
    e = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = large.unionAll(e.join(low, "a").select("a", F.col("m").alias("b")).where("a != b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("x")).select("x.a", "x.b")
        e = stored(small.where("a != b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
