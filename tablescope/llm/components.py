"""Connected components of a table of edges, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.plans.scratch import write_scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the smallest node that it reaches.

    Alternates two steps until nothing changes: link larger neighbours to the smallest neighbour of each node, then link
    smaller neighbours and the node itself to it. A node with very many neighbours is reduced by a partial aggregate.
    """
    now = write_scratch(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = _both(now)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small_least = down.groupBy("a").agg(F.min("b").alias("m"))
        linked = down.join(small_least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = write_scratch(linked.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (found.n, found.h) == state:
            break
        state = (found.n, found.h)
    return now.groupBy("a").agg(F.min("b").alias("b")).select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("x")).select("x.*").distinct()
