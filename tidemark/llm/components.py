"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _mins(edges: DataFrame, key: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(key).alias("u")).agg(F.least(F.min(other), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mins = cut(_mins(both, "a", "b"))  # written, so that a join may split a node of very many edges
    return both.join(mins, both["a"] == mins["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    mins = _mins(edges, "a", "b")  # a node has few smaller neighbours after a large star
    rest = edges.join(mins, edges["a"] == mins["u"]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(mins.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b: long); root is the smallest node reachable.

    Loops and repeated edges are allowed; an empty edge table gives an empty result. Each round cuts its lineage
    with a checkpoint; the driver sees two numbers a round.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    seen = None
    while True:
        # done when no node has two parents and no parent has one itself
        now = cut(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            break
        seen = tuple(state)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
