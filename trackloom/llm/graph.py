"""Connected components by alternating large and small stars; every step is a join, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm.common import checkpointed


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b): the root is the component's smallest node.

    Null ends and loops are left out; repeated edges count once. Nodes of very many edges are no task's alone. Each round is written to the shared folder.
    Raises if ``rounds`` don't suffice, which takes more than 2**rounds nodes in a path.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = checkpointed(e)
    before = None
    for _ in range(rounds):
        # large star: an edge's smaller end gives way to its own smallest neighbour. The hub of a star is the smaller end of many edges;
        # both sides of the join are plain shuffles, so that adaptive execution splits it
        least = checkpointed(e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")))
        large = e.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        # small star: a node and its smaller neighbours, few by then, go to the smallest
        near = large.withColumn("m", F.min("b").over(W.partitionBy("a")))
        small = near.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).where("a <> b").distinct()
        e = checkpointed(small)
        now = _sum(e)
        if now == before:
            roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now
    raise RuntimeError("components didn't settle")
