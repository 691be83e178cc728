"""Connected components of a graph by star operations: each pass is a group by node and a join with its smallest neighbour.

A pass replaces edges by others that join the same nodes: the larger neighbours of a node (large star), then the smaller
ones (small star), are linked to the smallest. Passes go on until nothing changes; then every node hangs on the smallest
of its component. Edges stay a table in the shared folder, and no node's neighbours are ever gathered in one task: minima
are combined before the shuffle, and Spark splits the join of a node that has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import discard, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """edges(a, b) have the larger node in a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root of each node of edges(a, b): root is the smallest node that it is linked with.

    Edges have no direction; loops, repeated edges and edges with a null end don't count.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, f"{name}-edges")
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    seen = mark(now)
    while seen["n"]:
        after = written(_small(_large(now).where("a > b").distinct()).distinct(), f"{name}-edges")
        said = mark(after)
        discard(now)
        now = after
        if said == seen:
            break
        seen = said
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
