"""Connected components of an edge table, without any group in one place.

Alternates the two star operations of Kiveris et al. (2014): every node's larger neighbours, then
its smaller ones, are hung on the smallest node known. Rows never exceed edges plus nodes; a node
with very many edges is a plain join key, which adaptive execution splits. Each round is written
below the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.session import written

ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """``a`` is larger than ``b`` in every row."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    hung = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b); a root is its component's smallest node.

    Roots are not listed themselves. Runs jobs. An empty table gives an empty one.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges, "edges")
    before = None
    for _ in range(ROUNDS):
        edges = written(_small(_large(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.toDF("node", "root")
        before = now
    raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
