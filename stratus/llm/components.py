"""Connected components of a large edge table by alternating large-star and
small-star steps. Each step is an aggregation and a join; the edge table is
written between steps, so lineage stays short and a lost executor costs one
step. The number of rounds is logarithmic in practice, and a hot vertex is
aggregated map side and split by skew-join handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.session import materialize


def _nearest(edges: DataFrame) -> DataFrame:
    """(u, m): smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_nearest(both), "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_nearest(down), "u")
    own = joined.select("u", F.col("m").alias("v"))
    others = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(others).where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node on an edge that is not the smallest of its
    component; ``label`` is that smallest node. Loops and repeated edges do no
    harm."""
    edges = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                        .where("u <> v").distinct(), "edges")
    mark = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        mark = now
