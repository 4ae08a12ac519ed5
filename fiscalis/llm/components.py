"""Connected components of a graph that may exceed any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.llm.common import shared_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, root), root the smallest node reachable; one row per node with an edge.

    Alternates the large-star and small-star steps until the edges form stars. Each step replaces edges, never adds
    more than it takes, and takes a minimum per node (combined before the shuffle), so a node with very many
    neighbours costs a join that Spark can split. Every round is checkpointed in the shared folder.
    Null ends and self-loops are ignored; repeated edges count once; no edges give no rows.
    """
    shared_dir(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    sign = _sign(now)
    while sign[0]:
        now = _small_star(_large_star(now)).checkpoint()
        before, sign = sign, _sign(now)
        if before == sign:
            break
    own = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own)


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
