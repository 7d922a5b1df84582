"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posevidence.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; from columns a and b.

    Every round is written to the shared folder, which cuts the lineage; only
    a count and a checksum of the edges come to the driver. Alternating
    stars always settle; there is no bound on the rounds that they may take.
    """
    edges = stored(_tidy(edges), "links")
    known = _checksum(edges)
    while True:
        edges = stored(_tidy(_small_star(_large_star(edges))), "links")
        now = _checksum(edges)
        if now == known:
            break
        known = now
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)


def _tidy(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .distinct()
    )


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame) -> DataFrame:
    """Each edge (node, other) with the least of the node and its neighbours."""
    least = edges.groupBy("node").agg(F.min("other").alias("least"))
    return edges.join(least, "node").withColumn("least", F.least("node", "least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    return _star(both).filter(F.col("other") > F.col("node")).select(
        F.col("other").alias("a"), F.col("least").alias("b")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    tidy = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).filter(
        F.col("node") != F.col("other")
    ).distinct()
    starred = _star(tidy)
    return starred.select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(
        starred.select(F.col("node").alias("a"), F.col("least").alias("b"))
    )
