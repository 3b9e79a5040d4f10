"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.llm.common import stored


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either the smallest of its component or linked with that alone."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("a").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    met = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return met.agg(F.coalesce(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))), F.lit(False)).alias("open")).first()["open"] is False


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = both.filter("b > a").join(least, "a")
    return larger.select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of those."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    smaller = edges.join(least, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return smaller.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node with a link.

    ``links`` has the columns ``a`` and ``b``. Each round at least halves the depth of the
    trees; a node with any number of neighbours is aggregated, not gathered. Steps are written in
    ``parts`` parts at most, if given.
    """
    edges = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(edges, parts)
    while not _settled(edges):
        edges = stored(_small_star(_large_star(edges)), parts)
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
