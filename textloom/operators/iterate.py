"""Fixpoints over edges, with the lineage cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import temporary as cut

__all__ = ["components", "cut"]


def _least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, u's smallest v: by an aggregate, as a node may have very many neighbours."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """node, root of the undirected edges (a, b): large-star and small-star by turns until nothing changes."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % 1000000007).cast("decimal(38,0)")).alias("s")).first()
        if not now.n or (now.n, now.s) == state:
            break
        state = (now.n, now.s)
        both = e.union(e.select("v", "u")).toDF("u", "v")
        large = _least(both).select("u", "v", F.least("u", "m").alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        e = cut(small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))).where("u <> v").distinct())
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
