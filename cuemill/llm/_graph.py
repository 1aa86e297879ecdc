"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregate and a join on the same node; what it makes is written to the shared folder.
Map-side partial minima meet a hub with very many edges in the aggregate.  In the join the minima of such
hubs are broadcast, fewer than HOT_KEYS rows, so that its edges stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import HOT_KEYS, staged


def _with_least(edges: DataFrame, name: str) -> DataFrame:
    """edges with m, the least of u and its neighbours v; edges is read twice."""
    grouped = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = staged(grouped.select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "n"), f"{name}-least")
    total, most = least.agg(F.sum("n"), F.max("n")).first()
    if total is None or most * HOT_KEYS <= total:
        return edges.join(least, F.col("u") == F.col("k")).select("u", "v", "m")
    is_hot = F.col("n") * HOT_KEYS > total
    marked = edges.join(F.broadcast(least.where(is_hot).select("k", "m")), F.col("u") == F.col("k"), "left")
    rare = marked.where("k is null").select("u", "v").join(least.where(~is_hot), F.col("u") == F.col("k"))
    return marked.where("k is not null").select("u", "v", "m").unionAll(rare.select("u", "v", "m"))


def _large_star(edges: DataFrame, name: str) -> DataFrame:
    # repeated rows do no harm here: there are no more than edges, and the small star drops them
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_least(both, name).where("v > u")
    return staged(found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), f"{name}-large")


def _small_star(edges: DataFrame, name: str) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down, name)
    out = found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(found.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node is either a leaf with one edge or a root, for distinct edges with u > v."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionAll(edges.select(F.col("v").alias("k"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
    most = ends.groupBy("k").agg((F.sum("leaf") + F.max("root")).alias("n")).agg(F.max("n")).first()[0]
    return most is None or most < 2


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node with an edge, root being the smallest node of its component.

    edges has two bigint columns u, v; loops are ignored; an empty table gives an empty result."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = staged(down.where("u <> v").distinct(), name)
    while not _is_forest(edges):
        edges = staged(_small_star(_large_star(edges, name), name), name)
    ones = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(ones)
