"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), whatever their direction or number.

    Each round, every node points at the neighbour (or itself) that comes first in
    the order of a hash of the node, and the graph shrinks to the nodes pointed
    at; with hashed order a constant share of the nodes goes each round, also on long paths.
    A hub's neighbours are reduced by partial aggregates, and its edges are
    looked up by joins that adaptive execution splits. Loops and nulls are ignored.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    e = durable(edges.where("a <> b").select("a", "b").distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least(rank("b"), rank("a")))["v"].alias("up"))
        up = durable(up)
        maps.append(up)
        at = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"_{c}"))  # noqa: B023,E731
        e = durable(e.join(at("a"), "a").join(at("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    roots = maps[0].withColumnRenamed("up", "root")
    for m in maps[1:]:
        step = m.select(F.col("node").alias("root"), F.col("up").alias("_next"))
        roots = roots.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return durable(roots) if len(maps) > 1 else roots
