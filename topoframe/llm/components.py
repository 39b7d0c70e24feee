"""Connected components by alternating large and small stars, each round one job over a written edge table.

Every node ends up pointing at the smallest node it reaches. Nothing is collected: a round is two
aggregations (with map-side combine) and two equi-joins that adaptive execution may split on hot nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest v of each u. Grouped by the id's text, so that the join by u which follows has an exchange of its own on
    either side, and adaptive execution may split the rows of a hot u."""
    return edges.groupBy(F.col("u").cast("string").alias("key")).agg(F.first("u").alias("u"), F.min("v").alias("m")).drop("key")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another; null ends and self-loops are ignored.

    Empty input gives an empty result. Repeated and reversed edges count once.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    cur = written(pairs.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    before = _print(cur)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least(large)
        moved = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = written(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _print(cur)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not converge")
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionAll(roots)
