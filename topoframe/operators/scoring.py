"""Multiset scores of typed multigraphs, and trace distances.

Both sides of a comparison are tagged and unioned, so one partial aggregation and one exchange do the work of two
aggregations and a full outer join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topoframe.functions import geometry as G


def tagged_counts(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, g): how often each key occurs on either side; null keys are a key of their own."""
    one = lambda d, p, g: d.select(*keys, F.lit(p).alias("p"), F.lit(g).alias("g"))
    return one(pred, 1, 0).unionAll(one(gold, 0, 1)).groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("g").alias("g"))


def overlap(pred: DataFrame, gold: DataFrame, group: list[str], item: list[str], prefix: str = "") -> DataFrame:
    """Per group: tp (multiset intersection), pred, gt and exact (the multisets are equal)."""
    counts = tagged_counts(pred, gold, [*group, *item])
    aggs = [F.sum(F.least("p", "g")).alias(f"{prefix}tp"), F.sum("p").alias(f"{prefix}pred"), F.sum("g").alias(f"{prefix}gt"), F.bool_and(F.col("p") == F.col("g")).alias(f"{prefix}exact")]
    return counts.groupBy(*group).agg(*aggs)


def pair_exact(pred: DataFrame, gold: DataFrame, group: list[str], pair: list[str], kind: str) -> DataFrame:
    """Per group: pairs whose multiset of types is the same on both sides, of all pairs of either side."""
    same = overlap(pred, gold, [*group, *pair], [kind])
    return same.groupBy(*group).agg(F.count_if("exact").alias("pair_exact"), F.count("*").alias("pair_total"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where nothing is counted."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(prefix: str = "") -> list[Column]:
    p, r = ratio(f"{prefix}tp", f"{prefix}pred"), ratio(f"{prefix}tp", f"{prefix}gt")
    return [F.round(p, 6).alias(f"{prefix}precision"), F.round(r, 6).alias(f"{prefix}recall"), F.round(ratio(2 * p * r, p + r), 6).alias(f"{prefix}f1")]


def sample_scores(nodes_pred: DataFrame, nodes_gold: DataFrame, mapping: DataFrame, edges_pred: DataFrame, edges_gold: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """One wide row of counters per sample: node, endpoint and typed overlaps, exact pairs and graphs, mapped nodes.

    nodes: (key, name) with normalised names, of which empty ones don't count; edges_pred: ends already remapped. Samples without rows have zeros, and their
    empty graphs are equal.
    """
    parts = [
        overlap(nodes_pred.filter("name <> ''"), nodes_gold.filter("name <> ''"), [key], ["name"], "node_"),
        overlap(edges_pred, edges_gold, [key], ["source", "target"], "endpoint_").drop("endpoint_exact"),
        overlap(edges_pred, edges_gold, [key], ["source", "target", "type"], "typed_"),
        pair_exact(edges_pred, edges_gold, [key], ["source", "target"], "type"),
        mapping.groupBy(key).agg(F.count("*").alias("node_mapped")),
    ]
    wide = reduce(lambda a, b: a.join(b, key, "left"), parts, samples)
    new = [c for c in wide.columns if c not in samples.columns and not c.endswith("_exact") or c == "pair_exact"]
    wide = wide.withColumns({c: F.coalesce(c, F.lit(0)) for c in new})
    exact = F.coalesce("typed_exact", F.lit(True)).cast("int")
    return wide.withColumns({"node_count_exact": (F.col("node_pred") == F.col("node_gt")).cast("int"), "sample_multigraph_exact": exact}).drop("node_exact", "typed_exact")


def output_counters(edges: DataFrame, infos: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per sample: predicted edges, those with a trace and with a valid one, groups of output and those with a format error.

    edges: parsing.edges() rows; infos: parsing.edge_info() rows, one per group. Both sides are tagged and summed in one exchange.
    """
    zero = F.lit(0)
    found = edges.select(key, F.col("trace").isNotNull().cast("int").alias("trace_present"), F.coalesce("trace.points_valid", F.lit(False)).cast("int").alias("trace_valid5"), F.lit(1).alias("pred_edges"), zero.alias("edge_groups"), zero.alias("edge_format_errors"))
    outputs = infos.select(key, zero.alias("trace_present"), zero.alias("trace_valid5"), zero.alias("pred_edges"), F.lit(1).alias("edge_groups"), F.col("format_error").isNotNull().cast("int").alias("edge_format_errors"))
    names = [c for c in outputs.columns if c != key]
    return found.unionByName(outputs).groupBy(key).agg(*(F.sum(c).alias(c) for c in names))


def trace_scores(pred: DataFrame, gold: DataFrame, key: str = "sample_id", edge: str = "edge_id") -> DataFrame:
    """Per sample: joined, unknown, valid traces, ends within 12 and 20 px and distance sums.

    pred: (key, edge, points or null); gold: (key, edge, points, source_box, target_box).
    """
    g = gold.select(key, edge, F.col("points").alias("gp"), "source_box", "target_box", F.lit(1).alias("in_g"))
    p = pred.select(key, edge, F.col("points").alias("pp"), F.lit(1).alias("in_p"))
    both = p.join(g, [key, edge], "full_outer")
    ok = F.col("in_g").isNotNull() & F.col("pp").isNotNull()
    start, end = G.point_box_distance(F.get("pp", F.lit(0)), "source_box"), G.point_box_distance(F.get("pp", F.lit(4)), "target_box")
    both = both.withColumns({"ok": ok, "d1": F.when(ok, start), "d2": F.when(ok, end), "l2": F.when(ok, G.aligned_l2("pp", "gp")), "ch": F.when(ok, G.chamfer("pp", "gp"))})
    return both.groupBy(key).agg(
        F.count("in_g").alias("gold_traces"), F.count("in_p").alias("pred_traces"), F.count_if(F.col("in_g").isNotNull() & F.col("in_p").isNotNull()).alias("joined"),
        F.count_if(F.col("in_g").isNull()).alias("unknown_ids"), F.count_if("ok").alias("valid5"), F.count_if(F.col("d1") <= 12).alias("start_within_12"),
        F.count_if(F.col("d2") <= 12).alias("end_within_12"), F.count_if((F.col("d1") <= 12) & (F.col("d2") <= 12)).alias("both_within_12"),
        F.count_if(F.col("d1") <= 20).alias("start_within_20"), F.count_if(F.col("d2") <= 20).alias("end_within_20"),
        F.coalesce(F.sum("l2"), F.lit(0.0)).alias("aligned_l2_sum"), F.coalesce(F.sum("ch"), F.lit(0.0)).alias("chamfer_sum"),
        (F.count("in_g") == F.count("in_p")).cast("int").alias("count_exact"), F.bool_and(F.col("in_g").isNotNull() & F.col("in_p").isNotNull()).cast("int").alias("id_set_exact"),
    )
