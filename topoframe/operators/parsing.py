"""Model output text to node, edge and trace rows, with parse diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topoframe.functions import text as X


def _body(text: Column, tag: str) -> Column:
    """Inside of a tag whose close may be missing."""
    return F.regexp_extract(text, rf"(?s)<{tag}>\s*(.*?)\s*(?:</{tag}>|$)", 1)


def nodes(texts: DataFrame, key: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(key, pos, id, name, box): first tag of an id wins; tags without id or name go."""
    t = F.col(text_col)
    body = F.when(t.contains("<NODES>"), _body(t, "NODES")).otherwise(t)
    tags = texts.select(key, F.posexplode(X.groups(body, X.NODE_TAG, 1)).alias("pos", "tag")).withColumn("a", X.parse_attrs("tag"))
    named = tags.select(key, "pos", F.col("a")["id"].alias("id"), F.col("a")["name"].alias("name"), X.parse_box(F.col("a")["box"]).alias("box")).filter("id != '' and name != ''")
    first = Window.partitionBy(key, "id").orderBy("pos")
    return named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def node_status(texts: DataFrame, key: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(key, n_nodes, status): null, recovered_missing_nodes_tag or missing_nodes_tag."""
    counts = nodes(texts, key, text_col).groupBy(key).agg(F.count("*").alias("n_nodes"))
    n = F.coalesce("n_nodes", F.lit(0).cast("long"))
    status = F.when(n == 0, "missing_nodes_tag").when(~F.col(text_col).contains("<NODES>"), "recovered_missing_nodes_tag")
    return texts.join(counts, key, "left").select(key, n.alias("n_nodes"), status.alias("status"))


def edges(texts: DataFrame, key: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(key, block, pos, source, source_name, target, target_name, type, trace): a trace belongs to the edge right after it if their targets agree."""
    graph = _body(F.col(text_col), "EDGE_GRAPH")
    found = texts.filter(F.col(text_col).contains("<EDGE_GRAPH>")).select(key, graph.alias("g"))
    heads, bodies = X.groups("g", X.BLOCK, 1), X.groups("g", X.BLOCK, 2)
    blocks = found.select(key, F.posexplode(F.arrays_zip(heads.alias("head"), bodies.alias("body"))).alias("block", "b"))
    blocks = blocks.select(key, "block", X.parse_attrs("b.head")["id"].alias("owner"), F.col("b.body").alias("body"))
    kinds, frags = X.groups("body", X.LINK_TAG, 1), X.groups("body", X.LINK_TAG, 2)
    tags = blocks.select(key, "block", "owner", F.posexplode(F.arrays_zip(kinds.alias("kind"), frags.alias("frag"))).alias("pos", "t"))
    tags = tags.select(key, "block", "pos", "owner", F.col("t.kind").alias("kind"), X.parse_attrs("t.frag").alias("a"))
    a = F.col("a")
    points = X.parse_points(F.coalesce(a["points"], F.lit("")))
    trace = F.struct(F.coalesce(a["target"], F.lit("")).alias("target"), points.alias("points"), points.isNotNull().alias("points_valid"), X.arrow_kind(a).alias("arrow_kind"))
    order = Window.partitionBy(key, "block").orderBy("pos")
    prev = F.lag(F.when(F.col("kind") == "TRACE", trace)).over(order)
    linked = tags.withColumn("prev", prev).filter("kind = 'EDGE'")
    out = linked.select(
        key, "block", "pos", F.coalesce(F.nullif(a["source"], F.lit("")), F.col("owner")).alias("source"), F.coalesce(a["source_name"], F.lit("")).alias("source_name"),
        a["target"].alias("target"), F.coalesce(a["target_name"], F.lit("")).alias("target_name"), a["type"].alias("type"), F.when(F.col("prev.target") == a["target"], F.col("prev")).alias("trace"),
    )
    return out.filter("source != '' and target != '' and type != ''")


def edge_info(texts: DataFrame, key: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(key, has_open, has_close, num_trace_tags, num_check_nodes, format_error)."""
    t = F.col(text_col)
    graph = F.when(t.contains("<EDGE_GRAPH>"), _body(t, "EDGE_GRAPH")).otherwise("")
    blocks = X.groups(graph, X.BLOCK, 2)
    traces = F.aggregate(blocks, F.lit(0), lambda s, b: s + F.size(F.filter(X.groups(b, X.LINK_TAG, 1), lambda k: k == "TRACE")))
    has_open, has_close = t.contains("<EDGE_GRAPH>"), t.contains("</EDGE_GRAPH>")
    error = F.when(~has_open, "missing_edge_graph").when(~has_close, "missing_edge_graph_close")
    return texts.select(key, has_open.alias("has_open"), has_close.alias("has_close"), traces.alias("num_trace_tags"), F.size(blocks).alias("num_check_nodes"), error.alias("format_error"))


def traces(texts: DataFrame, key: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(key, edge_id, points): the first tag of an id occupies it even if its points are invalid (null)."""
    tags = texts.select(key, F.posexplode(X.groups(text_col, X.TRACE_TAG, 1)).alias("pos", "tag")).withColumn("a", X.parse_attrs("tag"))
    rows = tags.select(key, "pos", F.col("a")["edge_id"].alias("edge_id"), X.parse_points(F.coalesce(F.col("a")["points"], F.lit("")), exact=False).alias("points")).filter("edge_id != ''")
    first = Window.partitionBy(key, "edge_id").orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "pos")


def trace_info(texts: DataFrame, key: str = "sample_id", text_col: str = "text") -> DataFrame:
    """(key, raw_traces, duplicate_ids, opened, closed)."""
    t = F.col(text_col)
    ids = F.filter(F.transform(X.groups(t, X.TRACE_TAG, 1), lambda f: X.parse_attrs(f)["edge_id"]), lambda i: F.coalesce(i != "", F.lit(False)))
    return texts.select(key, F.size(X.groups(t, X.TRACE_TAG, 1)).alias("raw_traces"), (F.size(ids) - F.size(F.array_distinct(ids))).alias("duplicate_ids"), t.contains("<TRACES>").alias("opened"), t.contains("</TRACES>").alias("closed"))
