"""Violations of annotation documents as rows (path, rule, detail)."""

from __future__ import annotations

import json as json_text
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that a document and its parts must have.
TOP_KEYS = ["sample_id", "image", "split", "difficulty", "orientation", "canvas", "nodes", "edges", "negative_edges", "final_graph", "think_graph", "training_text", "render_style", "generation"]
NODE_KEYS = ["id", "name", "box", "center", "image_box", "text_box", "asset"]
EDGE_KEYS = ["id", "source", "source_name", "target", "target_name", "type", "path", "visible_path", "start", "mid", "end", "arrow", "arrowheads"]
NEGATIVE_KEYS = ["source", "source_name", "target", "target_name", "reason", "evidence_point"]
RELATION_KEYS = ["source", "source_name", "target", "target_name", "type"]


def key_violations(docs: DataFrame, keys: list[str], json: str = "json", path: str = "path") -> DataFrame:
    """Missing and extra keys of a JSON object per row; text that is no object breaks one rule."""
    found = F.json_object_keys(F.col(json))
    want = F.array(*map(F.lit, keys))
    tagged = lambda rule, xs: F.transform(xs, lambda x: F.struct(F.lit(rule).alias("rule"), x.alias("detail")))
    bad = F.when(found.isNull(), F.array(F.struct(F.lit("not_an_object").alias("rule"), F.lit("").alias("detail")))).otherwise(
        F.concat(tagged("missing_key", F.array_except(want, found)), tagged("extra_key", F.array_except(found, want)))
    )
    return docs.select(path, F.explode(bad).alias("v")).select(path, "v.rule", "v.detail")


def integers(values: Column, size: int) -> Column:
    """Whether a list of JSON texts holds ``size`` integers."""
    return (F.size(values) == size) & F.forall(values, lambda v: v.rlike(r"^-?\d+$"))


def endpoint_violations(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """Edge ends that are no node, and nodes that are no end."""
    ends = edges.select(graph, F.explode(F.array("source", "target")).alias("id")).distinct()
    unknown = ends.join(nodes.select(graph, "id"), [graph, "id"], "left_anti").withColumn("rule", F.lit("unknown_endpoint"))
    lonely = nodes.select(graph, "id").join(ends, [graph, "id"], "left_anti").withColumn("rule", F.lit("isolated_node"))
    return unknown.unionByName(lonely).select(graph, "rule", F.col("id").alias("detail"))


def document_violations(docs: DataFrame, path: str = "path") -> DataFrame:
    """Canvas, lists and final graph of parsed documents (canvas, nodes, edges, final_graph, think_graph, training_text)."""
    rules = {
        "canvas_not_positive": ~F.coalesce((F.col("canvas.width") > 0) & (F.col("canvas.height") > 0), F.lit(False)),
        "no_nodes": F.coalesce(F.size("nodes"), F.lit(0)) <= 0,
        "edges_not_a_list": F.col("edges").isNull(),
        "final_graph_node_count": ~F.coalesce(F.size("final_graph.nodes") == F.size("nodes"), F.lit(False)),
        "training_text_start": ~F.coalesce(F.col("training_text").startswith(F.concat("think_graph", F.lit("\n\n<FINAL_GRAPH>\n"))), F.lit(False)),
    }
    found = F.array_compact(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in rules.items())))
    return docs.select(path, F.explode(found).alias("rule")).withColumn("detail", F.lit(""))


def cardinality(counts: DataFrame, n: str, expected: Column | int) -> DataFrame:
    """Groups whose count is not the expected one."""
    return counts.filter(F.col(n) != expected)


def checksum_violations(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """(path, rule): inventory entries without a file, or whose content's sha256 differs. files: path, content."""
    have = files.select("path", F.sha2("content", 256).alias("have"))
    got = inventory.join(have, "path", "left")
    rule = F.when(F.col("have").isNull(), "missing_file").when(F.col("have") != F.col("sha256"), "digest_differs")
    return got.withColumn("rule", rule).filter("rule is not null").select("path", "rule")


def _inside(value: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{key}", kind)


def _ints(value: Column, size: int) -> Column:
    """Whether a JSON value is a list of so many whole numbers."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce((F.size(items) == size) & F.forall(items, lambda x: F.schema_of_variant(x).isin("BIGINT", "BOOLEAN")), F.lit(False))


def _present(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def _flag(bad: Column, place: Column | str, rule: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct((F.lit(place) if isinstance(place, str) else place).alias("place"), F.lit(rule).alias("rule")))


def _lacks(value: Column, keys: list[str], place: Column | str) -> Column:
    have = F.coalesce(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), F.expr("cast(array() as array<string>)"))
    lost = F.array_sort(F.array_except(F.array(*map(F.lit, keys)), have))
    return F.when(F.size(lost) > 0, F.struct((F.lit(place) if isinstance(place, str) else place).alias("place"), F.concat(F.lit("missing keys "), F.array_join(lost, ", ")).alias("rule")))


def _each(doc: Column, key: str, rules: Callable[[Column, Column], list[Column]]) -> Column:
    """The violations of every element of a list, with places key[1], key[2], ..."""
    items = F.coalesce(_inside(doc, key, "array<variant>"), F.expr("cast(array() as array<variant>)"))
    return F.flatten(F.transform(items, lambda x, i: F.array_compact(F.array(*rules(x, F.concat(F.lit(f"{key}["), i + 1, F.lit("]")))))))


def _whole_text(value: str | None) -> bool | None:
    """Whether training_text is think_graph and the final graph, indented by two, in its tags. None for text that is no JSON object."""
    try:
        doc = json_text.loads(value or "")
        return doc["training_text"] == doc["think_graph"] + "\n\n<FINAL_GRAPH>\n" + json_text.dumps(doc["final_graph"], indent=2) + "\n</FINAL_GRAPH>"
    except (ValueError, KeyError, TypeError):
        return None


@F.pandas_udf(T.BooleanType())
def _text_agrees(values: pd.Series) -> pd.Series:
    return values.map(_whole_text)


def annotation_violations(docs: DataFrame, json: str = "json", path: str = "path", strict: bool = False) -> DataFrame:
    """(path, place, rule) of every violation in JSON annotations: keys at all levels, integer points and boxes, lists of points,
    ends that are nodes, isolated nodes, heads, and the texts.

    Values keep their JSON types: 1.0 and "1" are no integers. A text that is no object breaks one rule. ``strict`` also reports extra
    keys at the top. Only the comparison of the whole training text, which depends on the order of keys, runs in Python.
    """
    d = F.col("_doc")
    kind = lambda key: F.coalesce(F.schema_of_variant(_inside(d, key)), F.lit(""))
    positive = lambda key: F.coalesce((F.schema_of_variant(F.try_variant_get(d, f"$.canvas.{key}", "variant")) == "BIGINT") & (F.try_variant_get(d, f"$.canvas.{key}", "bigint") > 0), F.lit(False))
    count = lambda key: F.size(_inside(d, key, "array<variant>"))
    text = lambda key, tag: ~F.coalesce((kind(key) == "STRING") & F.contains(_inside(d, key, "string"), F.lit(tag)), F.lit(False))
    nodes, edges = (F.coalesce(_inside(d, k, "array<variant>"), F.expr("cast(array() as array<variant>)")) for k in ("nodes", "edges"))
    ids = F.array_distinct(F.transform(nodes, lambda x: _inside(x, "id", "string")))
    linked = F.flatten(F.transform(edges, lambda x: F.array(_inside(x, "source", "string"), _inside(x, "target", "string"))))
    lonely = F.array_sort(F.array_except(ids, linked))

    def points(x: Column, key: str, place: Column) -> Column:
        items = _inside(x, key, "array<variant>")
        good = F.coalesce((F.size(items) >= 2) & F.forall(items, lambda p: _ints(p, 2)), F.lit(False))
        return _flag(~good, F.concat(place, F.lit(f".{key}")), "expected list of points")

    at = lambda place, key: F.concat(place, F.lit(f".{key}"))
    node = lambda x, p: [
        _lacks(x, NODE_KEYS, p), _flag(~_ints(_inside(x, "box"), 4), at(p, "box"), "expected 4 ints"), _flag(~_ints(_inside(x, "center"), 2), at(p, "center"), "expected 2 ints"),
        _flag(_present(_inside(x, "image_box")) & ~_ints(_inside(x, "image_box"), 4), at(p, "image_box"), "expected 4 ints or null"), _flag(~_ints(_inside(x, "text_box"), 4), at(p, "text_box"), "expected 4 ints"),
    ]
    known = lambda x, end: F.array_contains(ids, _inside(x, end, "string"))
    heads = lambda x: F.array_sort(F.map_keys(_inside(x, "arrowheads", "map<string,variant>")))
    edge = lambda x, p: [
        _lacks(x, EDGE_KEYS, p), _flag(~F.coalesce(known(x, "source") & known(x, "target"), F.lit(False)), p, "source/target not in nodes"), points(x, "path", p), points(x, "visible_path", p),
        *(_flag(~_ints(_inside(x, k), 2), at(p, k), "expected point") for k in ("start", "mid", "end")), _flag(_present(_inside(x, "arrow")) & ~_ints(_inside(x, "arrow"), 2), at(p, "arrow"), "expected point or null"),
        _flag(~F.coalesce(heads(x) == F.array(F.lit("source"), F.lit("target")), F.lit(False)), at(p, "arrowheads"), "expected source/target keys"),
    ]
    negative = lambda x, p: [_lacks(x, NEGATIVE_KEYS, p), _flag(~_ints(_inside(x, "evidence_point"), 2), at(p, "evidence_point"), "expected point")]
    graph_nodes = F.coalesce(F.try_variant_get(d, "$.final_graph.nodes", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    none = F.expr("cast(array() as array<variant>)")
    relations = F.flatten(F.transform(graph_nodes, lambda x, i: F.array_compact(F.transform(F.coalesce(_inside(x, "relations", "array<variant>"), none), lambda r: _lacks(r, RELATION_KEYS, F.concat(F.lit("final_graph.nodes["), i + 1, F.lit("].relations")))))))
    have = F.map_keys(F.try_variant_get(d, "$", "map<string,variant>"))
    extra = F.array_sort(F.array_except(have, F.array(*map(F.lit, TOP_KEYS))))
    whole = F.array_compact(F.array(
        _lacks(d, TOP_KEYS, "top_level"),
        F.when(F.lit(strict) & (F.size(extra) > 0), F.struct(F.lit("top_level").alias("place"), F.concat(F.lit("extra keys "), F.array_join(extra, ", ")).alias("rule"))),
        _flag(~(positive("width") & positive("height")), "canvas", "expected positive integer width/height"), _flag(F.coalesce(count("nodes"), F.lit(0)) <= 0, "nodes", "expected non-empty list"),
        _flag(_inside(d, "edges", "array<variant>").isNull(), "edges", "expected list"), _flag(_inside(d, "negative_edges", "array<variant>").isNull(), "negative_edges", "expected list"),
        _flag(_inside(d, "final_graph", "map<string,variant>").isNull(), "final_graph", "expected object"), _flag(text("think_graph", "<THINK_GRAPH>"), "think_graph", "missing <THINK_GRAPH>"),
        _flag(text("training_text", "<FINAL_GRAPH>"), "training_text", "missing <FINAL_GRAPH>"), F.when(F.size(lonely) > 0, F.struct(F.lit("nodes").alias("place"), F.concat(F.lit("isolated nodes "), F.array_join(lonely, ", ")).alias("rule"))),
        _flag(F.size(graph_nodes) != F.size(nodes), "final_graph.nodes", "length differs from nodes"), _flag(~F.coalesce(F.col("_agrees"), F.lit(False)), "training_text", "does not match think_graph and final_graph"),
    ))
    found = F.concat(whole, _each(d, "nodes", node), _each(d, "edges", edge), _each(d, "negative_edges", negative), relations)
    broken = F.array(F.struct(F.lit("top_level").alias("place"), F.lit("not an object").alias("rule")))
    rows = docs.select(F.col(path).alias("path"), F.try_parse_json(json).alias("_doc"), _text_agrees(json).alias("_agrees"))
    return rows.select("path", F.explode(F.when(have.isNull(), broken).otherwise(found)).alias("v")).select("path", "v.place", "v.rule")
