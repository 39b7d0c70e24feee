"""Graph documents: adjacency, reading order, serialisation, repair and multilinks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topoframe.functions import geometry as G
from topoframe.functions.geometry import path_length


def undirected(edges: DataFrame, both_ways: Column) -> DataFrame:
    """Edges and the reverse of those that run both ways; ``direction`` tells them apart."""
    back = edges.filter(both_ways).withColumns({"source": F.col("target"), "target": F.col("source")})
    return edges.withColumn("direction", F.lit("forward")).unionByName(back.withColumn("direction", F.lit("reverse")))


def adjacency(nodes: DataFrame, edges: DataFrame, graph: str, pos: str) -> DataFrame:
    """(graph, id, relations): out-edges in order; nodes without any keep an empty list, repeated edges stay."""
    one = F.struct(F.col(pos).alias("pos"), "source", "target", "type")
    rel = edges.groupBy(F.col(graph), F.col("source").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("r"))
    kept = F.transform("r", lambda x: F.struct(x["source"], x["target"], x["type"]))
    none = F.expr("cast(array() as array<struct<source:string,target:string,type:string>>)")
    return nodes.join(rel, [graph, "id"], "left").withColumn("relations", F.coalesce(kept, none)).drop("r")


def relations(graphs: DataFrame, graph: str) -> DataFrame:
    """Relation rows of nested nodes; null lists give none."""
    return graphs.select(graph, F.explode("nodes").alias("n")).select(graph, F.explode("n.relations").alias("r")).select(graph, "r.*")


def reading_order(nodes: DataFrame, graph: str, x1: str = "x1", y1: str = "y1", pos: str = "pos") -> DataFrame:
    """new_id n1, n2, ... by rows of 30 px, then x, then y, then the original position."""
    w = Window.partitionBy(graph).orderBy(F.floor(F.col(y1) / 30), x1, y1, pos)
    return nodes.withColumn("new_id", F.concat(F.lit("n"), F.row_number().over(w)))


def reverse_reasoning(edges: DataFrame, both_ways: Column, edge_id: str = "id", path: str = "path") -> DataFrame:
    back = edges.filter(both_ways).withColumns({edge_id: F.concat(F.col(edge_id), F.lit("_rev")), "source": F.col("target"), "target": F.col("source"), path: F.reverse(path)})
    return edges.unionByName(back)


def isolated(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """Nodes that are no end of any edge."""
    ends = edges.select(graph, F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(ends, [graph, "id"], "left_anti")


def nearest(nodes: DataFrame, graph: str, of: DataFrame | None = None, x: str = "cx", y: str = "cy", pos: str = "pos") -> DataFrame:
    """(graph, id, near_id, distance): each node's nearest other node in its graph, earliest on ties."""
    a = (nodes if of is None else of).select(graph, "id", F.col(x).alias("ax"), F.col(y).alias("ay"))
    b = nodes.select(graph, F.col("id").alias("near_id"), F.col(x).alias("bx"), F.col(y).alias("by"), F.col(pos).alias("bp"))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    pairs = a.join(b, graph).filter("id != near_id").withColumn("distance", d)
    return pairs.groupBy(graph, "id").agg(F.min(F.struct("distance", "bp", "near_id")).alias("m")).select(graph, "id", "m.near_id", "m.distance")


def multilink_offsets(edges: DataFrame, pair: list[str], order: list[str], gap: float = 13.0) -> DataFrame:
    """offset of parallel edges along their normal: (i - centre) * gap; 0 for a lone edge."""
    w = Window.partitionBy(*pair)
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    return edges.withColumn("offset", (i - (n - 1) / 2.0) * gap)


def lanes(edges: DataFrame, target: list[str], order: list[str], n: int = 5) -> DataFrame:
    return edges.withColumn("lane", (F.row_number().over(Window.partitionBy(*target).orderBy(*order)) - 1) % n)


def stagger(ends: DataFrame, slot: list[str], order: list[str], low: str, high: str, at: str, step: float = 12.0) -> DataFrame:
    """Ends on one side of a node spread by a step around their place, kept inside the side."""
    w = Window.partitionBy(*slot)
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    return ends.withColumn("at", F.greatest(F.col(low), F.least(F.col(high), F.col(at) + (i - (n - 1) / 2.0) * step)))


def interval_clusters(segments: DataFrame, bucket: list[str], lo: str, hi: str, pad: float = 4) -> DataFrame:
    """cluster: a new one starts where a segment doesn't overlap the one before it in its bucket; rank of its edge within."""
    w = Window.partitionBy(*bucket).orderBy(lo, hi, "edge")
    starts = F.when(F.col(lo) <= F.lag(hi).over(w) + pad, 0).otherwise(1)
    out = segments.withColumn("_s", starts).withColumn("cluster", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    return out.withColumn("rank", F.dense_rank().over(Window.partitionBy(*bucket, "cluster").orderBy("edge")))


def axis_shifts(edges: DataFrame, graph: str, gap: float = 10.0, pad: float = 4.0, straight: float = 2.0) -> DataFrame:
    """(graph, edge, dx, dy): how far edges move so that segments on a shared axis lie side by side.

    edges: (graph, edge, path of integer points). Nearly straight segments share an axis where their mean coordinate falls into one
    step of four; clusters are as in interval_clusters(). An edge moves once, by its place in the first cluster that holds
    it: axes in the order of their first segment, clusters along the axis. Edges that don't move are left out.
    """
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("seg"), F.get("path", i - 1).alias("p"), F.get("path", i).alias("q")))
    s = edges.filter(F.size("path") >= 2).select(graph, "edge", F.explode(steps).alias("s")).select(graph, "edge", "s.*")
    at = lambda c, i: F.get(c, F.lit(i)).cast("double")
    flat, upright = F.abs(at("p", 1) - at("q", 1)) <= straight, F.abs(at("p", 0) - at("q", 0)) <= straight
    s = s.withColumn("axis", F.when(flat, "h").when(upright, "v")).filter("axis is not null")
    along = lambda f: F.when(F.col("axis") == "h", f(at("p", 0), at("q", 0))).otherwise(f(at("p", 1), at("q", 1)))
    across = F.when(F.col("axis") == "h", at("p", 1) + at("q", 1)).otherwise(at("p", 0) + at("q", 0))
    s = s.select(graph, "edge", "seg", "axis", (F.bround(across / 4) * 4).alias("coord"), along(F.least).alias("lo"), along(F.greatest).alias("hi"))
    bucket = [graph, "axis", "coord"]
    s = s.withColumn("first", F.min(F.struct("edge", "seg")).over(Window.partitionBy(*bucket)))
    rows = interval_clusters(s, bucket, "lo", "hi", pad).groupBy(*bucket, "cluster").agg(F.first("first").alias("first"), F.array_sort(F.collect_set("edge")).alias("ids")).filter(F.size("ids") > 1)
    rows = rows.select(graph, "axis", "cluster", "first", F.size("ids").alias("n"), F.posexplode("ids").alias("k", "edge"))
    move = F.bround((F.col("k") - (F.col("n") - 1) / 2) * gap).cast("int")
    best = rows.withColumn("move", move).groupBy(graph, "edge").agg(F.min(F.struct("first", "cluster", "axis", "move")).alias("b"))
    return best.select(graph, "edge", F.when(F.col("b.axis") == "v", F.col("b.move")).otherwise(0).alias("dx"), F.when(F.col("b.axis") == "h", F.col("b.move")).otherwise(0).alias("dy"))


def multilink_types(edges: DataFrame, graph: str, roll: Column, level: str, pick: Column, types: tuple[str, ...] = ("power", "signal", "wire")) -> DataFrame:
    """(graph, source, target, type) of edges to add so that some pairs get parallel links.

    roll in [0, 1) decides per graph: none, light (one pair up to 2 links) or heavy (two edges' pairs up to 3), by difficulty. The
    edges that are chosen come first in the order of ``pick``; types that a pair lacks are taken in the given order.
    """
    light = {"simple": (0.0, 0.22), "medium": (0.03, 0.25)}
    low, high = F.lit(0.18), F.lit(0.55)
    for name, (a, b) in light.items():
        low, high = F.when(F.col(level) == name, a).otherwise(low), F.when(F.col(level) == name, b).otherwise(high)
    chosen = edges.withColumn("_want", F.when(roll < low, 3).when(roll < high, 2)).filter("_want is not null")
    chosen = chosen.withColumn("_r", F.row_number().over(Window.partitionBy(graph).orderBy(pick, "source", "target", "type"))).filter(F.col("_r") <= F.when(F.col("_want") == 3, 2).otherwise(1))
    pairs = chosen.groupBy(graph, "source", "target").agg(F.max("_want").alias("want"))
    have = edges.join(pairs, [graph, "source", "target"]).groupBy(graph, "source", "target", "want").agg(F.count("*").alias("n"), F.collect_set("type").alias("t"))
    missing = F.array_except(F.array(*map(F.lit, types)), "t")
    added = F.slice(missing, F.lit(1), F.greatest(F.lit(0), F.least(F.size(missing), (F.col("want") - F.col("n")).cast("int"))))
    return have.select(graph, "source", "target", F.explode(added).alias("type"))


def link_types(edges: DataFrame, graph: str, num: str, draw, most: int = 5) -> DataFrame:
    """edges with ``label``: the number, from 0, of the link type each gets among its graph's types, and ``labels``, how many there are.

    A graph has as many types as edges up to two, else a drawn number of three to ``most``, and at least as many as parallel edges
    of a pair up to ``most``. Parallel edges get different types, from a drawn one on; other edges a drawn one each.
    draw(salt, columns) gives a whole number from 0 for integer columns.
    """
    w, pair = Window.partitionBy(graph), Window.partitionBy(graph, "source", "target")
    out = edges.withColumns({"_n": F.count("*").over(w), "_p": F.count("*").over(pair), "_i": F.row_number().over(pair.orderBy(num)) - 1, "_f": F.min(num).over(pair)})
    out = out.withColumn("_m", F.max("_p").over(w))
    top = F.least(F.col("_n"), F.lit(most))
    low = F.greatest(F.lit(3), F.least(top, F.col("_m")))
    labels = F.when(top <= 2, top).otherwise(low + draw(1, [graph]) % (top - low + 1))
    out = out.withColumn("labels", labels.cast("int"))
    parallel = (F.col("_p") > 1) & (F.col("_i") < F.col("labels"))
    label = F.when(parallel, (draw(2, [graph, "_f"]) + F.col("_i")) % F.col("labels")).otherwise(draw(3, [graph, num]) % F.col("labels"))
    return out.withColumn("label", label.cast("int")).drop("_n", "_p", "_i", "_f", "_m")


def reversed_edges(edges: DataFrame, nodes: DataFrame, graph: str, drawn: Column, path: str = "path") -> DataFrame:
    """Edges, those that are drawn turned round with their paths; none out of a start or split, none into an end or merge. nodes: (graph, id, role)."""
    role = lambda end: nodes.select(graph, F.col("id").alias(end), F.col("role").alias(f"_{end}"))
    found = edges.join(role("source"), [graph, "source"], "left").join(role("target"), [graph, "target"], "left")
    kept = F.coalesce(F.col("_source").isin("start", "split"), F.lit(False)) | F.coalesce(F.col("_target").isin("end", "merge"), F.lit(False))
    turned = found.withColumn("_turn", ~kept & F.coalesce(drawn, F.lit(False)))
    flip = lambda a, b: F.when(F.col("_turn"), F.col(b)).otherwise(F.col(a))
    new = {"source": flip("source", "target"), "target": flip("target", "source"), path: F.when(F.col("_turn"), F.reverse(path)).otherwise(F.col(path))}
    return turned.select(*(new[c].alias(c) if c in new else F.col(c) for c in edges.columns))


def valid_graphs(nodes: DataFrame, edges: DataFrame, negatives: DataFrame, graph: str, margin: float = 8) -> DataFrame:
    """(graph, valid): every node has an asset, no two boxes come within the margin, all ends are nodes, and directed edges have room for a head.

    nodes: (graph, id, box, asset); edges: (graph, source, target, type, path); negatives: (graph, source, target). Boxes are compared
    along one axis after sorting a graph's nodes, inside one row per graph.
    """
    boxes = F.array_sort(F.collect_list("box"))
    pairs = F.exists("boxes", lambda x: F.size(F.filter("boxes", lambda y: G.boxes_overlap(x, y, margin))) > 1)
    own = nodes.groupBy(graph).agg(F.bool_and(F.col("asset").isNotNull()).alias("assets"), boxes.alias("boxes"), F.collect_set("id").alias("ids"))
    bare = (F.col("type") == "directed") & (F.size(G.arrowhead(G.visible_path("path"))) == 0)
    ends = edges.select(graph, "source", "target", F.coalesce(bare, F.lit(False)).alias("bare")).unionByName(negatives.select(graph, "source", "target", F.lit(False).alias("bare")))
    used = ends.groupBy(graph).agg(F.array_union(F.collect_set("source"), F.collect_set("target")).alias("used"), F.bool_or("bare").alias("bare"))
    known = F.size(F.array_except(F.coalesce("used", F.expr("cast(array() as array<string>)")), "ids")) == 0
    return own.join(used, graph, "left").select(graph, (F.col("assets") & ~pairs & known & ~F.coalesce("bare", F.lit(False))).alias("valid"))


def edge_records(edges: DataFrame, scale: float = 0.9, clearance: float = 12) -> DataFrame:
    """Edges as records of an annotation: trimmed path, its start, middle and end, arrow and heads, all points scaled. edges: (..., type, path)."""
    shown = G.visible_path("path", clearance)
    out = edges.withColumn("_v", shown)
    points = lambda c: F.transform(c, lambda p: G.scale(p, scale))
    none = F.expr("cast(array() as array<array<int>>)")
    to, both = F.col("type").isin("directed", "bidirectional"), F.col("type") == "bidirectional"
    end = G.scale(F.get("_v", F.size("_v") - 1), scale)
    heads = F.struct(F.when(to, points(G.arrowhead("_v"))).otherwise(none).alias("target"), F.when(both, points(G.arrowhead(F.reverse("_v")))).otherwise(none).alias("source"))
    columns = {"path": points("path"), "visible_path": points("_v"), "start": G.scale(F.get("_v", F.lit(0)), scale), "mid": G.scale(G.midpoint("_v"), scale), "end": end, "arrow": F.when(to, end), "arrowheads": heads}
    return out.withColumns(columns).drop("_v")


def node_records(nodes: DataFrame, scale: float = 0.9) -> DataFrame:
    """Nodes as records of an annotation: boxes and centre scaled, the asset by its file name. nodes: (..., box, image_box, text_box, asset)."""
    scaled = lambda c: F.when(F.col(c).isNotNull(), G.scale(c, scale))
    file = F.substring_index("asset", "/", -1)
    return nodes.withColumns({"center": G.scale(G.box_center("box"), scale), "box": G.scale("box", scale), "image_box": scaled("image_box"), "text_box": scaled("text_box"), "asset": file})


def first_edges(edges: DataFrame, graph: str, pos: str, ordered: bool = False, by_type: bool = False) -> DataFrame:
    """The first edge of each (un)ordered pair, or pair and type."""
    ends = ["source", "target"] if ordered else [F.least("source", "target"), F.greatest("source", "target")]
    w = Window.partitionBy(graph, *ends, *(["type"] if by_type else [])).orderBy(pos)
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def hubs(nodes: DataFrame, graph: str, x: str = "cx", y: str = "cy", pos: str = "pos") -> DataFrame:
    """(graph, hub): the node closest to the centroid by city blocks."""
    w = Window.partitionBy(graph)
    d = F.abs(F.col(x) - F.avg(x).over(w)) + F.abs(F.col(y) - F.avg(y).over(w))
    return nodes.withColumn("_d", F.round(d, 9)).groupBy(graph).agg(F.min_by("id", F.struct("_d", pos)).alias("hub"))


def tiers(nodes: DataFrame, graph: str, x: str = "cx", width: float = 100.0, most: int = 3) -> DataFrame:
    """tier from 0: columns of a width in order, the last ones merged."""
    rank = F.dense_rank().over(Window.partitionBy(graph).orderBy(F.bround(F.col(x) / width)))
    return nodes.withColumn("tier", F.least(rank - 1, F.lit(most - 1)))


def graph_summary(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """Per graph: counts, sorted distinct types, and whether some pair has several edges."""
    pairs = edges.groupBy(graph, "source", "target").agg(F.count("*").alias("c"), F.collect_set("type").alias("t"))
    e = pairs.groupBy(graph).agg(F.sum("c").alias("edges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("edge_types"), (F.max("c") > 1).alias("multi_link"))
    return nodes.groupBy(graph).agg(F.count("*").alias("nodes")).join(e, graph, "left")


def _list(c: Column) -> Column:
    """[1, 2] with a comma and a space; None for null."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: v.cast("string")), ", "), F.lit("]")), F.lit("None"))


def think_graph(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """(graph, think_graph): nodes, then each node's traces and edges as tags.

    nodes: id, name, box, num; edges: source, target, type, start, mid, end, arrow, num. Values are not escaped.
    """
    n = nodes.withColumn("tag", F.concat(F.lit('<NODE id="'), "id", F.lit('" name="'), "name", F.lit('" box="'), _list(F.col("box")), F.lit('"/>')))
    part = lambda k: F.concat(F.lit(f' {k}="'), _list(F.col(k)), F.lit('"'))
    ends = F.concat(F.lit(' source="'), "source", F.lit('" target="'), "target", F.lit('"'))
    e = edges.withColumn("tag", F.concat(F.lit("<TRACE"), ends, part("start"), part("mid"), part("end"), part("arrow"), F.lit("/>\n<EDGE"), ends, F.lit(' type="'), "type", F.lit('"/>')))
    per = e.groupBy(graph, F.col("source").alias("id")).agg(F.array_sort(F.collect_list(F.struct("num", "tag"))).alias("e"))
    block = F.concat(F.lit('<CHECK_NODE id="'), "id", F.lit('" name="'), "name", F.lit('">'), F.coalesce(F.concat(F.lit("\n"), F.array_join(F.transform("e", lambda x: x["tag"]), "\n")), F.lit("")), F.lit("\n</CHECK_NODE>"))
    rows = n.join(per, [graph, "id"], "left").withColumn("block", block)
    whole = rows.groupBy(graph).agg(F.array_sort(F.collect_list(F.struct("num", "tag", "block"))).alias("r"))
    text = F.concat(F.lit("<NODES>\n"), F.array_join(F.transform("r", lambda x: x["tag"]), "\n"), F.lit("\n</NODES>\n<THINK_GRAPH>\n"), F.array_join(F.transform("r", lambda x: x["block"]), "\n"), F.lit("\n</THINK_GRAPH>"))
    return whole.select(graph, text.alias("think_graph"))


def repair_isolated(nodes: DataFrame, edges: DataFrame, graph: str, kind: str = "directed") -> DataFrame:
    """Edges and one more for each node without any, from or to its nearest node, earlier position first; two such nodes that are nearest to each other share one."""
    pos = nodes.select(graph, "id", "pos")
    near = nearest(nodes, graph, of=isolated(nodes, edges, graph))
    near = near.join(pos.withColumnRenamed("pos", "p1"), [graph, "id"]).join(pos.select(graph, F.col("id").alias("near_id"), F.col("pos").alias("p2")), [graph, "near_id"])
    first = F.col("p1") < F.col("p2")
    added = near.select(graph, F.when(first, F.col("id")).otherwise(F.col("near_id")).alias("source"), F.when(first, F.col("near_id")).otherwise(F.col("id")).alias("target"), F.lit(kind).alias("type")).distinct()
    return edges.select(graph, "source", "target", "type").unionAll(added)


def type_budget(edges: DataFrame, graph: str, kind: str, share: float, order: list[str]) -> DataFrame:
    """Of one type at most a share of a graph's edges, the first ones in order; other types stay."""
    n = F.count("*").over(Window.partitionBy(graph))
    rank = F.row_number().over(Window.partitionBy(graph, "type").orderBy(*order))
    return edges.withColumns({"_n": n, "_r": rank}).filter((F.col("type") != kind) | (F.col("_r") <= F.floor(F.col("_n") * share))).drop("_n", "_r")


def long_enough(edges: DataFrame, path: str = "path", least: float = 35.0) -> DataFrame:
    return edges.filter(path_length(path) >= least)


def training_text(think: Column, final_json: Column) -> Column:
    """think, a blank line, then the final graph indented by two in its tags; the layout needs Python's writer."""
    @F.pandas_udf("string")
    def indented(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=2))

    return F.concat(think, F.lit("\n\n<FINAL_GRAPH>\n"), indented(final_json), F.lit("\n</FINAL_GRAPH>"))
