"""Annotation documents, routes, link policies and joins of curated rows."""

from __future__ import annotations

import copy
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topoframe.functions import geometry as G
from topoframe.operators import curation, graph, matching, reports, scoring, validation

from . import views as V
from .registry import query
from .text_queries import graph_texts

_TURN = 1 << 31


def _hash_sql(x: str) -> str:
    return f"((({x}) % {_TURN}) * 2654435761 % 4294967296)"


# --- documents with one fault each


def _document() -> dict:
    node = lambda i: {"id": f"n{i}", "name": f"Node {i}", "box": [10 * i, 0, 10 * i + 8, 8], "center": [10 * i + 4, 4], "image_box": None, "text_box": [10 * i, 0, 10 * i + 8, 8], "asset": "a.png"}
    ends = {"source": "n1", "source_name": "Node 1", "target": "n2", "target_name": "Node 2"}
    edge = {"id": "e1", **ends, "type": "directed", "path": [[14, 4], [24, 4]], "visible_path": [[15, 4], [23, 4]], "start": [15, 4], "mid": [19, 4], "end": [23, 4], "arrow": [23, 4], "arrowheads": {"target": [[23, 4]], "source": []}}
    return {
        "sample_id": "s", "image": "s.png", "split": "train", "difficulty": "simple", "orientation": "left_to_right", "canvas": {"width": 1200, "height": 800}, "nodes": [node(1), node(2)], "edges": [edge],
        "negative_edges": [{**ends, "reason": "near_miss", "evidence_point": [3, 4]}], "final_graph": {"nodes": [{"id": "n1", "relations": [{**ends, "type": "directed"}]}, {"id": "n2", "relations": []}]},
        "think_graph": "<THINK_GRAPH>\né\n</THINK_GRAPH>", "training_text": "", "render_style": {}, "generation": {"seed": 1},
    }


#: (change of the document, violations as place and rule); the training text is written after the change, or before it where the third is True.
_FAULTS: list[tuple] = [
    (lambda d: None, [], False),
    (lambda d: d["nodes"][0].update(box=[1.0, 2, 3, 4]), [("nodes[1].box", "expected 4 ints")], False),
    (lambda d: d["nodes"][1].update(center=[1, 2, 3]), [("nodes[2].center", "expected 2 ints")], False),
    (lambda d: d["nodes"][0].update(image_box="x", text_box=None), [("nodes[1].image_box", "expected 4 ints or null"), ("nodes[1].text_box", "expected 4 ints")], False),
    (lambda d: [d["nodes"][0].pop(k) for k in ("name", "asset")], [("nodes[1]", "missing keys asset, name")], False),
    (lambda d: d["edges"][0].update(source="n9"), [("edges[1]", "source/target not in nodes"), ("nodes", "isolated nodes n1")], False),
    (lambda d: d["edges"][0].update(path=[[1, 2]], visible_path=[[1, 2], ["3", 4]]), [("edges[1].path", "expected list of points"), ("edges[1].visible_path", "expected list of points")], False),
    (lambda d: d["edges"][0].update(arrowheads={"target": []}, arrow=[1]), [("edges[1].arrowheads", "expected source/target keys"), ("edges[1].arrow", "expected point or null")], False),
    (lambda d: d["canvas"].update(width=0), [("canvas", "expected positive integer width/height")], False),
    (lambda d: d["final_graph"]["nodes"].pop(), [("final_graph.nodes", "length differs from nodes")], False),
    (lambda d: d["final_graph"]["nodes"][0]["relations"][0].pop("type"), [("final_graph.nodes[1].relations", "missing keys type")], False),
    (lambda d: d["final_graph"].update(more=1), [("training_text", "does not match think_graph and final_graph")], True),
    (lambda d: d["negative_edges"][0].update(evidence_point="1,2"), [("negative_edges[1].evidence_point", "expected point")], False),
    (lambda d: d.update(extra=1), [("top_level", "extra keys extra")], False),
    (lambda d: d.update(think_graph="none"), [("think_graph", "missing <THINK_GRAPH>")], False),
    (None, [("top_level", "not an object")], False),
    (lambda d: d.pop("edges"), [("top_level", "missing keys edges"), ("edges", "expected list"), ("nodes", "isolated nodes n1, n2")], False),
    (lambda d: d["edges"][0].update(arrow=None, start=[1.5, 2]), [("edges[1].start", "expected point")], False),
]


def _texts() -> list[str]:
    out = []
    for change, _, before in _FAULTS:
        d = _document()
        told = copy.deepcopy(d)
        if change is not None:
            change(d)
        told = told if before else d
        d["training_text"] = told["think_graph"] + "\n\n<FINAL_GRAPH>\n" + json.dumps(told["final_graph"], indent=2) + "\n</FINAL_GRAPH>"
        out.append("[1]" if change is None else json.dumps(d))
    return out


_EXPECTED = ", ".join(f"({k}, '{place}', '{rule}')" for k, (_, found, _) in enumerate(_FAULTS) for place, rule in found)


@query(f"SELECT 'v' || vec_id AS path, place, rule FROM embeddings JOIN (VALUES {_EXPECTED}) t(k, place, rule) ON vec_id % {len(_FAULTS)} = k")
def annotation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*map(F.lit, _texts()))
    docs = V.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("path"), F.get(texts, (F.col("vec_id") % len(_FAULTS)).cast("int")).alias("json"))
    return validation.annotation_violations(docs, strict=True)


# --- routes between neighbouring nodes


def _boundary_sql(b: str, tx: str, ty: str) -> str:
    """A struct (t, k, x, y) of the first hit, or null; b names a row with x1, y1, x2, y2, cx, cy."""
    hit = lambda k, wall, c, o, t, u, lo, hi, x, y: f"CASE WHEN {t} <> {b}.{c} AND ({b}.{wall} - {b}.{c}) / ({t} - {b}.{c}) > 0 AND {b}.{o} + ({b}.{wall} - {b}.{c}) / ({t} - {b}.{c}) * ({u} - {b}.{o}) BETWEEN {b}.{lo} AND {b}.{hi} THEN {{'t': ({b}.{wall} - {b}.{c}) / ({t} - {b}.{c}), 'k': {k}, 'x': round_even({x}, 0), 'y': round_even({y}, 0)}} END"
    ray = lambda wall, c, o, t, u: f"{b}.{o} + ({b}.{wall} - {b}.{c}) / ({t} - {b}.{c}) * ({u} - {b}.{o})"
    across = [hit(k, w, "cx", "cy", tx, ty, "y1", "y2", f"{b}.{w}", ray(w, "cx", "cy", tx, ty)) for k, w in ((0, "x1"), (1, "x2"))]
    upright = [hit(k, w, "cy", "cx", ty, tx, "x1", "x2", ray(w, "cy", "cx", ty, tx), f"{b}.{w}") for k, w in ((2, "y1"), (3, "y2"))]
    return f"list_sort(list_filter([{', '.join(across + upright)}], lambda v: v IS NOT NULL))[1]"


def _moved_sql(px: str, py: str, tx: str, ty: str, axis: str) -> str:
    p, t = (px, tx) if axis == "x" else (py, ty)
    d = f"sqrt(pow({tx} - {px}, 2) + pow({ty} - {py}, 2))"
    return f"CASE WHEN {d} = 0 THEN {p} ELSE round_even({p} + ({t} - {p}) / {d} * 12, 0) END"


_ROUTES = f"""{V.NODES}, c AS (SELECT *, floor((x1 + x2) / 2) AS cx, floor((y1 + y2) / 2) AS cy FROM nodes),
r AS (SELECT a.pos, a.cx AS ax, a.cy AS ay, b.cx AS bx, b.cy AS by_, {_boundary_sql('a', 'b.cx', 'b.cy')} AS s, {_boundary_sql('b', 'a.cx', 'a.cy')} AS e FROM c a JOIN c b ON a.sample_id = b.sample_id AND b.pos = a.pos + 1),
q AS (SELECT pos, ax, ay, bx, by_, coalesce(s.x, ax) AS sx, coalesce(s.y, ay) AS sy, coalesce(e.x, bx) AS ex, coalesce(e.y, by_) AS ey FROM r),
v AS (SELECT *, {_moved_sql('sx', 'sy', 'ex', 'ey', 'x')} AS vx, {_moved_sql('sx', 'sy', 'ex', 'ey', 'y')} AS vy FROM q),
w AS (SELECT *, {_moved_sql('ex', 'ey', 'vx', 'vy', 'x')} AS wx, {_moved_sql('ex', 'ey', 'vx', 'vy', 'y')} AS wy FROM v)"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir).select("sample_id", "pos", "box").withColumn("c", G.box_center("box"))
    b = n.select("sample_id", (F.col("pos") - 1).alias("pos"), F.col("box").alias("to_box"), F.col("c").alias("to_c"))
    path = F.array(G.boundary_point("box", "to_c"), G.boundary_point("to_box", "c")).cast("array<array<double>>")
    return n.join(b, ["sample_id", "pos"]).withColumn("path", path)


def _xy(c: Column, i: int, name: str) -> list[Column]:
    return [F.get(F.get(c, F.lit(i)), F.lit(k)).cast("int").alias(f"{name}{axis}") for k, axis in enumerate("xy")]


@query(f"""WITH {_ROUTES}, h AS (SELECT *, atan2(wy - vy, wx - vx) AS a FROM w), o AS (SELECT c.pos - 2 AS pos, c.cx, c.cy, greatest(c.x2 - c.x1, c.y2 - c.y1) / 2 + 6 AS reach FROM c),
d AS (SELECT h.*, o.cx, o.cy, o.reach, CASE WHEN pow(bx - ax, 2) + pow(by_ - ay, 2) = 0 THEN 0 ELSE greatest(0, least(1, ((o.cx - ax) * (bx - ax) + (o.cy - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) END AS t FROM h LEFT JOIN o USING (pos))
SELECT pos, {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in ('sx', 'sy', 'ex', 'ey', 'vx', 'vy', 'wx', 'wy'))}, CAST(trunc(wx + 16 * cos(a + pi() * 0.82)) AS INTEGER) AS lx, CAST(trunc(wy + 16 * sin(a + pi() * 0.82)) AS INTEGER) AS ly,
  CAST(trunc(wx + 16 * cos(a - pi() * 0.82)) AS INTEGER) AS rx, CAST(trunc(wy + 16 * sin(a - pi() * 0.82)) AS INTEGER) AS ry, coalesce(sqrt(pow(cx - (ax + t * (bx - ax)), 2) + pow(cy - (ay + t * (by_ - ay)), 2)) >= reach, true) AS clear FROM d""")
def route_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's route to the next: boundary points, trimmed path, arrow head, and whether it keeps clear of the node after that."""
    r = _routes(spark, sf_dir)
    after = V.nodes(spark, sf_dir).select((F.col("pos") - 2).alias("pos"), F.array("box").alias("others"))
    none = F.expr("cast(array() as array<array<double>>)")
    r = r.join(after, "pos", "left").withColumns({"v": G.visible_path("path"), "others": F.coalesce("others", none)}).withColumn("head", G.arrowhead("v"))
    return r.select("pos", *_xy(F.col("path"), 0, "s"), *_xy(F.col("path"), 1, "e"), *_xy(F.col("v"), 0, "v"), *_xy(F.col("v"), 1, "w"), *_xy(F.col("head"), 1, "l"), *_xy(F.col("head"), 2, "r"), G.segment_clear(F.col("c"), F.col("to_c"), "others").alias("clear"))


def _scaled_sql(x: str) -> str:
    return f"CAST(round_even(({x}) * 0.9::DOUBLE, 0) AS INTEGER)"


@query(f"""WITH {_ROUTES} SELECT pos, {', '.join(f'{_scaled_sql(c)} AS {n}' for c, n in (('vx', 'startx'), ('vy', 'starty'), ('wx', 'endx'), ('wy', 'endy'), ('floor((vx + wx) / 2)', 'midx'), ('floor((vy + wy) / 2)', 'midy'), ('sx', 'pathx'), ('sy', 'pathy')))},
  CASE WHEN pos % 3 < 2 THEN {_scaled_sql('wx')} END AS arrow_x, CASE WHEN pos % 3 < 2 THEN 3 ELSE 0 END AS target_head, CASE WHEN pos % 3 = 1 THEN 3 ELSE 0 END AS source_head FROM w""")
def edge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("pos") % 3 == 0, "directed").when(F.col("pos") % 3 == 1, "bidirectional").otherwise("undirected")
    got = graph.edge_records(_routes(spark, sf_dir).select("pos", kind.alias("type"), "path"))
    one = lambda c: _xy(F.array(c), 0, c)
    return got.select("pos", *one("start"), *one("end"), *one("mid"), *_xy(F.col("path"), 0, "path"), F.get("arrow", F.lit(0)).alias("arrow_x"), F.size("arrowheads.target").alias("target_head"), F.size("arrowheads.source").alias("source_head"))


@query(f"""WITH {V.NODES} SELECT pos, {_scaled_sql('x1')} AS x1, {_scaled_sql('y2')} AS y2, {_scaled_sql('floor((x1 + x2) / 2)')} AS cx, CASE WHEN pos % 2 = 0 THEN {_scaled_sql('y1')} END AS image_y1, 'icon' || pos || '.png' AS asset FROM nodes""")
def node_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir).withColumns({"image_box": F.when(F.col("pos") % 2 == 0, F.col("box")), "text_box": F.col("box"), "asset": F.concat(F.lit("some/folder/icon"), "pos", F.lit(".png"))})
    at = lambda c, i: F.get(c, F.lit(i))
    return graph.node_records(n).select("pos", at("box", 0).alias("x1"), at("box", 3).alias("y2"), at("center", 0).alias("cx"), at("image_box", 1).alias("image_y1"), "asset")


@query(f"""WITH {V.NODES} SELECT pos, CAST(60 + least(x2, 400) AS INTEGER) AS top_x, len(p) AS points FROM (SELECT pos, x2, [1, 2, 3, 4] AS p FROM nodes) s""")
def detour_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around a box between two points of one row; the path's corners lie over its ends."""
    n = V.nodes(spark, sf_dir)
    end = F.least(F.get("box", F.lit(2)), F.lit(400.0)) + 60
    start = F.array(end - 2000, F.lit(400.0))
    paths = G.detour_candidates(start, F.array(end, F.lit(410.0)), F.array("box"), 42, 56)
    best = G.best_detour(paths, F.array("box"))
    return n.select("pos", F.get(F.get(best, F.lit(2)), F.lit(0)).cast("int").alias("top_x"), F.size(best).cast("long").alias("points"))


# --- link policies and shifts


@query("""WITH e AS (SELECT vec_id // 20 AS sample_id, vec_id % 20 AS edge, (vec_id * 7) % 13 * 10 AS x, (vec_id * 3) % 5 * 4 + vec_id % 3 AS y, vec_id % 4 AS k FROM embeddings),
s AS (SELECT sample_id, edge, 1 AS seg, 'h' AS axis, round_even((y + y + k) / 4.0::DOUBLE, 0) * 4 AS coord, x AS lo, x + 50 AS hi FROM e WHERE k <= 2
  UNION ALL SELECT sample_id, edge, 2, 'v', round_even((x + 50 + x + 50) / 4.0::DOUBLE, 0) * 4, least(y + k, y + 40), greatest(y + k, y + 40) FROM e),
g AS (SELECT *, min(edge * 10 + seg) OVER (PARTITION BY sample_id, axis, coord) AS f, CASE WHEN lo <= lag(hi) OVER w + 4 THEN 0 ELSE 1 END AS st FROM s WINDOW w AS (PARTITION BY sample_id, axis, coord ORDER BY lo, hi, edge)),
c AS (SELECT *, sum(st) OVER (PARTITION BY sample_id, axis, coord ORDER BY lo, hi, edge ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cl FROM g),
r AS (SELECT *, count(*) OVER (PARTITION BY sample_id, axis, coord, cl) AS n, row_number() OVER (PARTITION BY sample_id, axis, coord, cl ORDER BY edge) - 1 AS i FROM (SELECT DISTINCT sample_id, axis, coord, cl, f, edge FROM c) d),
m AS (SELECT *, CAST(round_even((i - (n - 1) / 2.0::DOUBLE) * 10, 0) AS INTEGER) AS mv FROM r WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY sample_id, edge ORDER BY f, cl) = 1)
SELECT sample_id, edge, CASE WHEN axis = 'v' THEN mv ELSE 0 END AS dx, CASE WHEN axis = 'h' THEN mv ELSE 0 END AS dy FROM m""")
def axis_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    x, y = (v * 7) % 13 * 10, (v * 3) % 5 * 4 + v % 3
    path = F.array(F.array(x, y), F.array(x + 50, y + v % 4), F.array(x + 50, y + 40))
    edges = V.table(spark, sf_dir, "embeddings").select(F.floor(v / 20).alias("sample_id"), (v % 20).alias("edge"), path.alias("path"))
    return graph.axis_shifts(edges, "sample_id")


@query(f"""WITH {V.EDGES}, r AS (SELECT *, {_hash_sql('sample_id')} / 4294967296.0::DOUBLE AS roll, {_hash_sql('ok * 10 + ln')} AS pick FROM edges_gold),
w AS (SELECT *, CASE WHEN roll < CASE difficulty WHEN 'simple' THEN 0 WHEN 'medium' THEN 0.03 ELSE 0.18 END THEN 3 WHEN roll < CASE difficulty WHEN 'simple' THEN 0.22 WHEN 'medium' THEN 0.25 ELSE 0.55 END THEN 2 END AS want FROM r),
ch AS (SELECT * FROM w WHERE want IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY pick, source, target, type) <= CASE WHEN want = 3 THEN 2 ELSE 1 END),
p AS (SELECT sample_id, source, target, max(want) AS want FROM ch GROUP BY ALL), h AS (SELECT p.*, count(*) AS n, list(e.type) AS have FROM edges_gold e JOIN p USING (sample_id, source, target) GROUP BY ALL),
f AS (SELECT h.*, t.type, row_number() OVER (PARTITION BY sample_id, source, target ORDER BY i) AS i FROM h, (VALUES (1, 'A'), (2, 'N'), (3, 'power')) t(i, type) WHERE NOT list_contains(have, t.type))
SELECT sample_id, source, target, type FROM f WHERE i <= want - n""")
def multilink_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.edges_gold(spark, sf_dir).withColumn("num", F.col("ok") * 10 + F.col("ln"))
    return graph.multilink_types(e, "sample_id", curation.hash_order("sample_id") / 4294967296.0, "difficulty", curation.hash_order("num"), ("A", "N", "power"))


def _draw_sql(salt: int, *columns: str) -> str:
    return f"({_hash_sql(f'{salt * 7919} + ' + ' + '.join(f'{c} * {31 * i + 1}' for i, c in enumerate(columns)))} // 256)"


def _draw(salt: int, columns: list[str]) -> Column:
    x = F.lit(salt * 7919).cast("long")
    for i, c in enumerate(columns):
        x = x + F.col(c) * (31 * i + 1)
    return F.floor((F.pmod(x, F.lit(_TURN)) * F.lit(2654435761)) % F.lit(4294967296) / 256)


@query(f"""WITH {V.EDGES}, e AS (SELECT *, ok * 10 + ln AS num FROM edges_gold),
a AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n, count(*) OVER (PARTITION BY sample_id, source, target) AS p, row_number() OVER (PARTITION BY sample_id, source, target ORDER BY num) - 1 AS i, min(num) OVER (PARTITION BY sample_id, source, target) AS f FROM e),
b AS (SELECT *, least(n, 5) AS top, max(p) OVER (PARTITION BY sample_id) AS m FROM a), c AS (SELECT *, greatest(3, least(top, m)) AS low FROM b),
d AS (SELECT *, CASE WHEN top <= 2 THEN top ELSE low + {_draw_sql(1, 'sample_id')} % (top - low + 1) END AS labels FROM c)
SELECT sample_id, num, CAST(labels AS INTEGER) AS labels, CAST(CASE WHEN p > 1 AND i < labels THEN ({_draw_sql(2, 'sample_id', 'f')} + i) % labels ELSE {_draw_sql(3, 'sample_id', 'num')} % labels END AS INTEGER) AS label FROM d""")
def link_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.edges_gold(spark, sf_dir).withColumn("num", F.col("ok") * 10 + F.col("ln"))
    return graph.link_types(e, "sample_id", "num", _draw).select("sample_id", "num", "labels", "label")


_ROLE = "CASE pos % 7 WHEN 0 THEN 'start' WHEN 1 THEN 'split' WHEN 2 THEN 'end' WHEN 3 THEN 'merge' ELSE 'task' END"


@query(f"""WITH {V.NODES}, n AS (SELECT *, {_ROLE} AS role FROM nodes), e AS (SELECT sample_id, pos, id AS source, 'n' || ((pos + 6) % 20 + 1) AS target FROM nodes),
t AS (SELECT e.*, coalesce(a.role, '') NOT IN ('start', 'split') AND coalesce(b.role, '') NOT IN ('end', 'merge') AND {_hash_sql('e.pos')} < 1717986918 AS turn FROM e LEFT JOIN n a ON a.sample_id = e.sample_id AND a.id = e.source LEFT JOIN n b ON b.sample_id = e.sample_id AND b.id = e.target)
SELECT pos, CASE WHEN turn THEN target ELSE source END AS source, CASE WHEN turn THEN source ELSE target END AS target, CASE WHEN turn THEN 2 ELSE 1 END AS first_x FROM t""")
def reversed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir).withColumn("role", F.expr(_ROLE))
    path = F.array(F.array(F.lit(1), F.lit(0)), F.array(F.lit(2), F.lit(0)))
    e = n.select("sample_id", "pos", F.col("id").alias("source"), F.concat(F.lit("n"), (F.col("pos") + 6) % 20 + 1).alias("target"), path.alias("path"))
    got = graph.reversed_edges(e, n, "sample_id", curation.hash_order("pos") < 1717986918)
    return got.select("pos", "source", "target", F.get(F.get("path", F.lit(0)), F.lit(0)).alias("first_x"))


@query(f"""WITH {V.NODES}, n AS (SELECT sample_id, pos, id, pos % 20 AS k, 100 * (pos % 20) AS x1, 100 * (pos % 20) + 60 + CASE WHEN sample_id % 3 = 0 AND pos % 20 = 4 THEN 32 ELSE sample_id % 7 END AS x2 FROM nodes),
e AS (SELECT sample_id, k, id AS source, 'n' || ((k + 3) % CASE WHEN sample_id % 5 = 0 THEN 24 ELSE 20 END + 1) AS target FROM n WHERE k % 4 = 0),
ends AS (SELECT sample_id, source AS id FROM e UNION SELECT sample_id, target FROM e UNION SELECT sample_id, CASE WHEN sample_id % 13 = 2 THEN 'zz' ELSE 'n1' END FROM n),
bad AS (SELECT a.sample_id FROM n a JOIN n b ON a.sample_id = b.sample_id AND a.pos < b.pos AND NOT (a.x2 + 8 < b.x1 OR a.x1 - 8 > b.x2) UNION SELECT sample_id FROM n WHERE sample_id % 11 = 5 AND k = 0
  UNION SELECT sample_id FROM ends ANTI JOIN n USING (sample_id, id) UNION SELECT sample_id FROM e WHERE sample_id % 7 = 1 AND k = 4)
SELECT DISTINCT sample_id, sample_id NOT IN (SELECT sample_id FROM bad) AS valid FROM n""")
def valid_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("sample_id"), F.col("pos") % 20
    n = V.nodes(spark, sf_dir).withColumn("k", k)
    x1 = (F.col("k") * 100).cast("double")
    x2 = x1 + 60 + F.when((s % 3 == 0) & (F.col("k") == 4), 32).otherwise(s % 7)
    nodes = n.select("sample_id", "id", F.array(x1, F.lit(0.0), x2, F.lit(50.0)).alias("box"), F.when(~((s % 11 == 5) & (F.col("k") == 0)), "a.png").alias("asset"))
    points = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(99.0), F.lit(0.0)))
    target = F.concat(F.lit("n"), (F.col("k") + 3) % F.when(s % 5 == 0, 24).otherwise(20) + 1)
    edges = n.filter("k % 4 = 0").select("sample_id", F.col("id").alias("source"), target.alias("target"), F.lit("directed").alias("type"), F.when((s % 7 == 1) & (F.col("k") == 4), F.slice(points, 1, 1)).otherwise(points).alias("path"))
    negatives = n.select("sample_id", F.lit("n1").alias("source"), F.when(s % 13 == 2, "zz").otherwise("n1").alias("target"))
    return graph.valid_graphs(nodes, edges, negatives, "sample_id")


# --- scores of raw output, histograms


@query("""WITH o AS (SELECT l_orderkey, count(*) AS edges, count(*) FILTER (WHERE l_returnflag <> 'N' AND l_partkey % 7 <> 0) AS traces, count(*) FILTER (WHERE l_returnflag <> 'N' AND l_partkey % 7 <> 0 AND l_suppkey % 3 <> 0) AS valid FROM lineitem GROUP BY 1),
g AS (SELECT l_orderkey % 4 AS shard, CAST(sum(traces) AS BIGINT) AS trace_present, CAST(sum(valid) AS BIGINT) AS trace_valid5, CAST(sum(edges) AS BIGINT) AS pred_edges, count(*) AS edge_groups, count(*) FILTER (WHERE l_orderkey % 5 = 0) AS edge_format_errors FROM o GROUP BY 1)
SELECT *, round(trace_present / pred_edges, 6) AS trace_present_per_pred_edge, round(trace_valid5 / pred_edges, 6) AS trace5_valid_per_pred_edge, round(edge_format_errors / edge_groups, 6) AS edge_group_format_error_rate FROM g""")
def edge_output_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth output lacks its closing tag."""
    from topoframe.operators import parsing

    texts = graph_texts(spark, sf_dir)
    texts = texts.withColumn("text", F.when(F.col("sample_id") % 5 == 0, F.replace("text", F.lit("</EDGE_GRAPH>"), F.lit(""))).otherwise(F.col("text")))
    counters = scoring.output_counters(parsing.edges(texts), parsing.edge_info(texts))
    return reports.output_rates(counters.withColumn("shard", F.col("sample_id") % 4), ["shard"])


@query(f"""WITH {V.VERDICTS}, s AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'API_ERROR' WHEN doc_id % 13 = 0 THEN 'PARSE_ERROR' ELSE 'OK' END AS status FROM verdicts),
r AS (SELECT 'api_errors' AS kind, 'timeout ' || doc_id % 2 AS value FROM s WHERE status = 'API_ERROR' UNION ALL SELECT 'parse_errors', 'missing_json_object' FROM s WHERE status = 'PARSE_ERROR'
  UNION ALL SELECT 'quality_scores', CASE WHEN ok THEN '4' ELSE '2' END FROM s WHERE status = 'OK' UNION ALL SELECT 'check_failures', 'sharp' FROM s WHERE status = 'OK' AND doc_id % 3 = 0 UNION ALL SELECT 'check_failures', 'legible' FROM s WHERE status = 'OK' AND NOT ok)
SELECT kind, value, count(*) AS n FROM r GROUP BY ALL""")
def qa_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, ok = F.col("doc_id"), F.col("ok")
    status = F.when(i % 17 == 0, "API_ERROR").when(i % 13 == 0, "PARSE_ERROR").otherwise("OK")
    error = F.when(i % 17 == 0, F.concat(F.lit("timeout "), i % 2)).when(i % 13 == 0, "missing_json_object")
    say = lambda bad: F.when(bad, "FAIL").otherwise("PASS")
    checks = F.create_map(F.lit("sharp"), say(i % 3 == 0), F.lit("legible"), say(~ok))
    result = F.when((i % 17 != 0) & (i % 13 != 0), F.struct(F.when(ok, 4).otherwise(2).alias("quality_score"), checks.alias("checks")))
    return reports.qa_histograms(V.verdicts(spark, sf_dir).withColumns({"status": status, "parse_error": error, "result": result}))


# --- matching and joins


@query(f"""WITH {V.NODES}, m AS (SELECT sample_id, pos, CASE pos % 4 WHEN 0 THEN 'x' ELSE 'n' END || CASE pos % 4 WHEN 1 THEN '0' ELSE '' END || (pos % 20 + 1) AS id, CASE WHEN pos % 5 = 0 THEN '#!' ELSE 'Same ' || pos % 2 END AS name FROM nodes),
k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS n, row_number() OVER (PARTITION BY sample_id, name ORDER BY CASE WHEN pos % 4 >= 2 THEN 0 ELSE 1 END, CASE WHEN pos % 4 >= 2 THEN pos % 20 END, id, pos) AS r FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY sample_id, name ORDER BY r) AS q FROM k WHERE pos % 11 <> 4)
SELECT p.sample_id, p.id AS pred_id, g.id AS gold_id FROM p JOIN k g ON p.sample_id = g.sample_id AND p.n = g.n AND p.q = g.r WHERE p.n <> ''""")
def node_match_id_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with and without a leading zero, ids that aren't n and a number, and names of symbols."""
    pos = F.col("pos")
    name = F.when(pos % 5 == 0, "#!").otherwise(F.concat(F.lit("Same "), pos % 2))
    ids = F.concat(F.when(pos % 4 == 0, "x").otherwise("n"), F.when(pos % 4 == 1, "0").otherwise(""), pos % 20 + 1)
    n = V.nodes(spark, sf_dir).withColumns({"id": ids, "name": name, "box": F.array().cast("array<double>")})
    return matching.match_nodes(n.filter("pos % 11 <> 4"), n)


@query(f"""WITH {V.NODES}, e AS (SELECT sample_id, pos, id AS source, 'n' || ((pos + 3) % 24 + 1) AS target FROM nodes WHERE pos % 4 = 0)
SELECT e.pos, a.name AS source_name, b.name AS target_name FROM e LEFT JOIN nodes a ON a.sample_id = e.sample_id AND a.id = e.source LEFT JOIN nodes b ON b.sample_id = e.sample_id AND b.id = e.target""")
def edge_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir)
    e = n.filter("pos % 4 = 0").select("sample_id", "pos", F.col("id").alias("source"), F.concat(F.lit("n"), (F.col("pos") + 3) % 24 + 1).alias("target"))
    return matching.with_names(e, n).select("pos", "source_name", "target_name")


@query(f"""WITH {V.MANIFEST}, pool AS (SELECT *, 0 AS f, doc_id // 4 AS k FROM manifest WHERE doc_id % 4 = 0 AND domain = 'en' UNION ALL SELECT *, 1, doc_id // 4 FROM manifest WHERE doc_id % 4 = 1 AND domain = 'en'),
l AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY split, difficulty, k ORDER BY f DESC) = 1), c AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY split, difficulty ORDER BY {V.HASH}, doc_id) <= 10)
SELECT doc_id, domain FROM c UNION ALL SELECT doc_id, domain FROM manifest WHERE doc_id % 4 = 0 AND domain <> 'en'""")
def rebalanced_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.manifest(spark, sf_dir).withColumn("k", F.floor(F.col("doc_id") / 4))
    groups = ["split", "difficulty"]
    targets = m.select(*groups).distinct().withColumn("target", F.lit(10))
    mine = F.col("domain") == "en"
    got = curation.rebalanced_domain(m.filter("doc_id % 4 = 0"), m.filter("doc_id % 4 = 1").filter(mine), mine, groups, "k", [curation.hash_order("doc_id"), F.col("doc_id")], targets)
    return got.select("doc_id", "domain")


@query(f"""WITH {V.MANIFEST}, r AS (SELECT event_id % 300 AS doc_id, max(event_id) AS seq, arg_max(event_type, event_id) AS verdict FROM events GROUP BY 1) SELECT doc_id, domain, seq, verdict FROM manifest JOIN r USING (doc_id)""")
def reviewed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.table(spark, sf_dir, "events").select((F.col("event_id") % 300).alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("verdict"))
    return curation.reviewed_rows(V.manifest(spark, sf_dir), log, ["doc_id"], "seq").select("doc_id", "domain", "seq", "verdict")


@query(f"""WITH {V.VERDICTS} SELECT m.doc_id, m.domain FROM manifest m WHERE m.split = 'train' AND m.doc_id IN (SELECT doc_id FROM verdicts WHERE ok)""")
def passed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.passed_source(V.manifest(spark, sf_dir).filter("split = 'train'"), V.verdicts(spark, sf_dir), ["doc_id"], F.col("ok")).select("doc_id", "domain")
