"""Graph documents, layout and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoframe.functions import geometry as G
from topoframe.operators import generate, graph, validation

from . import views as V
from .registry import query


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.edges_gold(spark, sf_dir)


@query(f"""WITH {V.EDGES}, n AS (SELECT DISTINCT sample_id, source AS id FROM edges_gold UNION SELECT DISTINCT sample_id, 'hub' FROM edges_gold)
SELECT n.sample_id, n.id, CAST(count(e.target) AS INTEGER) AS relations, arg_min(e.target, (e.ok * 10 + e.ln, e.target)) AS first_target FROM n LEFT JOIN edges_gold e ON e.sample_id = n.sample_id AND e.source = n.id GROUP BY ALL""")
def final_graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir).withColumn("at", F.col("ok") * 10 + F.col("ln"))
    ids = e.select("sample_id", F.col("source").alias("id")).unionAll(e.select("sample_id", F.lit("hub").alias("id"))).distinct()
    got = graph.adjacency(ids, e, "sample_id", "at")
    return got.select("sample_id", "id", F.size("relations").alias("relations"), F.get("relations", F.lit(0))["target"].alias("first_target"))


@query(f"""WITH {V.EDGES}, u AS (SELECT sample_id, source, target, type, 'forward' AS direction FROM edges_gold UNION ALL SELECT sample_id, target, source, type, 'reverse' FROM edges_gold WHERE type = 'N')
SELECT sample_id, source, target, type, direction, count(*) AS n FROM u GROUP BY ALL""")
def undirected_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir).select("sample_id", "source", "target", "type")
    return graph.undirected(e, F.col("type") == "N").groupBy("sample_id", "source", "target", "type", "direction").agg(F.count("*").alias("n"))


@query(f"""WITH {V.NODES} SELECT sample_id, id, 'n' || row_number() OVER (PARTITION BY sample_id ORDER BY floor(y1 / 30), x1, y1, pos) AS new_id FROM nodes""")
def reading_order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir).select("sample_id", "id", "pos", F.get("box", F.lit(0)).alias("x1"), F.get("box", F.lit(1)).alias("y1"))
    return graph.reading_order(n, "sample_id").select("sample_id", "id", "new_id")


_RING = f"""{V.NODES}, ring AS (SELECT sample_id, 'n' || (pos % 20 + 1) AS source, 'n' || ((pos + 3) % 24 + 1) AS target FROM nodes WHERE pos % 4 = 0)"""


def _ring(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = V.nodes(spark, sf_dir)
    end = lambda e: F.concat(F.lit("n"), e + 1)
    return n, n.filter("pos % 4 = 0").select("sample_id", end(F.col("pos") % 20).alias("source"), end((F.col("pos") + 3) % 24).alias("target"))


@query(f"WITH {_RING} SELECT n.sample_id, n.id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM ring r WHERE r.sample_id = n.sample_id AND (r.source = n.id OR r.target = n.id))")
def isolated_nodes_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _ring(spark, sf_dir)
    return graph.isolated(n, e, "sample_id").select("sample_id", "id")


@query(f"""WITH {_RING}, ends AS (SELECT sample_id, source AS id FROM ring UNION SELECT sample_id, target FROM ring)
SELECT sample_id, 'unknown_endpoint' AS rule, id AS detail FROM ends ANTI JOIN nodes USING (sample_id, id) UNION ALL SELECT sample_id, 'isolated_node', id FROM nodes ANTI JOIN ends USING (sample_id, id)""")
def endpoint_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _ring(spark, sf_dir)
    return validation.endpoint_violations(n, e, "sample_id")


@query(f"""WITH {V.NODES} SELECT a.sample_id, a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.sample_id = b.sample_id AND a.pos < b.pos
WHERE NOT (a.x2 + 8 < b.x1 OR a.x1 - 8 > b.x2 OR a.y2 + 8 < b.y1 OR a.y1 - 8 > b.y2)""")
def bbox_overlap_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir)
    a, b = n.select("sample_id", F.col("id").alias("a"), F.col("pos").alias("pa"), F.col("box").alias("ba")), n.select("sample_id", F.col("id").alias("b"), F.col("pos").alias("pb"), F.col("box").alias("bb"))
    return a.join(b, "sample_id").filter("pa < pb").filter(G.boxes_overlap("ba", "bb")).select("sample_id", "a", "b")


_CENTERS = f"""{V.NODES}, c AS (SELECT sample_id, pos, id, CAST(floor((x1 + x2) / 2) AS INTEGER) AS cx, CAST(floor((y1 + y2) / 2) AS INTEGER) AS cy FROM nodes)"""


def _centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.nodes(spark, sf_dir).withColumn("c", G.box_center("box"))
    return c.select("sample_id", "pos", "id", F.get("c", F.lit(0)).alias("cx"), F.get("c", F.lit(1)).alias("cy"))


@query(f"""WITH {_CENTERS}, d AS (SELECT a.sample_id, a.id, b.id AS near_id, b.pos, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS distance FROM c a JOIN c b ON a.sample_id = b.sample_id AND a.id <> b.id)
SELECT sample_id, id, near_id, round(distance, 4) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY sample_id, id ORDER BY distance, pos) = 1""")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(_centers(spark, sf_dir), "sample_id").withColumn("distance", F.round("distance", 4))


@query(f"""WITH {_CENTERS}, a AS (SELECT *, avg(cx) OVER (PARTITION BY sample_id) AS mx, avg(cy) OVER (PARTITION BY sample_id) AS my FROM c)
SELECT sample_id, id AS hub FROM a QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round(abs(cx - mx) + abs(cy - my), 9), pos) = 1""")
def hub_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(_centers(spark, sf_dir), "sample_id")


@query(f"""WITH {_CENTERS} SELECT sample_id, id, CAST(least(dense_rank() OVER (PARTITION BY sample_id ORDER BY round_even(cx / 100.0::DOUBLE, 0)) - 1, 2) AS INTEGER) AS tier FROM c""")
def node_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tiers(_centers(spark, sf_dir), "sample_id").select("sample_id", "id", F.col("tier").cast("int").alias("tier"))


@query(f"""WITH {V.EDGES}, r AS (SELECT sample_id, ok, ln, row_number() OVER w AS i, count(*) OVER (PARTITION BY sample_id, source, target) AS n FROM edges_gold WINDOW w AS (PARTITION BY sample_id, source, target ORDER BY ok, ln, type, qty))
SELECT sample_id, ok, ln, (i - 1 - (n - 1) / 2.0::DOUBLE) * 13.0::DOUBLE AS "offset" FROM r""")
def multilink_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.multilink_offsets(_edges(spark, sf_dir), ["sample_id", "source", "target"], ["ok", "ln", "type", "qty"]).select("sample_id", "ok", "ln", "offset")


@query(f"""WITH {V.EDGES} SELECT sample_id, ok, ln, CAST((row_number() OVER (PARTITION BY sample_id, target ORDER BY ok, ln, type, qty) - 1) % 5 AS INTEGER) AS lane FROM edges_gold""")
def target_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lanes(_edges(spark, sf_dir), ["sample_id", "target"], ["ok", "ln", "type", "qty"]).select("sample_id", "ok", "ln", F.col("lane").cast("int").alias("lane"))


@query(f"""WITH {V.NODES}, s AS (SELECT sample_id, id AS edge, round_even(y1 / 4, 0) * 4 AS bucket, x1 AS lo, x2 AS hi FROM nodes),
f AS (SELECT *, CASE WHEN lo <= lag(hi) OVER w + 4 THEN 0 ELSE 1 END AS st FROM s WINDOW w AS (PARTITION BY sample_id, bucket ORDER BY lo, hi, edge)),
g AS (SELECT *, sum(st) OVER (PARTITION BY sample_id, bucket ORDER BY lo, hi, edge ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM f)
SELECT sample_id, edge, CAST(cluster AS BIGINT) AS cluster, CAST(dense_rank() OVER (PARTITION BY sample_id, bucket, cluster ORDER BY edge) AS INTEGER) AS rank FROM g""")
def interval_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("box", F.lit(i))
    s = V.nodes(spark, sf_dir).select("sample_id", F.col("id").alias("edge"), (F.bround(at(1) / 4) * 4).alias("bucket"), at(0).alias("lo"), at(2).alias("hi"))
    return graph.interval_clusters(s, ["sample_id", "bucket"], "lo", "hi").select("sample_id", "edge", "cluster", "rank")


@query(f"""WITH {V.NODES}, r AS (SELECT sample_id, id, name, count(*) OVER (PARTITION BY sample_id, lower(name)) AS n, row_number() OVER (PARTITION BY sample_id, lower(name) ORDER BY pos) - 1 AS i FROM nodes)
SELECT sample_id, id, CASE WHEN n > 1 THEN name || ' ' || (['A', 'B', 'C'])[CAST(i % 3 AS BIGINT) + 1] ELSE name END AS display FROM r""")
def duplicate_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topoframe.operators.curation import duplicate_suffix as suffixed

    return suffixed(V.nodes(spark, sf_dir), ["sample_id"], "name", "pos", ["A", "B", "C"]).select("sample_id", "id", "display")


@query(f"""WITH {V.EDGES}, p AS (SELECT sample_id, source, target, count(*) AS c FROM edges_gold GROUP BY ALL), n AS (SELECT sample_id, count(DISTINCT source) AS nodes FROM edges_gold GROUP BY 1),
t AS (SELECT sample_id, string_agg(type, ',' ORDER BY type) AS types FROM (SELECT DISTINCT sample_id, type FROM edges_gold) d GROUP BY 1)
SELECT p.sample_id, n.nodes, CAST(sum(c) AS BIGINT) AS edges, t.types, max(c) > 1 AS multi_link FROM p JOIN n USING (sample_id) JOIN t USING (sample_id) GROUP BY ALL""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    got = graph.graph_summary(e.select("sample_id", "source").distinct(), e, "sample_id")
    return got.select("sample_id", "nodes", "edges", F.array_join("edge_types", ",").alias("types"), "multi_link")


@query(f"""WITH {V.EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, least(source, target), greatest(source, target), type ORDER BY ok, ln, qty) AS rn FROM edges_gold)
SELECT sample_id, source, target, type FROM r WHERE rn = 1""")
def first_edge_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir).withColumn("at", F.struct("ok", "ln", "qty"))
    return graph.first_edges(e, "sample_id", "at", by_type=True).select("sample_id", "source", "target", "type")


_SIDE = """CASE WHEN abs(bx - ax) >= abs(by_ - ay) THEN CASE WHEN bx - ax >= 0 THEN 'right' ELSE 'left' END ELSE CASE WHEN by_ - ay >= 0 THEN 'bottom' ELSE 'top' END END"""


@query(f"""WITH {V.NODES}, x AS (SELECT a.pos, floor((a.x1 + a.x2) / 2) AS ax, floor((a.y1 + a.y2) / 2) AS ay, floor((b.x1 + b.x2) / 2) AS bx, floor((b.y1 + b.y2) / 2) AS by_, a.x1, a.y1, a.x2, a.y2, b.x1 AS ux, b.y1 AS uy FROM nodes a JOIN pred_nodes b USING (pos))
SELECT pos, {_SIDE} AS side, round(sqrt(pow(greatest(x1 - ux, 0, ux - x2), 2) + pow(greatest(y1 - uy, 0, uy - y2), 2)), 4) AS distance, CAST(ax AS INTEGER) AS cx, CAST(round_even(x1 * 0.9, 0) AS INTEGER) AS scaled_x1 FROM x""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir)
    return n.select(
        "pos", G.side_between("box", "pred_box").alias("side"), F.round(G.point_box_distance(F.slice("pred_box", 1, 2), "box"), 4).alias("distance"),
        F.get(G.box_center("box"), F.lit(0)).alias("cx"), F.get(G.scale("box", 0.9), F.lit(0)).alias("scaled_x1"),
    )


@query()
def path_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary points, arrow heads, trimmed paths, blocked segments and the cheapest detour; tests/ has worked examples."""
    pred, gold = V.traces(spark, sf_dir)
    g = gold.withColumn("boxes", F.array("source_box", "target_box"))
    straight, bent = F.array(F.get("points", F.lit(0)), F.get("points", F.lit(4))), F.array(F.get("points", F.lit(0)), F.get("points", F.lit(2)), F.get("points", F.lit(4)))
    return g.select(
        "sample_id", "edge_id", F.round(G.path_length("points"), 4).alias("length"), G.path_blocks("points", "boxes").alias("blocks"), F.size(G.best_detour(F.array(straight, bent), "boxes")).alias("detour_points"),
        G.boundary_point("source_box", F.get("points", F.lit(4))).alias("boundary"), F.size(G.visible_path("points", 12)).alias("visible_points"), G.arrowhead("points").alias("arrowhead"),
    )


@query()
def think_graph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged text of every embedding graph; tests/ parses it back."""
    n, e = _ring(spark, sf_dir)
    nodes = n.select("sample_id", "id", "name", F.transform("box", lambda v: v.cast("int")).alias("box"), F.col("pos").alias("num"))
    point = F.array(F.lit(1), F.lit(2))
    edges = e.withColumns({"type": F.lit("directed"), "start": point, "mid": point, "end": point, "arrow": F.lit(None).cast("array<int>"), "num": F.xxhash64("source", "target")})
    return graph.think_graph(nodes, edges, "sample_id")


@query(f"""WITH {V.EDGES}, r AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n, row_number() OVER (PARTITION BY sample_id, type ORDER BY ok, ln, qty, source, target) AS r FROM edges_gold)
SELECT sample_id, type, count(*) AS n FROM r WHERE type <> 'N' OR r <= floor(n * 0.45) GROUP BY ALL""")
def edge_type_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = graph.type_budget(_edges(spark, sf_dir), "sample_id", "N", 0.45, ["ok", "ln", "qty", "source", "target"])
    return kept.groupBy("sample_id", "type").agg(F.count("*").alias("n"))


@query(f"""WITH {_CENTERS}, ring AS (SELECT sample_id, 'n' || (pos % 20 + 1) AS source, 'n' || ((pos + 4) % 20 + 1) AS target FROM nodes WHERE pos % 5 = 0),
lonely AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM ring r WHERE r.sample_id = c.sample_id AND (r.source = c.id OR r.target = c.id))),
d AS (SELECT a.sample_id, a.id, a.pos, b.id AS near_id, b.pos AS near_pos FROM lonely a JOIN c b ON a.sample_id = b.sample_id AND a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.sample_id, a.id ORDER BY sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)), b.pos) = 1)
SELECT sample_id, source, target, 'ring' AS type FROM ring UNION ALL SELECT DISTINCT sample_id, CASE WHEN pos < near_pos THEN id ELSE near_id END, CASE WHEN pos < near_pos THEN near_id ELSE id END, 'directed' FROM d""")
def repaired_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = lambda e: F.concat(F.lit("n"), e + 1)
    ring = V.nodes(spark, sf_dir).filter("pos % 5 = 0").select("sample_id", end(F.col("pos") % 20).alias("source"), end((F.col("pos") + 4) % 20).alias("target"), F.lit("ring").alias("type"))
    return graph.repair_isolated(_centers(spark, sf_dir), ring, "sample_id")


@query()
def generated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many seeded cases as there are embedding graphs; tests/ checks that each is valid and depends on its seed alone."""
    n = V.table(spark, sf_dir, "embeddings").count() // 20
    return generate.cases(spark, n, 8120, ["Pump", "Valve", "Tank", "Filter", "Motor"])
