"""Scores of typed edges, nodes and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoframe.functions import geometry as G
from topoframe.functions.text import normalize_name
from topoframe.operators import matching, reports, scoring

from . import views as V
from .registry import query

_KEYS = ["sample_id", "domain", "difficulty"]


def _overlap_sql(items: str) -> str:
    k = f"sample_id, domain, difficulty, {items}"
    return f"""t AS (SELECT {k}, sum(p) AS p, sum(g) AS g FROM (SELECT {k}, 1 AS p, 0 AS g FROM edges_pred UNION ALL SELECT {k}, 0, 1 FROM edges_gold) u GROUP BY ALL),
s AS (SELECT sample_id, domain, difficulty, sum(least(p, g)) AS tp, sum(p) AS pred, sum(g) AS gt, bool_and(p = g) AS exact FROM t GROUP BY ALL)"""


_PRF = """round(coalesce(tp / nullif(CAST(pred AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(gt AS DOUBLE), 0), 0), 6) AS recall,
  round(coalesce(2.0 * (tp / nullif(CAST(pred AS DOUBLE), 0)) * (tp / nullif(CAST(gt AS DOUBLE), 0)) / nullif(tp / nullif(CAST(pred AS DOUBLE), 0) + tp / nullif(CAST(gt AS DOUBLE), 0), 0), 0), 6) AS f1"""
_REPORT = "CASE WHEN grouping(domain) = 1 AND grouping(difficulty) = 1 THEN 'summary' WHEN grouping(difficulty) = 1 THEN 'by_domain' WHEN grouping(domain) = 1 THEN 'by_difficulty' ELSE 'by_domain_difficulty' END AS report"
_SETS = "GROUPING SETS ((), (domain), (difficulty), (domain, difficulty))"


def _prf_cube_sql(items: str) -> str:
    return f"""WITH {V.EDGES}, {_overlap_sql(items)},
c AS (SELECT {_REPORT}, domain, difficulty, count(*) AS samples, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(pred) AS BIGINT) AS pred, CAST(sum(gt) AS BIGINT) AS gt FROM s GROUP BY {_SETS})
SELECT *, {_PRF} FROM c"""


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gold = V.edges_gold(spark, sf_dir)
    return V.edges_pred(gold), gold


def _prf_cube(spark: SparkSession, sf_dir: str, items: list[str]) -> DataFrame:
    pred, gold = _edges(spark, sf_dir)
    sums = [F.count("*").alias("samples"), *(F.sum(c).alias(c) for c in ("tp", "pred", "gt"))]
    got = reports.cube_report(scoring.overlap(pred, gold, _KEYS, items), sums)
    return got.select("report", "domain", "difficulty", "samples", "tp", "pred", "gt", *scoring.prf())


@query(_prf_cube_sql("source, target, type"))
def typed_edge_prf_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prf_cube(spark, sf_dir, ["source", "target", "type"])


@query(_prf_cube_sql("source, target"))
def endpoint_prf_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prf_cube(spark, sf_dir, ["source", "target"])


@query(f"""WITH {V.EDGES}, {_overlap_sql("source, target, type")},
pr AS (SELECT sample_id, domain, difficulty, source, target, bool_and(p = g) AS e FROM t GROUP BY ALL)
SELECT domain, CAST(count(*) FILTER (WHERE e) AS BIGINT) AS pair_exact, count(*) AS pair_total, round(count(*) FILTER (WHERE e) / CAST(count(*) AS DOUBLE), 6) AS rate FROM pr GROUP BY domain""")
def pair_exact_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, gold = _edges(spark, sf_dir)
    got = scoring.pair_exact(pred, gold, _KEYS, ["source", "target"], "type").groupBy("domain").agg(F.sum("pair_exact").alias("pair_exact"), F.sum("pair_total").alias("pair_total"))
    return got.withColumn("rate", F.round(scoring.ratio("pair_exact", "pair_total"), 6))


@query(f"""WITH {V.EDGES}, {_overlap_sql("source, target, type")}
SELECT difficulty, count(*) AS samples, count(*) FILTER (WHERE exact) AS exact, round(count(*) FILTER (WHERE exact) / CAST(count(*) AS DOUBLE), 6) AS rate FROM s GROUP BY difficulty""")
def image_exact_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, gold = _edges(spark, sf_dir)
    got = scoring.overlap(pred, gold, _KEYS, ["source", "target", "type"]).groupBy("difficulty").agg(F.count("*").alias("samples"), F.count_if("exact").alias("exact"))
    return got.withColumn("rate", F.round(scoring.ratio("exact", "samples"), 6))


@query(f"""WITH {V.EDGES}, {_overlap_sql("source, target, type")},
g AS (SELECT sample_id, count(*) > 20 AS has_many, count(DISTINCT type) > 2 AS has_types, max(qty) > 49 AS has_large FROM edges_gold GROUP BY sample_id),
x AS (SELECT s.*, unnest(list_filter([CASE WHEN has_many THEN 'has_many' END, CASE WHEN has_types THEN 'has_types' END, CASE WHEN has_large THEN 'has_large' END], lambda v: v IS NOT NULL)) AS tag FROM s JOIN g USING (sample_id))
SELECT tag, count(*) AS samples, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(gt) AS BIGINT) AS gt FROM x GROUP BY tag""")
def tag_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, gold = _edges(spark, sf_dir)
    tags = gold.groupBy("sample_id").agg((F.count("*") > 20).alias("has_many"), (F.count_distinct("type") > 2).alias("has_types"), (F.max("qty") > 49).alias("has_large"))
    rows = scoring.overlap(pred, gold, _KEYS, ["source", "target", "type"]).join(tags, "sample_id")
    return reports.tag_report(rows, ["has_many", "has_types", "has_large"], [F.count("*").alias("samples"), F.sum("tp").alias("tp"), F.sum("gt").alias("gt")])


@query(f"""WITH {V.EDGES}, {_overlap_sql("source, target, type")}
SELECT domain, count(*) AS samples, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(pred) AS BIGINT) AS pred, CAST(sum(gt) AS BIGINT) AS gt FROM s GROUP BY domain""")
def shard_merge_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards scored apart and merged."""
    pred, gold = _edges(spark, sf_dir)
    part = lambda d, k: d.filter(F.col("sample_id") % 4 == k)
    shards = [scoring.overlap(part(pred, k), part(gold, k), _KEYS, ["source", "target", "type"]) for k in range(4)]
    return reports.merge_shards(shards, 4).groupBy("domain").agg(F.count("*").alias("samples"), *(F.sum(c).alias(c) for c in ("tp", "pred", "gt")))


@query(f"""WITH {V.NODES}, b AS (SELECT sample_id, name, sum(p) AS p, sum(g) AS g FROM (
  SELECT sample_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS name, 1 AS p, 0 AS g FROM pred_nodes WHERE pos % 11 <> 4
  UNION ALL SELECT sample_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 0, 1 FROM nodes) u GROUP BY ALL)
SELECT sample_id, CAST(sum(least(p, g)) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS pred, CAST(sum(g) AS BIGINT) AS gt, bool_and(p = g) AS exact FROM b GROUP BY sample_id""")
def node_name_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = V.nodes(spark, sf_dir).select("sample_id", "pos", normalize_name("name").alias("name"))
    return scoring.overlap(gold.filter("pos % 11 <> 4"), gold, ["sample_id"], ["name"])


_NAME = "regexp_replace(lower(name), '[^a-z0-9]', '', 'g')"


@query(f"""WITH {V.NODES}, p AS (SELECT sample_id, {_NAME} AS n, id, row_number() OVER (PARTITION BY sample_id, {_NAME} ORDER BY CAST(substr(id, 2) AS BIGINT), pos) AS r FROM pred_nodes WHERE pos % 11 <> 4),
g AS (SELECT sample_id, {_NAME} AS n, id, row_number() OVER (PARTITION BY sample_id, {_NAME} ORDER BY CAST(substr(id, 2) AS BIGINT), pos) AS r FROM nodes)
SELECT p.sample_id, p.id AS pred_id, g.id AS gold_id FROM p JOIN g USING (sample_id, n, r)""")
def node_match_boxless(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = V.nodes(spark, sf_dir).withColumn("box", F.array().cast("array<double>"))
    return matching.match_nodes(gold.filter("pos % 11 <> 4"), gold)


@query()
def node_match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL form: each choice depends on those before it. tests/ holds it against a plain loop."""
    gold = V.nodes(spark, sf_dir)
    return matching.match_nodes(gold.filter("pos % 11 <> 4").withColumn("box", F.col("pred_box")), gold)


_IOU = """greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"""


@query(f"""WITH {V.NODES}, i AS (SELECT a.pos, {_IOU} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM nodes a JOIN pred_nodes b USING (pos))
SELECT pos, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 6) AS iou FROM i ORDER BY iou DESC, pos LIMIT 50""")
def box_iou_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nodes(spark, sf_dir).select("pos", F.round(G.box_iou("box", "pred_box"), 6).alias("iou")).orderBy(F.desc("iou"), "pos").limit(50)


@query(f"""WITH {V.NODES}, m AS (SELECT a.sample_id, a.id AS pred_id FROM nodes a WHERE pos % 3 <> 0)
SELECT e.sample_id, coalesce(a.pred_id, 'UNMATCHED:' || e.source) AS source, coalesce(b.pred_id, 'UNMATCHED:' || e.target) AS target, e.type FROM (
  SELECT sample_id, id AS source, 'n' || ((pos + 7) % 20 + 1) AS target, name AS type FROM nodes) e LEFT JOIN m a ON a.sample_id = e.sample_id AND a.pred_id = e.source LEFT JOIN m b ON b.sample_id = e.sample_id AND b.pred_id = e.target""")
def edge_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nodes(spark, sf_dir)
    edges = n.select("sample_id", F.col("id").alias("source"), F.concat(F.lit("n"), (F.col("pos") + 7) % 20 + 1).alias("target"), F.col("name").alias("type"))
    return matching.remap_edges(edges, n.filter("pos % 3 <> 0").select("sample_id", F.col("id").alias("pred_id"), F.col("id").alias("gold_id"))).select("sample_id", "source", "target", "type")


@query(f"""WITH {V.EDGES}, {_overlap_sql("source, target, type")}, n AS (SELECT sample_id, count(*) AS n FROM edges_gold GROUP BY 1)
SELECT s.sample_id, CAST(s.tp AS BIGINT) AS typed_tp, CAST(s.pred AS BIGINT) AS typed_pred, CAST(s.gt AS BIGINT) AS typed_gt, CAST(s.exact AS INTEGER) AS sample_multigraph_exact FROM s""")
def sample_scores_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, gold = _edges(spark, sf_dir)
    names = lambda d: d.select("sample_id", F.col("source").alias("name"))
    mapping = gold.select("sample_id", F.col("source").alias("pred_id")).distinct()
    wide = scoring.sample_scores(names(pred), names(gold), mapping, pred, gold, gold.select("sample_id").distinct())
    return wide.select("sample_id", *(F.col(c).cast("long").alias(c) for c in ("typed_tp", "typed_pred", "typed_gt")), "sample_multigraph_exact")


def _trace_sql() -> str:
    e = lambda t, k: f"(CAST({t}.embedding[{k}] AS DOUBLE) * 1000)"
    d = lambda i, j: f"sqrt(pow({e('p', 2 * i + 1)} - {e('g', 2 * j + 1)}, 2) + pow({e('p', 2 * i + 2)} - {e('g', 2 * j + 2)}, 2))"
    l2 = "(" + " + ".join(d(i, i) for i in range(5)) + ") / 5"
    one = " + ".join("least(" + ", ".join(d(i, j) for j in range(5)) + ")" for i in range(5))
    two = " + ".join("least(" + ", ".join(d(i, j) for i in range(5)) + ")" for j in range(5))

    def gap(point: int, box: int) -> str:
        axis = lambda k: f"greatest(least({e('g', box + k)}, {e('g', box + k + 2)}) - {e('p', point + k)}, 0.0, {e('p', point + k)} - greatest({e('g', box + k)}, {e('g', box + k + 2)}))"
        return f"sqrt(pow({axis(0)}, 2) + pow({axis(1)}, 2))"

    return f"""WITH pred AS (SELECT vec_id - 1 AS vec_id, embedding FROM embeddings WHERE vec_id > 0 AND vec_id % 7 <> 3),
x AS (SELECT g.vec_id // 5 AS sample_id, p.vec_id IS NOT NULL AS joined, p.vec_id IS NOT NULL AND p.vec_id % 9 <> 2 AS ok, {l2} AS l2, (({one}) / 5 + ({two}) / 5) / 2 AS ch, {gap(1, 11)} AS d1, {gap(9, 15)} AS d2 FROM embeddings g LEFT JOIN pred p ON g.vec_id = p.vec_id),
s AS (SELECT sample_id, count(*) AS gold, count(*) FILTER (WHERE joined) AS joined, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE ok AND d1 <= 12) AS s12, count(*) FILTER (WHERE ok AND d2 <= 12) AS e12, count(*) FILTER (WHERE ok AND d1 <= 12 AND d2 <= 12) AS b12,
  count(*) FILTER (WHERE ok AND d1 <= 20) AS s20, count(*) FILTER (WHERE ok AND d2 <= 20) AS e20, sum(CASE WHEN ok THEN l2 END) AS l2, sum(CASE WHEN ok THEN ch END) AS ch FROM x GROUP BY 1),
t AS (SELECT CAST(gold AS VARCHAR) AS degree, count(*) AS groups, CAST(sum(gold) AS BIGINT) AS gold_traces, CAST(sum(joined) AS BIGINT) AS joined, CAST(sum(valid) AS BIGINT) AS valid5, CAST(sum(s12) AS BIGINT) AS s12, CAST(sum(e12) AS BIGINT) AS e12, CAST(sum(b12) AS BIGINT) AS both_within_12,
  CAST(sum(s20) AS BIGINT) AS start_within_20, CAST(sum(e20) AS BIGINT) AS e20, CAST(count(*) FILTER (WHERE joined = gold) AS BIGINT) AS id_set_exact, count(*) FILTER (WHERE sample_id % 4 <> 0) AS closed, sum(l2) AS l2, sum(ch) AS ch FROM s GROUP BY gold)
SELECT degree, groups, gold_traces, joined, valid5, both_within_12, start_within_20, id_set_exact, closed, round(joined / gold_traces, 6) AS trace_recall, round(valid5 / gold_traces, 6) AS valid5_per_gold, coalesce(round(valid5 / nullif(joined, 0), 6), 0) AS valid5_per_joined,
  round(id_set_exact / groups, 6) AS id_set_exact_rate, round(closed / groups, 6) AS closed_rate, {", ".join(f"coalesce(round({a} / nullif(valid5, 0), 6), 0) AS {n}" for a, n in (("s12", "start_within_12_rate"), ("e12", "end_within_12_rate"), ("both_within_12", "both_within_12_rate"), ("start_within_20", "start_within_20_rate"), ("e20", "end_within_20_rate")))},
  round(l2 / nullif(valid5, 0), 4) AS mean_aligned_l2, round(ch / nullif(valid5, 0), 4) AS mean_chamfer FROM t"""


@query(_trace_sql())
def trace_metrics_by_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth prediction is no valid trace, every fourth output isn't closed."""
    pred, gold = V.traces(spark, sf_dir)
    bad = (F.col("sample_id") * 5 + F.substring("edge_id", 2, 1).cast("long")) % 9 == 2
    scores = scoring.trace_scores(pred.withColumn("points", F.when(~bad, F.col("points"))), gold)
    scores = scores.withColumns({"degree": F.col("gold_traces").cast("string"), "closed": (F.col("sample_id") % 4 != 0).cast("int")})
    rates = ["trace_recall", "valid5_per_gold", "valid5_per_joined", "id_set_exact_rate", "closed_rate", "start_within_12_rate", "end_within_12_rate", "both_within_12_rate", "start_within_20_rate", "end_within_20_rate"]
    return reports.trace_rates(scores, ["degree"]).select("degree", "groups", "gold_traces", "joined", "valid5", "both_within_12", "start_within_20", "id_set_exact", "closed", *rates, "mean_aligned_l2", "mean_chamfer")
