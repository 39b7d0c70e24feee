"""Splits, quotas, screening, samples and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topoframe.functions import qa
from topoframe.operators import curation, matching, reports, scoring
from topoframe.streaming import monitor

from . import views as V
from .registry import query

ORDER = "doc_id"


def _hash() -> Column:
    return curation.hash_order("doc_id")


@query(f"""WITH {V.MANIFEST}, r AS (SELECT doc_id, domain, difficulty, row_number() OVER (PARTITION BY domain, difficulty ORDER BY {V.HASH}, doc_id) AS rn, count(*) OVER (PARTITION BY domain, difficulty) AS n FROM manifest)
SELECT doc_id, domain, difficulty, CASE WHEN rn <= round_even(n * 600.0::DOUBLE / 6000, 0) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.stratified_split(V.manifest(spark, sf_dir).drop("split", "source"), ["domain", "difficulty"], _hash(), "doc_id")


@query(f"""WITH {V.MANIFEST} SELECT doc_id, domain || '_' || split || '_' || difficulty || '_' || lpad(CAST(row_number() OVER (PARTITION BY domain, split, difficulty ORDER BY doc_id) AS VARCHAR), 6, '0') AS new_id FROM manifest""")
def renumber_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.renumber(V.manifest(spark, sf_dir), ["domain", "split", "difficulty"], "doc_id").select("doc_id", "new_id")


_POOLS = f"""{V.MANIFEST}, pools AS (SELECT domain, split, difficulty, count(*) AS n FROM manifest GROUP BY ALL),
t AS (SELECT *, CAST(floor(sum(n) OVER (PARTITION BY domain, split) / 3.0) AS BIGINT) AS target, sum(n) OVER (PARTITION BY domain, split) AS total FROM pools),
e AS (SELECT *, n * target / CAST(total AS DOUBLE) AS ex FROM t),
q AS (SELECT *, row_number() OVER (PARTITION BY domain, split ORDER BY ex - floor(ex) DESC, difficulty DESC) AS rk, target - sum(floor(ex)) OVER (PARTITION BY domain, split) AS lft FROM e),
quotas AS (SELECT domain, split, difficulty, n, CAST(floor(ex) + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q)"""


def _quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = V.manifest(spark, sf_dir).groupBy("domain", "split", "difficulty").agg(F.count("*").alias("n"))
    totals = pools.groupBy("domain", "split").agg(F.floor(F.sum("n") / 3.0).alias("target"))
    return curation.quotas(pools.join(totals, ["domain", "split"]), ["domain", "split"], "difficulty", "n", "target").drop("target")


@query(f"WITH {_POOLS} SELECT * FROM quotas")
def quota_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotas(spark, sf_dir)


_SCREENED = f"""{V.VERDICTS}, d AS (SELECT doc_id, domain, difficulty, ok, coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY domain, difficulty ORDER BY {V.HASH}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM verdicts),
reviewed AS (SELECT doc_id, domain, difficulty, ok AS selected FROM d WHERE done < 10)"""


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.screen(V.verdicts(spark, sf_dir), ["domain", "difficulty"], [_hash(), F.col("doc_id")], F.col("ok"), F.lit(10))


@query(f"WITH {_SCREENED} SELECT * FROM reviewed")
def quota_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screened(spark, sf_dir).select("doc_id", "domain", "difficulty", "selected")


@query(f"""WITH {_SCREENED}, t AS (SELECT DISTINCT domain, difficulty, CAST(10 AS BIGINT) AS target FROM manifest),
c AS (SELECT domain, difficulty, count(*) AS reviewed, count(*) FILTER (WHERE selected) AS selected FROM reviewed GROUP BY ALL),
x AS (SELECT domain, difficulty, target, coalesce(reviewed, 0) AS reviewed, coalesce(selected, 0) AS selected FROM t LEFT JOIN c USING (domain, difficulty))
SELECT *, reviewed - selected AS failed, greatest(target - selected, 0) AS remaining, selected >= target AS complete FROM x""")
def screening_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = V.manifest(spark, sf_dir).select("domain", "difficulty").distinct().withColumn("target", F.lit(10).cast("long"))
    return curation.screening_progress(_screened(spark, sf_dir), targets, ["domain", "difficulty"])


@query(f"""WITH {V.MANIFEST}, r AS (SELECT doc_id, domain, difficulty, row_number() OVER (PARTITION BY domain, difficulty ORDER BY {V.HASH}, doc_id) AS rn FROM manifest)
SELECT doc_id, domain, difficulty FROM r ORDER BY rn, domain, difficulty LIMIT 100""")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.round_robin(V.manifest(spark, sf_dir).select("doc_id", "domain", "difficulty"), ["domain", "difficulty"], _hash(), "doc_id", 100)


_REBALANCED = f"""{V.MANIFEST}, l AS (SELECT *, row_number() OVER (PARTITION BY domain, difficulty, doc_id % 50 ORDER BY doc_id DESC) AS rn FROM manifest),
kept AS (SELECT * EXCLUDE (rn) FROM l WHERE rn = 1 QUALIFY row_number() OVER (PARTITION BY domain, difficulty ORDER BY {V.HASH}, doc_id) <= 30)"""


def _rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.manifest(spark, sf_dir).withColumn("k", F.col("doc_id") % 50)
    return curation.rebalance(rows, ["domain", "difficulty"], "k", "doc_id", [_hash(), F.col("doc_id")], F.lit(30))


@query(f"WITH {_REBALANCED} SELECT doc_id, domain, difficulty FROM kept")
def rebalance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebalanced(spark, sf_dir).select("doc_id", "domain", "difficulty")


@query(f"""WITH {_REBALANCED}, c AS (SELECT domain, difficulty, count(*) AS kept FROM kept GROUP BY ALL)
SELECT domain, difficulty, CAST(30 AS BIGINT) AS target, kept, greatest(30 - kept, 0) AS shortfall FROM c""")
def rebalance_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = V.manifest(spark, sf_dir).select("domain", "difficulty").distinct().withColumn("target", F.lit(30).cast("long"))
    return curation.shortfalls(_rebalanced(spark, sf_dir), targets, ["domain", "difficulty"])


@query(f"""WITH {V.MANIFEST} SELECT doc_id, domain FROM manifest WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def not_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.not_reviewed(V.manifest(spark, sf_dir), V.table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "domain")


@query("SELECT user_id, event_type, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY ALL")
def last_record_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    n = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return curation.last_by_key(events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id").join(n, ["user_id", "event_type"])


@query("SELECT o_custkey AS stem, min(o_orderkey) AS line, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stem"), F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("priority"))
    return matching.first_graph_per_stem(rows)


@query(f"""WITH {V.MANIFEST}, r AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY {V.HASH}, doc_id) AS rn FROM manifest)
SELECT doc_id, domain FROM r ORDER BY CASE WHEN rn <= 10 THEN 0 ELSE 1 END, {V.HASH}, doc_id LIMIT 40""")
def bucket_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.bucket_preview(V.manifest(spark, sf_dir).select("doc_id", "domain"), "domain", _hash(), "doc_id", 40, 4)


@query(f"""WITH {V.MANIFEST}, c AS (SELECT CASE WHEN grouping(domain) = 0 AND grouping(split) = 0 THEN 'domain+split' WHEN grouping(domain) = 0 AND grouping(difficulty) = 0 THEN 'domain+difficulty'
  WHEN grouping(split) = 0 AND grouping(difficulty) = 0 THEN 'split+difficulty' WHEN grouping(domain) = 0 THEN 'domain' WHEN grouping(split) = 0 THEN 'split' ELSE 'source' END AS set,
  domain, split, difficulty, source, count(*) AS n FROM manifest GROUP BY GROUPING SETS ((domain), (split), (domain, split), (split, difficulty), (domain, difficulty), (source)))
SELECT * FROM c""")
def grouping_sets_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_sets(V.manifest(spark, sf_dir), [["domain"], ["split"], ["domain", "split"], ["split", "difficulty"], ["domain", "difficulty"], ["source"]])


@query(f"""WITH {V.VERDICTS}, s AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'API_ERROR' WHEN doc_id % 13 = 0 THEN 'PARSE_ERROR' ELSE 'OK' END AS status, CASE WHEN ok THEN 4 ELSE 2 END AS score FROM verdicts),
c AS (SELECT CASE WHEN grouping(domain) = 1 AND grouping(difficulty) = 1 THEN 'summary' WHEN grouping(difficulty) = 1 THEN 'by_domain' WHEN grouping(domain) = 1 THEN 'by_difficulty' ELSE 'by_domain_difficulty' END AS report,
  domain, difficulty, count(*) AS records, count(*) FILTER (WHERE status <> 'API_ERROR') AS judged, count(*) FILTER (WHERE status = 'OK' AND ok) AS passed, count(*) FILTER (WHERE status = 'PARSE_ERROR') AS parse_errors,
  count(*) FILTER (WHERE status = 'API_ERROR') AS api_errors, round(avg(score), 6) AS mean_score FROM s GROUP BY GROUPING SETS ((), (domain), (difficulty), (domain, difficulty)))
SELECT *, round(coalesce(passed / nullif(CAST(judged AS DOUBLE), 0), 0), 6) AS pass_rate FROM c""")
def qa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    status = F.when(i % 17 == 0, "API_ERROR").when(i % 13 == 0, "PARSE_ERROR").otherwise("OK")
    result = F.struct(F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("overall"), F.when(F.col("ok"), 4).otherwise(2).alias("quality_score"))
    return reports.qa_summary(V.verdicts(spark, sf_dir).withColumns({"status": status, "result": result}))


_CHECKS = qa.CHECKS


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as free text around a JSON object; case, score, failing check and reasons vary with the key."""
    k = F.col("doc_id")
    checks = F.concat_ws(", ", *(F.concat(F.lit(f'"{n}": "'), F.when(k % 11 == i, "FAIL").otherwise("pass"), F.lit('"')) for i, n in enumerate(_CHECKS)))
    overall = F.when(k % 4 == 0, "fail").when(k % 4 == 1, "").otherwise("PASS")
    reasons = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit(', "failure_reasons": []')).otherwise(F.lit(', "failure_reasons": ["a {brace}", "b"]'))
    body = F.concat(F.lit('{"overall": "'), overall, F.lit('", "checks": {'), checks, F.lit('}, "quality_score": '), (k % 7).cast("string"), reasons, F.lit("}"))
    text = F.when(k % 19 == 0, F.lit("no object")).when(k % 19 == 1, F.concat(F.lit("cut "), F.expr("substring(b, 1, 30)"))).otherwise(F.concat(F.lit("Answer: "), F.col("b"), F.lit(" done {}")))
    return V.table(spark, sf_dir, "documents").select("doc_id", body.alias("b")).select("doc_id", text.alias("text"))


_FAILS = " + ".join(f"CAST(doc_id % 11 = {i} AS INTEGER)" for i in range(len(_CHECKS)))


@query(f"""WITH a AS (SELECT doc_id, doc_id % 7 AS s0, ({_FAILS}) = 0 AS all_pass, CASE WHEN doc_id % 4 = 0 THEN 'FAIL' WHEN doc_id % 4 = 1 THEN NULL ELSE 'PASS' END AS said FROM documents WHERE doc_id % 19 > 1),
b AS (SELECT *, coalesce(said, CASE WHEN all_pass THEN 'PASS' ELSE 'FAIL' END) AS o0, greatest(1, least(5, s0)) AS s FROM a),
c AS (SELECT *, CASE WHEN o0 = 'PASS' AND all_pass AND s >= 3 THEN 'PASS' ELSE 'FAIL' END AS o FROM b),
d AS (SELECT *, CAST(said IS NULL AS INTEGER) + CAST(o0 = 'PASS' AND NOT all_pass AS INTEGER) + CAST(o0 = 'PASS' AND all_pass AND s < 3 AS INTEGER) + CAST(o = 'FAIL' AND s > 2 AS INTEGER)
  + CAST(doc_id % 3 = 0 AND o = 'FAIL' AS INTEGER) + CAST(doc_id % 3 = 2 AND o = 'PASS' AS INTEGER) AS w FROM c)
SELECT doc_id, 'OK' AS status, NULL AS parse_error, o AS overall, CAST(CASE WHEN o = 'FAIL' AND s > 2 THEN 2 ELSE s END AS INTEGER) AS quality_score, CAST(w AS INTEGER) AS n_warnings, CAST(CASE WHEN doc_id % 3 = 2 AND o = 'FAIL' THEN 2 ELSE 0 END AS INTEGER) AS n_reasons FROM d
UNION ALL SELECT doc_id, 'PARSE_ERROR', CASE WHEN doc_id % 19 = 0 THEN 'missing_json_object' ELSE 'truncated_json_object' END, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 19 <= 1""")
def qa_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa.qa_records(_answers(spark, sf_dir))
    size = lambda c: F.when(F.col("result").isNotNull(), F.size(c))
    return rows.select("doc_id", "status", "parse_error", "result.overall", "result.quality_score", size("result.warnings").alias("n_warnings"), size("result.failure_reasons").alias("n_reasons"))


@query(f"""WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 19 > 1), c AS (SELECT unnest({_CHECKS!r}) AS "check", unnest(range({len(_CHECKS)})) AS i)
SELECT "check", count(*) FILTER (WHERE doc_id % 11 = i) AS failed, count(*) AS n FROM a, c GROUP BY "check" """)
def check_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.check_failures(qa.qa_records(_answers(spark, sf_dir)))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, count(*) FILTER (WHERE value > 10) AS passed, round(count(*) FILTER (WHERE value > 10) / CAST(count(*) AS DOUBLE), 6) AS rate FROM events GROUP BY ALL""")
def running_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.pass_rate(V.table(spark, sf_dir, "events"), "ts", F.col("value") > 10, "1 hour", keys=["event_type"])


@query("""WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start, value FROM events)
SELECT window_start, count(*) AS n, count(*) FILTER (WHERE value > 10) AS passed, round(count(*) FILTER (WHERE value > 10) / CAST(count(*) AS DOUBLE), 6) AS rate FROM w GROUP BY 1""")
def sliding_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.pass_rate(V.table(spark, sf_dir, "events"), "ts", F.col("value") > 10, "1 hour", "30 minutes")


@query("SELECT error, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'missing_edge_graph' WHEN o_orderkey % 5 = 1 THEN 'missing_edge_graph_close' END AS error FROM orders) e WHERE error IS NOT NULL GROUP BY error")
def format_error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topoframe.operators import parsing

    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "plain").when(k % 5 == 1, "<EDGE_GRAPH>").otherwise("<EDGE_GRAPH></EDGE_GRAPH>")
    info = parsing.edge_info(V.table(spark, sf_dir, "orders").select(k.alias("sample_id"), text.alias("text")))
    counted = info.filter("format_error is not null").select(F.create_map("format_error", F.lit(1).cast("long")).alias("errors"))
    return reports.error_histogram(counted, "errors")
