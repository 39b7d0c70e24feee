"""Tag parsing, names, prompts, fine-tuning rows and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoframe.functions import text as X
from topoframe.operators import catalogs, parsing, sft, validation

from . import views as V
from .registry import query


@query(r"""WITH f AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-z]+\s+([^>]*)>', 1)) AS frag FROM pages),
a AS (SELECT unnest(regexp_extract_all(frag, '(\w+)="([^"]*)"', 1)) AS attr, unnest(regexp_extract_all(frag, '(\w+)="([^"]*)"', 2)) AS value FROM f)
SELECT attr, count(*) AS n, count(DISTINCT value) AS distinct_values FROM a GROUP BY attr""")
def parse_attr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = V.table(spark, sf_dir, "pages").select(F.explode(X.groups("html", r"<[a-z]+\s+([^>]*)>", 1)).alias("frag"))
    return tags.select(F.explode(X.parse_attrs("frag")).alias("attr", "value")).groupBy("attr").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


def graph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an edge graph: a TRACE before some edges, aimed at the wrong target for every seventh part."""
    part = F.col("l_partkey") % 10
    aim = F.when(F.col("l_partkey") % 7 == 0, part + 1).otherwise(part)
    points = F.when(F.col("l_suppkey") % 3 == 0, "[[1,2],[3,4],[5,6],[7,8]]").otherwise("[[1,2],[3,4],[5,6],[7,8],[9,10]]")
    trace = F.concat(F.lit('<TRACE target="p'), aim, F.lit('" points="'), points, F.lit('" arrow="[1,2]"/>\n'))
    edge = F.concat(F.lit('<EDGE target="p'), part, F.lit('" type="'), "l_returnflag", F.lit('"/>'))
    tag = F.concat(F.when(F.col("l_returnflag") != "N", trace).otherwise(""), edge)
    lines = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", tag.alias("tag")))).alias("t"))
    body = F.array_join(F.transform("t", lambda x: x["tag"]), "\n")
    return lines.select("sample_id", F.concat(F.lit('<EDGE_GRAPH>\n<CHECK_NODE id="o'), "sample_id", F.lit('" name="Order">\n'), body, F.lit("\n</CHECK_NODE>\n</EDGE_GRAPH>")).alias("text"))


@query("""SELECT l_orderkey AS sample_id, 'o' || l_orderkey AS source, 'p' || (l_partkey % 10) AS target, l_returnflag AS type, l_returnflag <> 'N' AND l_partkey % 7 <> 0 AS has_trace,
  count(*) AS n, CAST(sum(CAST(l_returnflag <> 'N' AND l_partkey % 7 <> 0 AND l_suppkey % 3 <> 0 AS INTEGER)) AS BIGINT) AS valid5 FROM lineitem GROUP BY ALL""")
def tag_pairing_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = parsing.edges(graph_texts(spark, sf_dir)).withColumns({"has_trace": F.col("trace").isNotNull(), "ok": F.coalesce("trace.points_valid", F.lit(False))})
    return got.groupBy("sample_id", "source", "target", "type", "has_trace").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("int")).alias("valid5"))


@query("SELECT l_orderkey AS sample_id, true AS has_open, true AS has_close, CAST(count(*) FILTER (WHERE l_returnflag <> 'N') AS INTEGER) AS num_trace_tags, 1 AS num_check_nodes, CAST(NULL AS VARCHAR) AS format_error FROM lineitem GROUP BY 1")
def edge_graph_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.edge_info(graph_texts(spark, sf_dir))


def _node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every graph's nodes as tags, ids repeating after 12; every fifth graph without its opening tag."""
    tag = F.concat(F.lit('<NODE id="n'), F.col("pos") % 12, F.lit('" name="'), F.col("name"), F.lit('" box="['), F.array_join(F.transform("box", lambda v: v.cast("long").cast("string")), ","), F.lit(']"/>'))
    rows = V.nodes(spark, sf_dir).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", tag.alias("t")))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["t"]), "\n")
    return rows.select("sample_id", F.when(F.col("sample_id") % 5 == 0, body).otherwise(F.concat(F.lit("<NODES>\n"), body)).alias("text"))


@query(f"""WITH {V.NODES}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, pos % 12 ORDER BY pos) AS rn FROM nodes)
SELECT sample_id, 'n' || (pos % 12) AS id, name, x1, y1, x2, y2 FROM r WHERE rn = 1""")
def parse_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = parsing.nodes(_node_texts(spark, sf_dir))
    return got.select("sample_id", "id", "name", *(F.get("box", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))


@query(f"""WITH {V.NODES} SELECT sample_id, count(DISTINCT pos % 12) AS n_nodes, CASE WHEN sample_id % 5 = 0 THEN 'recovered_missing_nodes_tag' END AS status FROM nodes GROUP BY sample_id""")
def node_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.node_status(_node_texts(spark, sf_dir))


def _trace_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat(F.lit('<TRACE edge_id="'), F.when(F.col("vec_id") % 6 == 5, "").otherwise(F.concat(F.lit("e"), F.col("vec_id") % 8)), F.lit('" points="[[1,2,9],[3,4,9],[5,6,9],[7,8,9],['), F.col("vec_id") % 3, F.lit(',1]]"/>'))
    rows = V.table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", tag.alias("t")))).alias("r"))
    return rows.select("sample_id", F.concat(F.lit("<TRACES>"), F.array_join(F.transform("r", lambda x: x["t"]), " "), F.when(F.col("sample_id") % 2 == 0, "</TRACES>").otherwise("")).alias("text"))


@query("""WITH t AS (SELECT vec_id // 10 AS sample_id, vec_id, CASE WHEN vec_id % 6 <> 5 THEN 'e' || (vec_id % 8) END AS id FROM embeddings)
SELECT sample_id, CAST(count(*) AS INTEGER) AS raw_traces, CAST(count(id) - count(DISTINCT id) AS INTEGER) AS duplicate_ids, true AS opened, sample_id % 2 = 0 AS closed FROM t GROUP BY sample_id""")
def trace_parse_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.trace_info(_trace_texts(spark, sf_dir))


@query("""WITH t AS (SELECT vec_id // 10 AS sample_id, vec_id, 'e' || (vec_id % 8) AS edge_id FROM embeddings WHERE vec_id % 6 <> 5)
SELECT sample_id, edge_id, CAST(arg_min(vec_id % 3, vec_id) AS DOUBLE) AS last_x FROM t GROUP BY ALL""")
def parse_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.traces(_trace_texts(spark, sf_dir)).select("sample_id", "edge_id", F.get(F.get("points", F.lit(4)), F.lit(0)).alias("last_x"))


@query("""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name, trim(regexp_replace(lower(trim(p_brand || ' ' || p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""")
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").select("p_partkey", X.normalize_name("p_name").alias("name"), X.slugify(F.concat_ws(" ", "p_brand", "p_type")).alias("slug"))


@query("""WITH m AS (SELECT conv_id, turn, role, text FROM conversations), f AS (SELECT conv_id, arg_min(trim(text), turn) AS system_prompt, arg_max(text, turn) AS last, count(*) AS n FROM m GROUP BY conv_id)
SELECT conv_id, coalesce(system_prompt, '') AS system_prompt, coalesce(nullif(last, ''), '{}') AS answer, n AS turns FROM f""")
def sft_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in turn order; the system prompt is the first message's text, the answer the last one's."""
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    rows = V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", part.alias("content")))).alias("messages"))
    last = F.get(F.element_at("messages", -1)["content"], F.lit(0))["text"]
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"assistant_text": none, "answer_": last, "answer": last, "response": none, "target": none, "final_graph": none})
    return rows.select("conv_id", sft.system_prompt("messages").alias("system_prompt"), sft.answer().alias("answer"), F.size("messages").cast("long").alias("turns"))


@query(f"""WITH {V.NODES}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS rn FROM nodes)
SELECT sample_id, CAST(floor((rn - 1) / 3) AS BIGINT) + 1 AS grp, count(*) AS n, min(id) AS first_id FROM r GROUP BY ALL""")
def prompt_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft.prompt_groups(V.nodes(spark, sf_dir), "sample_id", ["pos"], 3).groupBy("sample_id", "grp").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""WITH d AS (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents), k AS (SELECT doc_id, n, CASE WHEN n <= 5 THEN 0 WHEN n <= 7 THEN n - 5 ELSE n - 6 END AS kept FROM d)
SELECT doc_id, CAST(kept AS BIGINT) AS kept, CAST(CASE WHEN n <= 5 THEN 0 ELSE n * (n - 1) // 2 - 10 - CASE WHEN n > 7 THEN 7 ELSE 0 END END - 100 * (n - kept) AS BIGINT) AS total FROM k""")
def loss_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids 0, 1, 2, ..., one for each character of the whole text; a prompt of five, padding id 7. An empty text has no ids."""
    n = F.coalesce(F.col("n_chars"), F.lit(0)).cast("long")
    ids = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    got = V.table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).select("doc_id", sft.loss_mask("ids", F.lit(5), 7).alias("x"))
    return got.select("doc_id", F.size(F.filter("x", lambda v: v != -100)).cast("long").alias("kept"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("""SELECT p.p_name AS label, s.style, v.variant, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') || '_' || s.style || '_' || lpad(CAST(v.variant AS VARCHAR), 2, '0') || '.png' AS file,
  'A ' || s.style || ' icon of ' || p_name AS prompt FROM part p, (VALUES ('flat'), ('line')) s(style), (VALUES (1), (2), (3)) v(variant)""")
def asset_jobs_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = V.table(spark, sf_dir, "part").select(F.col("p_name").alias("label"))
    jobs = catalogs.prompt_jobs(labels, ["flat", "line"], 3, F.concat(F.lit("A "), F.col("style"), F.lit(" icon of "), F.col("label")))
    return jobs.select("label", "style", "variant", "file", "prompt")


@query("""WITH l AS (SELECT DISTINCT p_brand AS label, p_type AS c FROM part UNION SELECT DISTINCT p_brand, 'size' || (p_size % 3) FROM part) SELECT c AS category, count(*) AS n, min(label) AS first_label FROM l GROUP BY c""")
def labels_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = V.table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.col("p_type").alias("category"), F.concat(F.lit("size"), F.col("p_size") % 3).alias("role"))
    got = catalogs.labels_by_category(labels)
    return got.select("category", F.size(F.array_distinct("labels")).cast("long").alias("n"), F.get("labels", F.lit(0)).alias("first_label"))


@query("""WITH a AS (SELECT p_brand AS label, p_type AS style, min('f' || p_partkey) AS f FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL), b AS (SELECT label, min(f) AS f FROM a GROUP BY label)
SELECT p.p_partkey, coalesce(a.f, b.f) AS asset FROM part p LEFT JOIN a ON a.label = p.p_brand AND a.style = p.p_type LEFT JOIN b ON b.label = p.p_brand""")
def assign_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = V.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("label"), F.col("p_type").alias("style"))
    return catalogs.assign_assets(parts, parts.filter("p_partkey % 3 = 0").withColumn("file", F.concat(F.lit("f"), "p_partkey"))).select("p_partkey", "asset")


@query("""WITH k AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ['k'] ELSE ['k', 'extra'] END AS have FROM events), w AS (SELECT ['k', 'v'] AS want)
SELECT CAST(event_id AS VARCHAR) AS path, 'missing_key' AS rule, 'v' AS detail FROM k UNION ALL SELECT CAST(event_id AS VARCHAR), 'extra_key', 'extra' FROM k WHERE event_id % 3 <> 0""")
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = V.table(spark, sf_dir, "events")
    json = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.regexp_replace("props", r"\}$", ', "extra": 1}'))
    return validation.key_violations(events.select(F.col("event_id").cast("string").alias("path"), json.alias("json")), ["k", "v"])


@query("""SELECT sha256(text) AS sha256, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"))
