"""Topology views over the star-schema and text tables, in DataFrames, with their SQL twins as common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed multigraph per customer: order priority -> supplier nation, typed by return flag."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    bal = F.col("c_acctbal")
    level = F.when(bal < 2500, "simple").when(bal < 6500, "medium").otherwise("difficult")
    return rows.select(
        F.col("o_custkey").alias("sample_id"), F.col("c_mktsegment").alias("domain"), level.alias("difficulty"), F.col("o_orderpriority").alias("source"),
        F.col("s_nationkey").cast("string").alias("target"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("ln"), F.col("l_quantity").alias("qty"), F.col("l_orderkey").alias("ok"),
    )


def edges_pred(gold: DataFrame) -> DataFrame:
    """Gold without every third line, and with a wrong type where the quantity is large."""
    return gold.filter("ln <> 3").withColumn("type", F.when(F.col("qty") > 45, "X").otherwise(F.col("type")))


EDGES = """edges_gold AS (SELECT o.o_custkey AS sample_id, c.c_mktsegment AS domain,
  CASE WHEN c.c_acctbal < 2500 THEN 'simple' WHEN c.c_acctbal < 6500 THEN 'medium' ELSE 'difficult' END AS difficulty,
  o.o_orderpriority AS source, CAST(s.s_nationkey AS VARCHAR) AS target, l.l_returnflag AS type, l.l_linenumber AS ln, l.l_quantity AS qty, l.l_orderkey AS ok
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey),
edges_pred AS (SELECT sample_id, domain, difficulty, source, target, CASE WHEN qty > 45 THEN 'X' ELSE type END AS type, ln, qty, ok FROM edges_gold WHERE ln <> 3)"""


def _box(at: int) -> Column:
    e = [F.get("embedding", F.lit(at + k)).cast("double") for k in range(4)]
    scaled = lambda c: F.floor(c * 1000).cast("double")
    return F.array(scaled(F.least(e[0], e[2])), scaled(F.least(e[1], e[3])), scaled(F.greatest(e[0], e[2])), scaled(F.greatest(e[1], e[3])))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nodes a graph, named by label, with a gold box (dimensions 1-4) and a predicted one (5-8)."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / 20).alias("sample_id"), v.alias("pos"), F.concat(F.lit("n"), v % 20 + 1).alias("id"), F.concat(F.lit("Label "), F.col("label")).alias("name"), _box(0).alias("box"), _box(4).alias("pred_box")
    )


def _box_sql(at: int) -> str:
    e = [f"CAST(embedding[{at + k}] AS DOUBLE)" for k in range(1, 5)]
    return ", ".join(f"floor({f}({e[i]}, {e[i + 2]}) * 1000) AS {n}" for f, i, n in (("least", 0, "x1"), ("least", 1, "y1"), ("greatest", 0, "x2"), ("greatest", 1, "y2")))


NODES = f"""nodes AS (SELECT CAST(floor(vec_id / 20) AS BIGINT) AS sample_id, vec_id AS pos, 'n' || (vec_id % 20 + 1) AS id, 'Label ' || label AS name, {_box_sql(0)} FROM embeddings),
pred_nodes AS (SELECT CAST(floor(vec_id / 20) AS BIGINT) AS sample_id, vec_id AS pos, 'n' || (vec_id % 20 + 1) AS id, 'Label ' || label AS name, {_box_sql(4)} FROM embeddings)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    level = F.when(n < 1000, "simple").when(n < 3000, "medium").otherwise("difficult")
    split = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain"), "source", level.alias("difficulty"), split.alias("split"))


MANIFEST = """manifest AS (SELECT doc_id, lang AS domain, source, CASE WHEN n_chars < 1000 THEN 'simple' WHEN n_chars < 3000 THEN 'medium' ELSE 'difficult' END AS difficulty,
  CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled part of the manifest, with a verdict."""
    ok = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return manifest(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("ok", F.coalesce(ok, F.lit(False)))


VERDICTS = MANIFEST + ", verdicts AS (SELECT m.*, l.quality, l.toxic, coalesce(l.quality = 1 AND l.toxic = 0, false) AS ok FROM manifest m JOIN labels l USING (doc_id))"
HASH = "((doc_id * 2654435761) % 4294967296)"


def traces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pred, gold): five points from dimensions 1-10, boxes from 11-18; predictions are the next vector's points."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double") * 1000
    points = F.array(*(F.array(e(2 * i), e(2 * i + 1)) for i in range(5)))
    box = lambda k: F.array(F.least(e(k), e(k + 2)), F.least(e(k + 1), e(k + 3)), F.greatest(e(k), e(k + 2)), F.greatest(e(k + 1), e(k + 3)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", points.alias("points"), box(10).alias("source_box"), box(14).alias("target_box"))
    keys = lambda d: d.select(F.floor(F.col("vec_id") / 5).alias("sample_id"), F.concat(F.lit("e"), F.col("vec_id") % 5).alias("edge_id"), *[c for c in d.columns if c != "vec_id"])
    pred = rows.filter("vec_id > 0 and vec_id % 7 <> 3").select((F.col("vec_id") - 1).alias("vec_id"), "points")
    return keys(pred), keys(rows)
