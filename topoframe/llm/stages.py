"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, packing, secrets, toxicity
from .common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at 0.7 or more go; null and empty texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter(F.col(f"`{toxicity.SCORE}`") < 0.7).drop(toxicity.SCORE)


#: A name that no table is expected to use, and the numbers from which rows without an id of their own are named.
NODE, FIRST_NAMED = "near copies node 7c1e", 1 << 62


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by five-word shingles at a similarity of 0.8 one stays: the one with the smallest id.

    Rows are judged by their own texts: of rows that share an id each text is a node of its own, and so is a text without an id;
    where they are copies of a row with an id of its own, that one stays. Of rows equal in id and text the least by all columns
    stays. Null and empty texts, and texts of white space, have no copies and stay, repeated ones too.
    """
    text = F.xxhash64("text")
    shared = written(docs.groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).filter("doc_id is null or a <> b").select(F.col("doc_id").alias("b"), F.lit(True).alias("a")), "shared-ids")
    named, node = docs, F.col("doc_id")
    if not shared.isEmpty():  # ids are at most as many as rows; a join of its own only where there are such ids
        marks = shared.select(F.col("b").alias(f"{NODE} id"), F.col("a").alias(f"{NODE} shared"))
        named = docs.join(marks, F.col("doc_id").eqNullSafe(F.col(f"{NODE} id")), "left")
        own = F.lit(FIRST_NAMED) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61))
        node = F.when(F.col(f"{NODE} shared"), own).otherwise(F.col("doc_id"))
    named = named.select(*docs.columns, node.alias(NODE))
    classes = written(jaccard.jaccard_classes(named.select(NODE, "text"), width=5, percent=80, id_col=NODE), "near-copies")
    gone = classes.filter("not kept").select(F.col("doc_id").alias(NODE)).distinct()
    left = named.join(gone, NODE, "left_anti").select(*docs.columns, NODE)
    twice = written(classes.filter("kept and n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(NODE)), "repeated-rows")
    if twice.isEmpty():
        return left.drop(NODE)
    first = left.join(twice, NODE, "left_semi").groupBy(NODE).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(twice, NODE, "left_anti").select(*docs.columns).unionByName(first)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows the text."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


#: The stages before leave the executors' memory fuller than the operator alone finds it.
PACK_WORDS = 200_000


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2, words=PACK_WORDS)
