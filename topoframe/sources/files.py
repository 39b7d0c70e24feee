"""File sources and sinks of manifests, documents, prediction texts and images."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topoframe.functions.text import sample_key


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, max_samples: int | None = None, missing_ok: bool = False, strict: bool = False) -> DataFrame:
    """JSON lines under a declared schema. Blank lines are skipped but count towards ``max_samples``, a limit on physical lines.

    strict: broken (and, with a limit, blank) lines raise. missing_ok: no file gives no rows.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    try:
        if max_samples is None:
            return spark.read.schema(schema).options(**mode).json(path)
        lines = spark.read.text(path)
    except AnalysisException as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    # the limit is on the file's first lines: they are the first ones in (file, block) order
    order = Window.orderBy("_file", "_block", "_id")
    numbered = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    numbered = numbered.orderBy("_file", "_block", "_id").limit(max_samples).withColumn("_n", F.row_number().over(order))
    kept = numbered if strict else numbered.filter(F.trim("value") != "")
    return kept.orderBy("_n").select(F.from_json("value", schema, mode).alias("r")).select("r.*")


def documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A tree of JSON documents, one row each, with its path."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).withColumn("path", F.col("_metadata.file_path"))


def manifest(df: DataFrame, domains: list[str] | None = None, splits: list[str] | None = None, difficulties: list[str] | None = None) -> DataFrame:
    """A manifest under optional IN filters (pushed to the scan), with its key."""
    for column, values in (("domain", domains), ("split", splits), ("difficulty", difficulties)):
        if values:
            df = df.filter(F.col(column).isin(values))
    return df.withColumn("key", sample_key("unified_sample_id" if "unified_sample_id" in df.columns else "sample_id", "sample_id"))


def prediction_texts(spark: SparkSession, path: str) -> DataFrame:
    """(stem, grp, kind, text): {stem}.nodes.txt, {stem}.gNN.edge_graph.txt or {stem}.txt."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))
    shape = r"^(.*?)(?:\.g(\d+))?(?:\.(nodes|edge_graph))?\.txt$"
    return raw.select(F.regexp_extract("file", shape, 1).alias("stem"), F.regexp_extract("file", shape, 2).try_cast("int").alias("grp"), F.regexp_extract("file", shape, 3).alias("kind"), "text")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, data_url) of binary files; the type is png unless the name says jpeg, webp or gif."""
    files = spark.read.format("binaryFile").load(path)
    low = F.lower("path")
    mime = F.when(low.rlike(r"\.jpe?g$"), "image/jpeg").when(low.endswith(".webp"), "image/webp").when(low.endswith(".gif"), "image/gif").otherwise("image/png")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("content")).alias("data_url"))


def file_counts(paths: DataFrame, path: str = "path") -> DataFrame:
    """Files by split and difficulty, the two folders above them."""
    parts = F.split(path, "/")
    return paths.groupBy(F.get(parts, F.size(parts) - 3).alias("split"), F.get(parts, F.size(parts) - 2).alias("difficulty")).agg(F.count("*").alias("files"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, nulls written; mode overwrite or append lifts the guard against existing output."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_partitioned(df: DataFrame, path: str, keys: tuple[str, ...] = ("split", "domain", "difficulty"), mode: str = "errorifexists") -> None:
    """Folders by keys. The rows are rebalanced by them, so adaptive execution splits the folders of a large group over several tasks."""
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).json(path)


def checkpoints(df: DataFrame, path: str, parts: dict[str, str], mode: str = "overwrite") -> None:
    """Several filtered writes ({name: SQL filter}) of one cached result."""
    held = df.persist()
    try:
        for name, rule in parts.items():
            write_jsonl(held.filter(rule), f"{path}/{name}", mode)
    finally:
        held.unpersist()


def write_report(report: DataFrame, path: str, keys: list[str]) -> None:
    """A small grouped report as one pretty JSON document, ordered by its keys; written by one task."""
    rows = report.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*keys).alias("k"), F.struct(*report.columns).alias("r")))), lambda x: x["r"]).alias("rows"))
    rows.select(F.to_json("rows", {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def task_manifests(folder: str, task: str, train: str | None = None, evaluation: str | None = None, no_eval: bool = False, exists=None) -> tuple[str, str | None]:
    """Paths of a task's manifests: given ones, else {folder}/{task}/{train,val}.jsonl; a missing train file raises, a missing evaluation file is none."""
    from pathlib import Path

    exists = exists or (lambda p: Path(p).exists())
    train = train or f"{folder}/{task}/train.jsonl"
    if not exists(train):
        raise FileNotFoundError(train)
    evaluation = evaluation or f"{folder}/{task}/val.jsonl"
    return train, None if no_eval or not exists(evaluation) else evaluation


def append_log(df: DataFrame, path: str) -> None:
    """Add records to a log; read it back with curation.last_by_key."""
    write_jsonl(df, path, "append")
