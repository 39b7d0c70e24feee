"""Grouped reports over per-sample counters, in one pass by grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import prf, ratio


def named_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Null keys become 'None' before any grouping, so they can't be taken for a total."""
    return df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys})


def cube_report(df: DataFrame, aggs: list[Column], domain: str = "domain", difficulty: str = "difficulty") -> DataFrame:
    """(report, domain, difficulty, aggs): summary, by_domain, by_difficulty and by_domain_difficulty rows."""
    cube = named_keys(df, domain, difficulty).cube(domain, difficulty).agg(F.grouping_id().alias("_id"), *aggs)
    report = F.when(F.col("_id") == 3, "summary").when(F.col("_id") == 1, "by_domain").when(F.col("_id") == 2, "by_difficulty").otherwise("by_domain_difficulty")
    return cube.withColumn("report", report).drop("_id")


def tag_report(df: DataFrame, tags: list[str], aggs: list[Column]) -> DataFrame:
    """One row per tag that holds for some sample; a sample counts in each of its tags."""
    held = F.array_compact(F.array(*(F.when(F.coalesce(F.col(t), F.lit(False)), F.lit(t)) for t in tags)))
    return df.withColumn("tag", F.explode(held)).groupBy("tag").agg(*aggs)


def score_sums() -> list[Column]:
    """Sums of sample_scores() columns."""
    names = ["node_tp", "node_pred", "node_gt", "endpoint_tp", "endpoint_pred", "endpoint_gt", "typed_tp", "typed_pred", "typed_gt", "pair_exact", "pair_total", "node_mapped", "node_count_exact", "sample_multigraph_exact"]
    return [F.count("*").alias("samples"), *(F.sum(n).cast("long").alias(n) for n in names)]


def with_rates(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of nodes, endpoints and typed edges, and the exactness rates, from summed counters."""
    rates = {"node_mapping_rate": ("node_mapped", "node_gt"), "node_count_exact_rate": ("node_count_exact", "samples"), "pair_exact_rate": ("pair_exact", "pair_total"), "image_exact_rate": ("sample_multigraph_exact", "samples")}
    out = df.select("*", *prf("node_"), *prf("endpoint_"), *prf("typed_"))
    return out.withColumns({k: F.round(ratio(a, b), 6) for k, (a, b) in rates.items()})


def trace_rates(df: DataFrame, group: list[str]) -> DataFrame:
    """Sums and rates of trace_scores() rows. Ends and distances are per valid trace; mean distances are null where nothing was valid.

    Counters of the raw output (raw_traces, duplicate_ids, opened, closed) are summed where df has them.
    """
    names = ["gold_traces", "pred_traces", "joined", "unknown_ids", "valid5", "start_within_12", "end_within_12", "both_within_12", "start_within_20", "end_within_20", "count_exact", "id_set_exact"]
    names += [n for n in ("raw_traces", "duplicate_ids", "opened", "closed") if n in df.columns]
    out = df.groupBy(*group).agg(F.count("*").alias("groups"), *(F.sum(n).cast("long").alias(n) for n in names), F.sum("aligned_l2_sum").alias("_l2"), F.sum("chamfer_sum").alias("_ch"))
    rates = {"trace_recall": ("joined", "gold_traces"), "valid5_per_gold": ("valid5", "gold_traces"), "valid5_per_joined": ("valid5", "joined"), "count_exact_rate": ("count_exact", "groups"), "id_set_exact_rate": ("id_set_exact", "groups")}
    rates |= {f"{n}_rate": (n, "valid5") for n in ("start_within_12", "end_within_12", "both_within_12", "start_within_20", "end_within_20")} | ({"closed_rate": ("closed", "groups")} if "closed" in names else {})
    out = out.withColumns({k: F.round(ratio(a, b), 6) for k, (a, b) in rates.items()})
    return out.withColumns({"mean_aligned_l2": F.round(F.try_divide("_l2", "valid5"), 4), "mean_chamfer": F.round(F.try_divide("_ch", "valid5"), 4)}).drop("_l2", "_ch")


def output_rates(df: DataFrame, group: list[str]) -> DataFrame:
    """Sums and rates of scoring.output_counters() rows: traces per predicted edge, and groups of malformed output."""
    names = ["trace_present", "trace_valid5", "pred_edges", "edge_groups", "edge_format_errors"]
    out = df.groupBy(*group).agg(*(F.sum(n).cast("long").alias(n) for n in names))
    rates = {"trace_present_per_pred_edge": ("trace_present", "pred_edges"), "trace5_valid_per_pred_edge": ("trace_valid5", "pred_edges"), "edge_group_format_error_rate": ("edge_format_errors", "edge_groups")}
    return out.withColumns({k: F.round(ratio(a, b), 6) for k, (a, b) in rates.items()})


def error_histogram(df: DataFrame, errors: str, group: list[str] | None = None) -> DataFrame:
    """Merged counters of a map<string, bigint> column."""
    rows = df.select(*(group or []), F.explode(errors).alias("error", "n"))
    return rows.groupBy(*(group or []), "error").agg(F.sum("n").cast("long").alias("n"))


def merge_shards(shards: list[DataFrame], expected: int) -> DataFrame:
    """Union of all shards' per-sample rows; counters add up, so reports over it equal a single run's."""
    if len(shards) != expected:
        raise ValueError(f"{len(shards)} of {expected} shards")
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def count_sets(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Counts over several groupings in one scan: (set, keys, n); ``set`` names the grouping."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    named = named_keys(df, *keys).select(*keys)
    got = named.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys)).agg(F.grouping_id().alias("_id"), F.count("*").alias("n"))
    ids = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s): "+".join(s) or "all" for s in sets}
    label = F.create_map(*(F.lit(x) for item in ids.items() for x in item))
    return got.withColumn("set", label[F.col("_id").cast("int")]).drop("_id")


def qa_summary(records: DataFrame) -> DataFrame:
    """(domain, difficulty, report, ...) of QA records: pass rate without API errors, statuses and the mean score."""
    judged = F.col("status") != "API_ERROR"
    passed = passed_flag()
    aggs = [
        F.count("*").alias("records"), F.count_if(judged).alias("judged"), F.count_if(passed).alias("passed"), F.count_if(F.col("status") == "PARSE_ERROR").alias("parse_errors"),
        F.count_if(F.col("status") == "API_ERROR").alias("api_errors"), F.round(F.avg("result.quality_score"), 6).alias("mean_score"),
    ]
    return cube_report(records, aggs).withColumn("pass_rate", F.round(ratio("passed", "judged"), 6))


def check_failures(records: DataFrame) -> DataFrame:
    """How often each named check failed."""
    rows = records.filter(F.col("result").isNotNull()).select(F.explode("result.checks").alias("check", "verdict"))
    return rows.groupBy("check").agg(F.count_if(F.col("verdict") != "PASS").alias("failed"), F.count("*").alias("n"))


def passed_flag() -> Column:
    """status OK and overall PASS; anything missing is not a pass."""
    return F.coalesce((F.col("status") == "OK") & (F.col("result.overall") == "PASS"), F.lit(False))


def qa_histograms(records: DataFrame) -> DataFrame:
    """(kind, value, n) of QA records in one pass: API errors by message; of the other records scores, parse errors and failed checks."""
    api, result = F.col("status") == "API_ERROR", F.col("result")
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    error = F.coalesce("parse_error", F.lit("None"))
    failed = F.transform(F.map_keys(F.map_filter(result["checks"], lambda _, v: v == "FAIL")), lambda c: entry("check_failures", c))
    judged = F.concat(
        F.array_compact(F.array(F.when(result["quality_score"].isNotNull(), entry("quality_scores", result["quality_score"])), F.when(F.coalesce("parse_error", F.lit("")) != "", entry("parse_errors", F.col("parse_error"))))),
        F.coalesce(failed, F.expr("cast(array() as array<struct<kind:string,value:string>>)")),
    )
    rows = records.select(F.explode(F.when(F.coalesce(api, F.lit(False)), F.array(entry("api_errors", error))).otherwise(judged)).alias("x"))
    return rows.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
