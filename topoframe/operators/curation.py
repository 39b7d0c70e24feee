"""Splits, quotas, screening, samples and rebalancing.

Where an order must be random but reproducible, it is a hash of the row's key (``order``), so that any partitioning gives the same
rows. Tie-breaks are part of every order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str) -> Column:
    """A multiplicative hash of the low 31 bits of an integer key, below 2**32; any long is a key."""
    return (F.pmod(F.col(key).cast("long"), F.lit(1 << 31)) * F.lit(2654435761)) % F.lit(4294967296)


def stratified_split(rows: DataFrame, strata: list[str], order: Column, key: str, share: tuple[int, int] = (600, 6000)) -> DataFrame:
    """split = test for the first round-half-even(n * share) rows of every stratum in hash order, else train."""
    w = Window.partitionBy(*strata)
    n_test = F.bround(F.count("*").over(w).cast("double") * share[0] / share[1])
    rank = F.row_number().over(w.orderBy(order, key))
    return rows.withColumn("split", F.when(rank <= n_test, "test").otherwise("train"))


def renumber(rows: DataFrame, strata: list[str], path: str, out: str = "new_id") -> DataFrame:
    """{strata}_{number of six digits} in path order within each stratum."""
    n = F.row_number().over(Window.partitionBy(*strata).orderBy(path))
    return rows.withColumn(out, F.concat_ws("_", *strata, F.format_string("%06d", n)))


def quotas(pools: DataFrame, group: list[str], part: str, n: str, target: str) -> DataFrame:
    """Largest-remainder shares of ``target`` over the parts of a group by their pool sizes; leftovers by fraction, then part, descending."""
    w = Window.partitionBy(*group)
    exact = F.col(n) * F.col(target) / F.sum(n).over(w).cast("double")
    got = pools.withColumns({"_exact": exact, "_floor": F.floor(exact)})
    left = F.first(target).over(w) - F.sum("_floor").over(w)
    rank = F.row_number().over(w.orderBy(F.desc(F.col("_exact") - F.col("_floor")), F.desc(part)))
    return got.withColumn("quota", (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("_exact", "_floor")


def screen(rows: DataFrame, group: list[str], order: list[Column], passed: Column, target: Column | str) -> DataFrame:
    """Rows reviewed until their group has ``target`` passes, with ``selected``; rows without a verdict must be gone already."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum(passed.cast("int")).over(before), F.lit(0))
    target = F.col(target) if isinstance(target, str) else target
    return rows.withColumn("_done", done).filter(F.col("_done") < target).withColumn("selected", passed).drop("_done")


def screening_progress(reviewed: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """Per group: target, reviewed, selected, failed, remaining, complete."""
    counts = reviewed.groupBy(*group).agg(F.count("*").alias("reviewed"), F.count_if("selected").alias("selected"))
    out = targets.join(counts, group, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = out.withColumns({"reviewed": zero("reviewed"), "selected": zero("selected")})
    return out.withColumns({"failed": F.col("reviewed") - F.col("selected"), "remaining": F.greatest(F.col("target") - F.col("selected"), F.lit(0)), "complete": F.col("selected") >= F.col("target")})


def round_robin(rows: DataFrame, strata: list[str], order: Column, key: str, limit: int) -> DataFrame:
    """One row of each stratum in turn until ``limit``; limit <= 0 gives all."""
    if limit <= 0:
        return rows
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(order, key))
    return rows.withColumn("_r", rank).orderBy("_r", *strata).limit(limit).drop("_r")


def last_by_key(rows: DataFrame, key: list[str], seq: Column | str) -> DataFrame:
    """Of an append log the last record per key; of records with the same number the one whose content's hash is greatest."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(seq.desc(), F.xxhash64(F.to_json(F.struct(*rows.columns))).desc()))).filter("_n = 1").drop("_n")


def rebalance(rows: DataFrame, group: list[str], key: str, seq: str, order: list[Column], target: Column | str) -> DataFrame:
    """Last record per (group, key), then the first ``target`` of each group."""
    target = F.col(target) if isinstance(target, str) else target
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return last_by_key(rows, [*group, key], seq).withColumn("_r", rank).filter(F.col("_r") <= target).drop("_r")


def shortfalls(kept: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    counts = kept.groupBy(*group).agg(F.count("*").alias("kept"))
    return targets.join(counts, group, "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long"))).withColumn("shortfall", F.greatest(F.col("target") - F.col("kept"), F.lit(0)))


def not_reviewed(manifest: DataFrame, reviewed: DataFrame, key: list[str]) -> DataFrame:
    return manifest.join(reviewed.select(*key).distinct(), key, "left_anti")


def reusable(manifest: DataFrame, cache: DataFrame, key: str, digest: str) -> DataFrame:
    """Cached results whose content digest is still the same."""
    return manifest.join(cache, [key, digest])


def bucket_preview(rows: DataFrame, bucket: str, order: Column, key: str, n: int, buckets: int) -> DataFrame:
    """n / buckets rows of each bucket, topped up from the rest in hash order."""
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(order, key))
    ranked = rows.withColumn("_r", rank)
    return ranked.orderBy(F.when(F.col("_r") <= n // buckets, 0).otherwise(1), order, key).limit(n).drop("_r")


def duplicate_suffix(rows: DataFrame, group: list[str], name: str, order: str, suffixes: list[str]) -> DataFrame:
    """Names that repeat in a group, whatever their case, get suffixes in turn."""
    w = Window.partitionBy(*group, F.lower(name))
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    pool = F.array(*map(F.lit, suffixes))
    return rows.withColumn("display", F.when(n > 1, F.concat(F.col(name), F.lit(" "), F.get(pool, i % len(suffixes)))).otherwise(F.col(name)))


def shard(rows: DataFrame, index: str, n: int, k: int) -> DataFrame:
    """The rows that shard k of n works on."""
    return rows.filter(F.col(index) % n == k)


def reviewed_rows(manifest: DataFrame, records: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Manifest rows with the last review record of their key; rows never reviewed, and records without a row, are left out."""
    return manifest.join(last_by_key(records, key, seq), key)


def passed_source(source: DataFrame, screened: DataFrame, key: list[str], passed: Column) -> DataFrame:
    """Rows of a source pool whose screening record passed; the record's columns stay behind."""
    return source.join(screened.filter(passed).select(*key).distinct(), key, "left_semi")


def rebalanced_domain(selected: DataFrame, source: DataFrame, mine: Column, group: list[str], key: str, order: list[Column], targets: DataFrame) -> DataFrame:
    """Rows of other domains as they are, and of this one the first ``target`` of each group in order, drawn from its selected and its
    source rows; of rows with the same key the source's counts. targets: (group, target); groups without a target give none.
    """
    pool = selected.filter(mine).withColumn("_from", F.lit(0)).unionByName(source.withColumn("_from", F.lit(1)))
    chosen = rebalance(pool.join(targets, group), group, key, "_from", order, "target").select(*selected.columns)
    return selected.filter(~F.coalesce(mine, F.lit(False))).unionByName(chosen)
