"""A running pass rate over a stream of QA records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deduplicated(records: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """One record per key; a repeat may come up to ``delay`` late."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def pass_rate(records: DataFrame, time: str, passed: Column, window: str = "1 hour", slide: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """(window_start, keys, n, passed, rate) over tumbling or sliding windows; the same plan serves batch and stream."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    out = records.groupBy(span.alias("w"), *(keys or [])).agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"))
    return out.select(F.col("w.start").alias("window_start"), *(keys or []), "n", "passed", F.round(F.col("passed") / F.col("n"), 6).alias("rate"))
