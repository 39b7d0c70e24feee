"""Label catalogs, asset indexes and prompt jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topoframe.functions.text import slugify


def labels_by_role(labels: DataFrame) -> DataFrame:
    return labels.groupBy("role").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def labels_by_category(labels: DataFrame) -> DataFrame:
    """A label counts under its category and under its role."""
    rows = labels.select("label", F.explode(F.array_distinct(F.array_compact(F.array("category", "role")))).alias("category"))
    return rows.groupBy("category").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def asset_index(assets: DataFrame) -> DataFrame:
    return assets.groupBy("label", "style").agg(F.array_sort(F.collect_list("file")).alias("files"))


def assign_assets(nodes: DataFrame, assets: DataFrame) -> DataFrame:
    """The first asset of a node's label and style, else of its label in any style, else null."""
    styled = assets.groupBy("label", "style").agg(F.min("file").alias("_styled"))
    plain = assets.groupBy("label").agg(F.min("file").alias("_any"))
    out = nodes.join(styled, ["label", "style"], "left").join(plain, "label", "left")
    return out.withColumn("asset", F.coalesce("_styled", "_any")).drop("_styled", "_any")


def prompt_jobs(labels: DataFrame, styles: list[str], variants: int, prompt: Column) -> DataFrame:
    """Label x style x variant with a prompt and a file name; styles and variants are literals, so nothing is shuffled."""
    rows = labels.withColumn("style", F.explode(F.array(*map(F.lit, styles)))).withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    name = F.format_string("%s_%s_%02d.png", slugify("label"), F.col("style"), F.col("variant"))
    return rows.withColumns({"prompt": prompt, "file": name})
