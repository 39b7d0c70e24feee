"""Fine-tuning manifests: answers, prompts, messages and loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topoframe.functions.text import first_filled

IGNORED = -100


def answer(target_json: str = "target", fallback: str = "final_graph") -> Column:
    """assistant_text, answer or response, the first that isn't empty; else the target's JSON, the final graph's, or {}."""
    return F.coalesce(first_filled("assistant_text", "answer", "response"), F.nullif(F.col(target_json), F.lit("")), F.nullif(F.col(fallback), F.lit("")), F.lit("{}"))


def system_prompt(messages: Column | str = "messages") -> Column:
    """The first message's text, whatever its role: messages ARRAY<STRUCT<role, content ARRAY<STRUCT<type, text>>>>."""
    m = F.col(messages) if isinstance(messages, str) else messages
    parts = F.filter(F.get(m, F.lit(0))["content"], lambda p: p["type"].isin("text", "input_text"))
    texts = F.filter(F.transform(parts, lambda p: F.trim(p["text"])), lambda t: t != "")
    return F.coalesce(F.array_join(texts, "\n"), F.lit(""))


def chat(system: Column, image: Column, prompt: Column, reply: Column | None = None) -> Column:
    """[system?] + user(image, text) [+ assistant]."""
    message = lambda role, image, text: F.struct(F.lit(role).alias("role"), image.cast("string").alias("image"), text.alias("text"))
    none = F.lit(None).cast("string")
    head = F.when(F.coalesce(system, F.lit("")) != "", message("system", none, system))
    tail = [message("assistant", none, reply)] if reply is not None else []
    return F.array_compact(F.array(head, message("user", image, prompt), *tail))


def loss_mask(ids: Column | str, prompt_len: Column | str, pad: int) -> Column:
    c, n = (F.col(x) if isinstance(x, str) else x for x in (ids, prompt_len))
    return F.transform(c, lambda x, i: F.when((i < n) | (x == pad), IGNORED).otherwise(x))


def chunks(items: Column | str, size: int = 3) -> Column:
    """Consecutive groups of a list."""
    c = F.col(items) if isinstance(items, str) else items
    starts = F.filter(F.sequence(F.lit(0), F.size(c)), lambda i: (i % size == 0) & (i < F.size(c)))
    return F.transform(starts, lambda i: F.slice(c, i + 1, size))


def prompt_groups(nodes: DataFrame, graph: str, order: list[str], size: int = 3) -> DataFrame:
    """grp of each node: consecutive groups of ``size`` in order, from 1."""
    n = F.row_number().over(Window.partitionBy(graph).orderBy(*order))
    return nodes.withColumn("grp", F.floor((n - 1) / size) + 1)


def edge_prompts(nodes: DataFrame, graph: str, order: list[str], template: str, size: int = 3) -> DataFrame:
    """(graph, grp, prompt): every group with the whole node list, as JSON in a template with {nodes} and {sources}."""
    one = F.struct(*order, F.struct("id", "name", F.transform("box", lambda v: F.bround(v).cast("int")).alias("box")).alias("n"))
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["n"]))
    grouped = prompt_groups(nodes, graph, order, size)
    whole = nodes.groupBy(graph).agg(listed.alias("nodes_json"))
    part = grouped.groupBy(graph, "grp").agg(listed.alias("sources_json")).join(whole, graph)
    filled = F.replace(F.replace(F.lit(template), F.lit("{nodes}"), F.col("nodes_json")), F.lit("{sources}"), F.col("sources_json"))
    return part.select(graph, "grp", filled.alias("prompt"))
