"""Predicted nodes to gold nodes, one to one within a normalised name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topoframe.functions.geometry import box_iou
from topoframe.functions.text import normalize_name


def _id_order(c: Column) -> Column:
    """n1, n2, ... n10 by their number (without leading zero, of any length), then all other ids as text."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    digits = F.regexp_extract(text, "^n([1-9][0-9]*)$", 1)
    return F.when(digits != "", F.struct(F.lit(0).alias("kind"), F.length(digits).alias("size"), digits.alias("text"))).otherwise(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("size"), text.alias("text")))


def match_nodes(pred: DataFrame, gold: DataFrame, key: str = "sample_id", rank_boxless: bool = True) -> DataFrame:
    """(key, pred_id, gold_id) from two tables (key, pos, id, name, box).

    Names without a letter or digit match nothing. Names that occur once on both sides are a plain join. Larger groups: if rank_boxless and no gold box has four numbers, both
    sides are ranked by the number in their ids and zipped; else, in prediction order, each takes the unused gold node of
    the best IoU (earliest on ties, no threshold) - the fold's state is one array a group, and groups are as
    large as a name is repeated in one sample.
    """
    side = lambda d: d.select(key, normalize_name("name").alias("n"), "pos", "id", F.coalesce("box", F.array().cast("array<double>")).alias("box")).filter("n <> ''")
    one = F.struct("pos", "id", "box")
    group = lambda d, name: side(d).groupBy(key, "n").agg(F.array_sort(F.collect_list(one)).alias(name))
    both = group(pred, "p").join(group(gold, "g"), [key, "n"])
    single = (F.size("p") == 1) & (F.size("g") == 1)
    lone = both.filter(single).select(key, F.col("p")[0]["id"].alias("pred_id"), F.col("g")[0]["id"].alias("gold_id"))
    many = both.filter(~single)
    boxless = ~F.exists("g", lambda x: F.size(x["box"]) == 4) if rank_boxless else F.lit(False)
    ranked = lambda c: F.transform(F.array_sort(F.transform(c, lambda x: F.struct(_id_order(x["id"]).alias("k"), x["pos"].alias("pos"), x["id"].alias("id")))), lambda x: x["id"])
    zipped = F.zip_with(ranked("p"), ranked("g"), lambda a, b: F.struct(a.alias("pred_id"), b.alias("gold_id")))
    zipped = F.filter(zipped, lambda m: m["pred_id"].isNotNull() & m["gold_id"].isNotNull())
    empty = F.expr("cast(array() as array<struct<pred_id:string,gold_id:string,at:bigint>>)")

    def take(done: Column, p: Column) -> Column:
        used = F.transform(done, lambda m: m["at"])
        free = F.filter("g", lambda x: ~F.array_contains(used, x["pos"].cast("long")))
        best = F.array_min(F.transform(free, lambda x: F.struct((-box_iou(p["box"], x["box"])).alias("s"), x["pos"].alias("pos"), x["id"].alias("id"))))
        step = F.array(F.struct(p["id"].cast("string").alias("pred_id"), best["id"].cast("string").alias("gold_id"), best["pos"].cast("long").alias("at")))
        return F.when(best.isNull(), done).otherwise(F.concat(done, step))

    greedy = F.transform(F.aggregate("p", empty, take), lambda m: F.struct(m["pred_id"], m["gold_id"]))
    found = many.select(key, F.explode(F.when(boxless, zipped).otherwise(greedy) if rank_boxless else greedy).alias("m")).select(key, "m.pred_id", "m.gold_id")
    return lone.unionByName(found)


def remap_edges(edges: DataFrame, mapping: DataFrame, key: str = "sample_id") -> DataFrame:
    """Predicted ends renamed to gold ids; an end without a match becomes UNMATCHED:<id> and stays a false positive."""
    out = edges
    for end in ("source", "target"):
        m = mapping.select(key, F.col("pred_id").alias(end), F.col("gold_id").alias("_to"))
        out = out.join(m, [key, end], "left").withColumn(end, F.coalesce("_to", F.concat(F.lit("UNMATCHED:"), F.col(end)))).drop("_to")
    return out


def first_graph_per_stem(graphs: DataFrame, stem: str = "stem", line: str = "line") -> DataFrame:
    """Of several graphs of a stem the first by line."""
    w = Window.partitionBy(stem).orderBy(line)
    return graphs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_names(edges: DataFrame, nodes: DataFrame, graph: str = "sample_id") -> DataFrame:
    """source_name and target_name looked up by id in the edge's graph; null for an unknown id. Of repeated node ids the last by pos counts."""
    names = nodes.groupBy(graph, "id").agg(F.max_by("name", "pos").alias("_name"))
    out = edges
    for end in ("source", "target"):
        out = out.join(names.withColumnsRenamed({"id": end, "_name": f"{end}_name"}), [graph, end], "left")
    return out
