"""A seeded generator of layered diagram cases.

Each case depends on its seed and index alone, so any partitioning gives the same cases; a case is drawn again, up to
forty times, until it is valid. The generator is sequential by nature (every draw depends on those before), hence Python workers.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "graph long, domain string, difficulty string, layout string, attempt int, nodes array<struct<id:string,name:string,box:array<int>>>, edges array<struct<source:string,target:string,type:string>>"
#: Nodes per layer and layers, extra edges per node, and edge types by difficulty.
LEVELS = {"simple": (2, 3, 0.2, ["directed"]), "medium": (3, 4, 0.6, ["directed", "undirected"]), "difficult": (4, 5, 1.2, ["directed", "undirected", "bidirectional"])}
LAYOUTS = ("left_to_right", "top_to_bottom", "right_to_left", "bottom_to_top")
ATTEMPTS = 40


def _case(rng: random.Random, difficulty: str, names: list[str]) -> tuple[list[dict], list[dict]]:
    per, layers, extra, types = LEVELS[difficulty]
    nodes, rows = [], []
    for layer in range(layers):
        row = []
        for k in range(rng.randint(1, per)):
            x, y = 60 + 220 * layer + rng.randint(-25, 25), 60 + 160 * k + rng.randint(-25, 25)
            w, h = rng.randint(70, 110), rng.randint(40, 70)
            row.append({"id": f"n{len(nodes) + 1}", "name": rng.choice(names), "box": [x, y, x + w, y + h]})
            nodes.append(row[-1])
        rows.append(row)
    edges = [{"source": rng.choice(before)["id"], "target": node["id"], "type": rng.choice(types)} for before, row in zip(rows, rows[1:], strict=False) for node in row]
    ends = {e[k] for e in edges for k in ("source", "target")}
    edges += [{"source": n["id"], "target": rng.choice(rows[1])["id"], "type": "directed"} for n in rows[0] if n["id"] not in ends]
    for _ in range(int(extra * len(nodes))):
        a, b = rng.sample(nodes, 2)
        edges.append({"source": a["id"], "target": b["id"], "type": rng.choice(types)})
    return nodes, edges


def _valid(nodes: list[dict], edges: list[dict], margin: int = 8) -> bool:
    boxes = [n["box"] for n in nodes]
    apart = lambda a, b: a[2] + margin < b[0] or b[2] + margin < a[0] or a[3] + margin < b[1] or b[3] + margin < a[1]
    ends = {e[k] for e in edges for k in ("source", "target")}
    return all(apart(a, b) for i, a in enumerate(boxes) for b in boxes[:i]) and ends == {n["id"] for n in nodes}


def cases(spark: SparkSession, n: int, seed: int, names: list[str], domain: str = "generated") -> DataFrame:
    """n cases over difficulties and layouts in turn; those that never get valid are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for graph in batch["id"]:
                difficulty, layout = list(LEVELS)[graph % 3], LAYOUTS[graph // 3 % 4]
                for attempt in range(ATTEMPTS):
                    nodes, edges = _case(random.Random(f"{seed}:{graph}:{attempt}"), difficulty, names)
                    if _valid(nodes, edges):
                        out.append((graph, domain, difficulty, layout, attempt, nodes, edges))
                        break
            yield pd.DataFrame(out, columns=["graph", "domain", "difficulty", "layout", "attempt", "nodes", "edges"])

    return spark.range(n).mapInPandas(run, SCHEMA)


def exploded(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node rows (graph, pos, id, name, box) and edge rows (graph, pos, source, target, type)."""
    nodes = graphs.select("graph", F.posexplode("nodes").alias("pos", "n")).select("graph", "pos", "n.*")
    edges = graphs.select("graph", F.posexplode("edges").alias("pos", "e")).select("graph", "pos", "e.*")
    return nodes, edges
