"""Exact top-k inner products by columnar branch-and-bound.

Candidates are kept in vertical layout (one contiguous run per dimension). For each query, partial scores grow by one
block of dimensions at a time; after each block the Cauchy-Schwarz mass of the dimensions not yet seen bounds what a
candidate can still gain or lose, candidates that cannot reach the k-th best lower bound go, and the survivors are
compacted. A task holds a block of queries and streams a run of candidates past it, longest first: each query's k-th best
score so far is carried from block to block, and a block (or the rest of the run) whose norms cannot reach it is not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, written
from .vectors import padded, rows

QUERY_BLOCK, CANDIDATE_BLOCK, RUN_BLOCKS, DIMS = 2048, 4096, 64, 8
#: Below it doubles hold every partial sum exactly.
EXACT = float(1 << 52)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _quantised(scale: float):
    """(vec_id, row, raw, dim, norm): components as the narrowest of 16- or 32-bit integers and doubles that holds them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, row, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), rows(b.column(2)), strict=True):
                if v is None or i is None:
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * v)
                    top = float(np.abs(x).max())
                    if top < np.inf:
                        kind = np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.float64
                        out.append((i, row, x.astype(kind).tobytes(), len(x), float(np.sqrt((x * x).sum()))))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["vec_id", "row", "raw", "dim", "norm"])

    return run


def _matrix(raw: list[bytes], dims: list[int], dim: int) -> np.ndarray:
    kinds = {2: np.int16, 4: np.int32, 8: np.float64}
    return np.stack([padded(np.frombuffer(x, kinds[len(x) // d]).astype(np.float64), dim) for x, d in zip(raw, dims, strict=True)])


class Search:
    """A block of queries, each with its k best so far: (-score, vec_id, row), ascending. Components are whole numbers in doubles."""

    def __init__(self, mat: np.ndarray, rows_: np.ndarray, k: int):
        self.mat, self.rows, self.k = mat, rows_, k
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((mat * mat).sum(axis=1))
        self.top: list[list[tuple[int, int, int]]] = [[] for _ in rows_]
        self.floor = np.full(len(rows_), -np.inf)
        self.seen = 0  # products of a query and a candidate that were begun, for tests and measurements

    def offer(self, cands: np.ndarray, ids: np.ndarray, rows_: np.ndarray) -> bool:
        """Look at a block of candidates; False if no query can gain from it, nor from any block of smaller norms."""
        dim = cands.shape[1]
        order = np.lexsort((rows_, ids))  # ties: smaller id first
        ids, rows_, cands = ids[order], rows_[order], cands[order]
        exact = float(np.abs(self.mat).max(initial=0)) * float(np.abs(cands).max(initial=0)) * dim < EXACT
        if not exact:  # sums beyond doubles: Python's integers, without bounds
            whole = np.array([[int(x) for x in v] for v in cands], dtype=object).reshape(cands.shape)
            for n, q in enumerate(self.mat):
                scores = whole @ np.array([int(x) for x in q], dtype=object)
                self._keep(n, range(len(ids)), [int(x) for x in scores], ids, rows_)
            return True
        columns = np.ascontiguousarray(cands.T)
        starts = list(range(0, dim, DIMS))
        squares = np.stack([(columns[s : s + DIMS] ** 2).sum(axis=0) for s in starts])
        mass = np.sqrt(np.concatenate([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, len(ids)))]))  # of the dimensions from a block on
        live = np.flatnonzero(self.norm * mass[0].max(initial=0) * (1 + 1e-9) + 1e-6 >= self.floor)
        for n in live.tolist():
            q = self.mat[n]
            alive, score = np.arange(len(ids)), np.zeros(len(ids))
            self.seen += len(alive)
            for at, s in enumerate(starts):
                block = columns[s : s + DIMS]
                score = score + q[s : s + DIMS] @ (block if len(alive) == len(ids) else block[:, alive])
                rest = float(np.sqrt((q[s + DIMS :] ** 2).sum())) * mass[at + 1][alive] * (1 + 1e-9) + 1e-6
                least = self.floor[n]
                if len(alive) > self.k + 1:  # one of them may be the query's own row
                    least = max(least, np.partition(score - rest, len(alive) - self.k - 1)[len(alive) - self.k - 1])
                stay = score + rest >= least
                if not stay.all():
                    alive, score = alive[stay], score[stay]
            best = np.lexsort((alive, -score))[: self.k + 1]
            self._keep(n, alive[best].tolist(), [int(x) for x in score[best]], ids, rows_)
        return len(live) > 0

    def _keep(self, n: int, at, scores: list[int], ids: np.ndarray, rows_: np.ndarray) -> None:
        top = self.top[n]
        for i, score in zip(at, scores, strict=True):
            if rows_[i] != self.rows[n]:
                bisect.insort(top, (-score, int(ids[i]), int(rows_[i])))
                del top[self.k :]
        if len(top) == self.k:
            self.floor[n] = float(-top[-1][0])


def _beyond(score: int) -> bytes | None:
    """What orders scores that a long cannot hold: bytes that compare as the numbers do."""
    return None if LEAST < score < MOST else (score + (1 << 2200)).to_bytes(276, "big")


def _search(k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, held, search, more = None, [], [], None, True

        def look() -> None:
            nonlocal search, held, more
            if search is None and asked:
                search = Search(_matrix([r[2] for r in asked], [r[3] for r in asked], dim), np.array([r[1] for r in asked], np.int64), k)
            if search is not None and held and more:
                mat = _matrix([r[2] for r in held], [r[3] for r in held], dim)
                more = search.offer(mat, np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64))
            held = []

        def found() -> Iterator[pa.RecordBatch]:
            look()
            out = [(q[1], q[0], i, row, max(LEAST, min(MOST, -score)), _beyond(-score)) for q, top in zip(asked, search.top if search else [], strict=bool(search)) for score, i, row in top]
            if out:
                *cols, beyond = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array(beyond, pa.binary())], ["qrow", "query_id", "vec_id", "row", "score", "beyond"])

        for b in batches:
            cols = {c: b.column(b.schema.get_field_index(c)) for c in ("qb", "run", "asked", "vec_id", "row", "raw", "dim")}
            for qb, r, ask, *row in zip(*(c.to_pylist() for c in cols.values()), strict=True):
                if (qb, r) != key:
                    yield from found()
                    key, asked, held, search, more = (qb, r), [], [], None, True
                if ask:
                    asked.append(row)
                elif more:
                    held.append(row)
                    if len(held) >= CANDIDATE_BLOCK:
                        look()
        yield from found()

    return run


def top_inner_products(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best by integer inner product of floor(scale * x), its own row left out.

    Rows with a null id, and vectors null, empty, with null or non-finite components or with components that are not finite after
    scaling take no part. Shorter vectors are padded with zeros. Rows that share an id are candidates each, and queries each (their
    results follow one another under the same query_id). Scores beyond 64 bits are ranked exactly and returned as the nearest long.
    Fewer candidates than k give all. Other columns are not read.
    """
    spark = prepare(vectors.sparkSession)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(vec_col).alias("v"))
    data = written(base.mapInArrow(_quantised(scale), "vec_id long, row long, raw binary, dim int, norm double"), "topk")
    ask = F.coalesce(is_query(F.col("vec_id")), F.lit(False))
    stat = data.agg(F.count("*").alias("n"), F.count_if(ask).alias("q"), F.max("dim").alias("dim")).first()
    each = max(CANDIDATE_BLOCK, min(CANDIDATE_BLOCK * RUN_BLOCKS, -(-stat.n // spark.sparkContext.defaultParallelism)))
    nq, nr = max(1, -(-stat.q // QUERY_BLOCK)), max(1, -(-stat.n // each))
    mine = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = data.filter(ask).select("*", F.lit(True).alias("asked"), mine(nq, 1).alias("qb"), every(nr).alias("run"))
    offered = data.select("*", F.lit(False).alias("asked"), every(nq).alias("qb"), mine(nr, 2).alias("run"))
    work = asked.unionByName(offered).repartition(min(nq * nr, 100_000), "qb", "run").sortWithinPartitions("qb", "run", F.desc("asked"), F.desc("norm"), "row")
    found = work.mapInArrow(_search(k, stat.dim or 1), "qrow long, query_id long, vec_id long, row long, score long, beyond binary")
    place = Window.partitionBy("qrow").orderBy(F.desc("score"), F.desc("beyond"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
