"""Embedding near-duplicates by an epsilon join of blocks that tasks read from the shared folder.

cosine(a, b) >= t is the Euclidean distance of the unit vectors being at most eps = sqrt(2 - 2 t). A unit vector is seen through
its coordinates on the leading principal axes and the length of what they leave over: the cosine of two vectors is
at most the inner product of these views, and their distance at least that of the views. Distinct vectors are written once; a task reads
two blocks of them, sorts each in epsilon grid order - lexicographic order of the cells floor(y / eps) -, halves them recursively
while bounding boxes don't prove them distant, bounds the pairs of a leaf by one product of views, and takes the cosine in double precision
of those that are left. Nothing but links leaves a task, so neither shuffle nor storage grows with the number of pairs of blocks. The axes
are fitted on a bounded sample (``SAMPLE`` vectors); they affect speed only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import discard, prepare, scratch, written
from .components import components
from .id_files import _store
from .vectors import padded, rows

#: A block has BLOCK vectors and BLOCK_BYTES at most (a worker holds two), of a small table a SPLIT-th but SMALL at least, so that there
#: are tasks enough; it is read from files of SMALL vectors.
AXES, BLOCK, BLOCK_BYTES, SMALL, SPLIT, LEAF, SAMPLE = 24, 262_144, 1 << 26, 8192, 16, 512, 4096
#: Room for errors of single precision in a product of views.
SLACK = 1e-5
#: Pairs of a leaf that are verified one by one; more of them by a product of their rows and columns. Links held before they are merged.
FEW, HELD = 8192, 4_000_000


def _signed(kind: str, raw: bool):
    """(vec_id, sign, raw): a digest of each vector that can have links, and its components as numbers of that kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [v.astype(kind).tobytes() if v is not None and v.any() else None for v in rows(b.column(1))]
            sign = pa.array([None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in data], pa.binary())
            columns = {"vec_id": b.column(0), "sign": sign} | ({"raw": pa.array(data, pa.binary())} if raw else {})
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _stacked(raw: list[bytes], dim: int, kind: str) -> np.ndarray:
    return np.stack([padded(np.frombuffer(x, kind), dim) for x in raw]).astype(kind, copy=False)


def normalised(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # keeps squares inside the range of doubles
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m


def _views(mat: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes and the length of the rest."""
    out = np.empty((len(mat), axes.shape[1] + 1), np.float32)
    for at in range(0, len(mat), 8192):
        y = normalised(mat[at : at + 8192]) @ axes
        out[at : at + 8192, :-1] = y
        out[at : at + 8192, -1] = np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))
    return out


def _read(folder: str, names: list[str], axes: np.ndarray, kind: str, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, copies, matrix) of a block, in epsilon grid order."""
    ids, cnt, mats = [], [], []
    store, root = _store(folder)
    for name in names:
        with store.open_input_file(f"{root}/{name}") as source, pq.ParquetFile(source) as file:
            for b in file.iter_batches(8192, columns=["rep", "copies", "raw"]):
                ids.append(b.column(0).to_numpy())
                cnt.append(b.column(1).to_numpy())
                mats.append(_stacked(b.column(2).to_pylist(), axes.shape[0], kind))
    mat = np.concatenate(mats)
    order = np.lexsort(np.floor(_views(mat, axes)[:, :8] / eps).T[::-1])
    return np.concatenate(ids)[order], np.concatenate(cnt)[order], mat[order]


class _Tree:
    """Bounding boxes of a sequence's halves, down to leaves."""

    def __init__(self, y: np.ndarray, start: int, stop: int):
        self.start, self.stop, self.kids = start, stop, ()
        if stop - start > LEAF:
            mid = (start + stop) // 2
            self.kids = (_Tree(y, start, mid), _Tree(y, mid, stop))
            self.lo = np.minimum(self.kids[0].lo, self.kids[1].lo)
            self.hi = np.maximum(self.kids[0].hi, self.kids[1].hi)
        else:
            self.lo, self.hi = y[start:stop].min(axis=0), y[start:stop].max(axis=0)


def _leaves(a: _Tree, b: _Tree, limit: float, same: bool) -> Iterator[tuple[_Tree, _Tree]]:
    """Leaf pairs that may hold a link; of a sequence with itself each pair once."""
    gap = np.maximum(0, np.maximum(a.lo - b.hi, b.lo - a.hi))
    if float(gap @ gap) > limit or (same and a.start > b.start):
        return
    if not a.kids and not b.kids:
        yield a, b
    elif a.kids and (not b.kids or a.stop - a.start >= b.stop - b.start):
        for k in a.kids:
            if b.kids:
                for x in b.kids:
                    yield from _leaves(k, x, limit, same)
            else:
                yield from _leaves(k, b, limit, same)
    else:
        for k in b.kids:
            yield from _leaves(a, k, limit, same)


def _spanned(mask: np.ndarray, a0: int, b0: int, label: np.ndarray) -> None:
    """Give the rows and columns that a leaf links one label (the least), without a step per pair."""
    r, c = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    sub, top = mask[np.ix_(r, c)], len(label)
    la, lb = label[a0 + r], label[b0 + c]
    old = np.concatenate([la, lb])
    while True:
        na = np.minimum(la, np.where(sub, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(sub, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    new = np.concatenate([la, lb])
    move = np.arange(top)  # every (old, new) pair joins two classes, either way: an old label may lie in several groups of links
    while (move[old] != move[new]).any():
        least = np.minimum(move[old], move[new])
        np.minimum.at(move, old, least)
        np.minimum.at(move, new, least)
        move = move[move]
    label[:] = move[label]


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the position of a class's first member) after links between u and v."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up


def join_blocks(left: tuple, right: tuple, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, weights of the vectors linked to each, label: position of the first vector of its class)."""
    dim = axes.shape[0]
    limit = (2 - 2 * threshold) * (1 + 1e-9) + SLACK
    parts = [left] if same else [left, right]
    ids = np.concatenate([np.frombuffer(p[0], np.int64) for p in parts])
    cnt = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts])
    mats = [p[2] if isinstance(p[2], np.ndarray) else np.frombuffer(p[2], np.float64).reshape(-1, dim) for p in parts]
    split = len(mats[0])
    mat = mats[0] if same else np.concatenate(mats)
    y = _views(mat, axes)
    a = _Tree(y, 0, split)
    b = a if same else _Tree(y, split, len(ids))
    weight, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for p, q in _leaves(a, b, limit, same):
        bound = y[p.start : p.stop] @ y[q.start : q.stop].T
        if bound.max() < threshold - SLACK:
            continue
        r, c = np.divmod(np.flatnonzero(bound >= threshold - SLACK), q.stop - q.start)
        if p.start == q.start:
            r, c = r[r < c], c[r < c]
        r, c = r + p.start, c + q.start
        if len(r) <= FEW:
            near = (normalised(mat[r]) * normalised(mat[c])).sum(axis=1) >= threshold
            r, c = r[near], c[near]
            np.add.at(weight, r, cnt[c])
            np.add.at(weight, c, cnt[r])
        else:
            mask = normalised(mat[p.start : p.stop]) @ normalised(mat[q.start : q.stop]).T >= threshold
            if p.start == q.start:
                np.fill_diagonal(mask, False)
            if not mask.any():
                continue
            weight[p.start : p.stop] += mask @ cnt[q.start : q.stop]
            if p.start != q.start:
                weight[q.start : q.stop] += cnt[p.start : p.stop] @ mask
            near = np.arange(len(mask) + mask.shape[1])
            _spanned(mask, 0, len(mask), near)
            place = np.concatenate([np.arange(p.start, p.stop), np.arange(q.start, q.stop)])
            r, c = place, place[near]
        links.append((r, c))
        held += len(r)
        if held > HELD:
            label, links, held = _joined(label, *map(np.concatenate, zip(*links, strict=True))), [], 0
    if links:
        label = _joined(label, *map(np.concatenate, zip(*links, strict=True)))
    return ids, weight, label


def _join(folder: str, blocks: list[list[str]], axes: np.ndarray, threshold: float, kind: str, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                j = (math.isqrt(8 * k + 1) - 1) // 2
                i = k - j * (j + 1) // 2
                left = _read(folder, blocks[i], axes, kind, eps)
                ids, weight, label = join_blocks(left, left if i == j else _read(folder, blocks[j], axes, kind, eps), axes, threshold, i == j)
                hit = np.flatnonzero(weight)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(weight[hit]), pa.array(ids[label[hit]])], ["vec_id", "weight", "head"])

    return run


def cosine_classes(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Null, empty, zero vectors and vectors with null or non-finite components link with nothing; so do rows with a null id
    (their component is null). Shorter vectors are padded with zeros. Equal vectors are grouped first and count as often as
    they occur; rows that share an id are one node. Other columns are not read.
    """
    spark = prepare(vectors.sparkSession)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    kind = "<f4" if isinstance(base.schema["v"].dataType.elementType, FloatType) else "<f8"
    good = base.mapInArrow(_signed(kind, True), "vec_id long, sign binary, raw binary").filter("vec_id is not null and sign is not null")
    folder = scratch(spark, "copies")
    once = good.groupBy("sign").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    once.write.option("maxRecordsPerFile", min(BLOCK, SMALL)).parquet(folder)
    discard(spark, folder)
    classes = spark.read.schema("sign binary, rep long, copies long, raw binary").parquet(folder)
    files = classes.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n"), F.max(F.octet_length("raw")).alias("size")).orderBy("name").collect()
    n = sum(f.n for f in files)
    dim = max((f["size"] for f in files), default=0) // np.dtype(kind).itemsize or 1
    eps = math.sqrt(2 - 2 * threshold) * (1 + 1e-9) + 1e-9
    few = classes.filter(F.pmod(F.xxhash64("sign"), F.lit(max(1, n // (2 * SAMPLE)))) == 0).orderBy(F.xxhash64("sign"), "sign")
    sample = [r[0] for r in few.select("raw").limit(SAMPLE).collect()]
    if sample:
        m = normalised(_stacked(sample, dim, kind))
        _, _, axes = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
        axes = axes[:AXES].T.copy()
    else:
        axes = np.eye(dim)[:, : min(AXES, dim)]
    blocks: list[list[str]] = []
    have, most = 0, min(BLOCK, BLOCK_BYTES // (dim * np.dtype(kind).itemsize), max(SMALL, -(-n // SPLIT)))
    for f in files:
        if not blocks or have + f.n > most:
            blocks.append([])
            have = 0
        blocks[-1].append(f.name)
        have += f.n
    n_pairs = len(blocks) * (len(blocks) + 1) // 2
    pairs = spark.range(0, n_pairs, 1, max(1, n_pairs))
    found = written(pairs.mapInArrow(_join(folder, blocks, axes, threshold, kind, eps), "vec_id long, weight long, head long"), "links")

    comp = components(found.select(F.col("vec_id").alias("src"), F.col("head").alias("dst")))
    weights = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("weight").alias("weight"))
    named = classes.select("sign", "rep", "copies").join(weights, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    named = named.select("sign", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    signs = base.mapInArrow(_signed(kind, False), "vec_id long, sign binary")
    out = signs.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("sign")).alias("sign")).join(named, "sign", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
