"""Toxicity by a counterfactually regularised linear classifier.

A logistic regression over the presence of words and word beginnings is fitted on a bounded sample of labelled documents. Sentences
that mention an identity group get the term swapped for other groups' terms, and sampled sentences of either label that mention
none get a term put in and swapped, and taken out again; the squared change of the score's logit is added to the loss, so neutral
mentions of a group do not raise a score. The penalty is there whatever the corpus holds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, crc_fold, prepare, slices, written
from .jaccard import shingle_set

#: Terms of one kind of group that can stand for each other in a sentence.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"], ["woman", "man"], ["female", "male"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["gay", "lesbian", "bisexual", "straight", "transgender", "queer"],
    ["black", "white", "asian", "latino", "african", "european", "mexican", "arab", "indian"], ["immigrants", "refugees", "foreigners", "locals"],
    ["immigrant", "refugee", "foreigner", "local"], ["deaf", "blind", "disabled", "autistic"], ["old", "young", "elderly"],
]
#: Documented bounds of the training sample, and of the model.
MOST_TOXIC, MOST_CLEAN, MOST_FEATURES, SWAPS, INSERTED, PER_FAMILY = 3000, 6000, 6000, 3, 400, 2
_WORD = re.compile(r"\w+")
_SWAP = {t: [x for x in group if x != t] for group in IDENTITY_TERMS for t in group}


def features(word: str) -> list[int]:
    """64-bit hashes of a lower-case word's features: itself, and its beginnings of 4 to 6 letters (not of identity terms, which are swapped whole)."""
    names = [word] if word in _SWAP else [word, *(f"{word[:k]}-" for k in (4, 5, 6) if len(word) >= k)]
    return [xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) - (1 << 63) for n in names]


def distinct_words(text: str | None) -> set[str]:
    return {w for token in set((text or "").lower().split()) for w in _WORD.findall(token)}


@dataclass
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    swapped: int = 0  # counterfactual pairs in the penalty

    def logit(self, words: Iterable[str]) -> float:
        active = {f for w in words for f in features(w)}
        return self.bias + math.fsum(self.weights[f] for f in active if f in self.weights)


@dataclass
class Example:
    """A labelled text: its distinct feature hashes, and its identity terms."""

    features: np.ndarray
    terms: list[str]
    label: int

    @classmethod
    def of(cls, words: set[str], label: int) -> Example:
        return cls(np.unique(np.array([f for w in words for f in features(w)], dtype=np.int64)), sorted(words & _SWAP.keys()), label)


def marks(text: str | None) -> list[int]:
    """Four min-hashes of a text's five-word shingles: texts that share 0.8 of them have one in common in 99.8 % of cases, unlike texts never."""
    s = shingle_set(text, 5)
    if not len(s):
        return [0] * 4
    with np.errstate(over="ignore"):
        mixed = [(s * np.uint64(m)) ^ (s >> np.uint64(k)) for m, k in ((1, 63), (0x9E3779B97F4A7C15, 31), (0xC2B2AE3D27D4EB4F, 29), (0x165667B19E3779F9, 27))]
    return [int(x.min().view(np.int64)) for x in mixed]


def of_families(rows: list[tuple[int, int, list[int]]], most: int = PER_FAMILY) -> list[int]:
    """Of (row, label, marks) the rows to keep: at most so many of each label in a family, that is, rows joined by equal marks at one place."""
    up = list(range(len(rows)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    first: dict[tuple[int, int], int] = {}
    for i, (_, _, own) in enumerate(rows):
        for at in enumerate(own):
            a, b = find(i), find(first.setdefault(at, i))
            up[max(a, b)] = min(a, b)
    seen: Counter = Counter()
    kept = []
    for i, (row, label, _) in enumerate(rows):
        seen[label, find(i)] += 1
        if seen[label, find(i)] <= most:
            kept.append(row)
    return kept


class _Rows:
    """Sparse rows as (row, column, value)."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, width: int):
        self.row, self.col, self.val, self.n, self.width = row, col, val, n, width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], minlength=self.width)


def caution(c1: Column, c0: Column, n1: int, n0: int) -> tuple[Column, Column]:
    """(log odds, their cautious part) of a feature in c1 of n1 toxic and c0 of n0 other texts."""
    odds = F.log((c1 + 0.5) / (n1 + 1.0)) - F.log((c0 + 0.5) / (n0 + 1.0))
    return odds, odds - 2.6 * F.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))


def counterfactuals(kept: list[Example]) -> list[dict[str, float]]:
    """Changes of a text's terms under swaps, as term -> -1 or 1; '' stands for no term."""
    out: list[dict[str, float]] = []
    others = lambda t: sorted(_SWAP[t], key=lambda o: zlib.crc32(f"{t}>{o}".encode()))[:SWAPS]
    every = sorted(_SWAP)
    for label in (0, 1):
        mute = [e for e in kept if e.label == label and not e.terms]
        for k in range(min(INSERTED, len(mute))):  # one term put into each, and swapped or taken out again
            t = every[(k * 7 + label) % len(every)]
            out += [{t: -1.0, o: 1.0} for o in others(t)] + [{t: -1.0}]
    for e in kept:
        for t in e.terms:
            out += [{t: -1.0} | ({o: 1.0} if o not in e.terms else {}) for o in others(t)]
    return out


def solve(kept: list[Example], prior: dict[int, float], swap_weight: float = 5.0, ridge: float = 3e-4, steps: int = 400) -> Model:
    """Fit weights of the prior's features (which the ridge pulls towards their prior) and of all identity terms."""
    n1 = sum(e.label for e in kept)
    rate = (n1 + 0.5) / (len(kept) + 1.0)
    prior = dict.fromkeys((features(t)[0] for t in _SWAP), 0.0) | prior
    chosen = np.array(sorted(prior), dtype=np.int64)
    place = {int(f): i for i, f in enumerate(chosen)}
    m = len(chosen)
    cols = [np.searchsorted(chosen, np.intersect1d(e.features, chosen, assume_unique=True)) for e in kept]
    row = np.repeat(np.arange(len(kept)), [len(c) for c in cols])
    x = _Rows(row, np.concatenate(cols).astype(np.int64), np.ones(len(row)), len(kept), m)
    y = np.array([e.label for e in kept], float)
    moved = counterfactuals(kept)
    cells = [(r, place[features(t)[0]], v) for r, change in enumerate(moved) for t, v in change.items()]
    d = _Rows(*(np.array(z) for z in zip(*cells, strict=True)), len(moved), m)
    start = np.array([prior[int(f)] for f in chosen])
    w, bias = start.copy(), math.log(rate / (1 - rate))
    mom, vel, mb, vb = np.zeros(m), np.zeros(m), 0.0, 0.0
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -35, 35)))
        grad = x.back(p - y) / len(y) + ridge * (w - start) + swap_weight * d.back(2 * d.dot(w)) / d.n
        gb = float((p - y).mean())
        mom, vel = 0.9 * mom + 0.1 * grad, 0.99 * vel + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate_ = 0.05 * (1 - step / (steps + 1))
        w -= rate_ * (mom / (1 - 0.9**step)) / (np.sqrt(vel / (1 - 0.99**step)) + 1e-8)
        bias -= rate_ * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return Model(float(bias), {int(f): float(v) for f, v in zip(chosen, w, strict=True)}, len(moved))


def fit(examples: Iterable[Example | tuple[set[str], int]], swap_weight: float = 5.0) -> Model:
    """Fit examples (or pairs of distinct words and label) that are at hand, with the same features as train()."""
    kept = [e if isinstance(e, Example) else Example.of(*e) for e in examples]
    n1 = sum(e.label for e in kept)
    if not n1 or n1 == len(kept):
        return _rate(n1, len(kept))
    counts: Counter = Counter((int(f), e.label) for e in kept for f in e.features)
    prior = {}
    for f in {f for f, _ in counts}:
        c1, c0, m1, m0 = counts[f, 1], counts[f, 0], n1, len(kept) - n1
        odds = math.log((c1 + 0.5) / (m1 + 1)) - math.log((c0 + 0.5) / (m0 + 1))
        sure = odds - 2.6 * math.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
        if c1 + c0 >= 5 and odds > 0 and sure > 0:
            prior[f] = (-sure * math.sqrt(c1), f, sure / 2)
    return solve(kept, {f: p for _, f, p in sorted(prior.values())[:MOST_FEATURES]}, swap_weight)


def _rate(n1: int, n: int) -> Model:
    """With one label only, the model is its smoothed rate."""
    rate = (n1 + 0.5) / (n + 1.0) if n else 0.1
    return Model(math.log(rate / (1 - rate)))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    Memo.claim("toxicity sample")
    for part in slices(batches):
        texts = part.column(2).to_pylist()
        got = [Example.of(distinct_words(t), y) for y, t in zip(part.column(1).to_pylist(), texts, strict=True)]
        cols = [pa.array([e.features for e in got], pa.list_(pa.int64())), pa.array([e.terms for e in got], pa.list_(pa.string())), pa.array([marks(t) for t in texts], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["doc_id", "toxic", "features", "terms", "marks"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", swap_weight: float = 5.0) -> Model:
    """Fit on at most MOST_TOXIC + MOST_CLEAN labelled rows of the training folds (crc32(doc_id) mod 3 is not 1), in hash order.

    Rows with a null id or label are no labels; of a repeated label the highest counts. The sample's ids, bounded by those two
    numbers, are broadcast; the documents are scanned once and not shuffled. Features are counted on the executors: the driver gets
    MOST_FEATURES of them, and of each sampled row its marks, its terms and those of its features that were chosen.
    """
    spark = prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(crc_fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y, n: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick(1, MOST_TOXIC).unionAll(pick(0, MOST_CLEAN))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    found = rows.select("doc_id", "toxic", "text").mapInArrow(_examples, "doc_id long, toxic int, features array<long>, terms array<string>, marks array<long>")
    got = written(found.withColumn("row", F.monotonically_increasing_id()), "sample")
    got = got.withColumn("text", F.xxhash64("features", "marks"))  # rows that share an id are copies, or texts of their own
    seen: dict[tuple, int] = {}
    for r in got.select("row", "doc_id", "text", "toxic", "marks").toLocalIterator():
        key = (r.doc_id, r["text"], r.toxic, tuple(r.marks))
        seen[key] = min(r["row"], seen.get(key, r["row"]))
    kept = of_families([(seen[k], k[2], k[3]) for k in sorted(seen)[: MOST_TOXIC + MOST_CLEAN]])
    if not kept:
        return _rate(0, 0)
    used = got.join(F.broadcast(spark.createDataFrame([(k,) for k in kept], "row long")), "row", "left_semi")
    labels_ = {r.toxic: r["count"] for r in used.groupBy("toxic").count().collect()}
    n1, n0 = labels_.get(1, 0), labels_.get(0, 0)
    if not n1 or not n0:
        return _rate(n1, n1 + n0)
    counts = used.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0")).filter("c1 + c0 >= 5")
    odds, sure = caution(F.col("c1"), F.col("c0"), n1, n0)
    good = counts.withColumns({"odds": odds, "sure": sure}).filter("odds > 0 and sure > 0").orderBy(F.desc(F.col("sure") * F.sqrt("c1")), "f").limit(MOST_FEATURES)
    prior = {r.f: r.sure / 2 for r in good.select("f", "sure").collect()}
    wanted = F.array(*map(F.lit, sorted({*prior, *(features(t)[0] for t in _SWAP)})))
    short = used.select("doc_id", "text", "toxic", "terms", F.array_intersect("features", wanted).alias("features")).collect()
    examples = [Example(np.unique(np.array(r.features, np.int64)), list(r.terms), r.toxic) for r in sorted(short, key=lambda r: (r.doc_id, r["text"]))]
    return solve(examples, prior, swap_weight)


_worker: dict = {}


def _known(model: Model) -> Memo:
    """A worker's memo of the model's features in a token; another model starts it anew."""
    sign = (model.bias, len(model.weights))
    if _worker.get("sign") != sign:
        memo = _worker.setdefault("memo", Memo(lambda token: tuple({f for w in _WORD.findall(token) for f in features(w) if f in _worker["weights"]}), 300_000))
        memo.clear()
        memo.old = {}
        _worker.update(sign=sign, weights=model.weights)
    return _worker["memo"]


def _scores(model: Model, at: int, kept: int):
    """Scores of the texts in column ``at``; the first ``kept`` columns are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.claim("toxicity")
        weights = model.weights
        known = _known(model)
        for part in slices(batches):
            out = []
            for text in part.column(at).to_pylist():
                active: set[int] = set()
                for token in set(text.lower().split()) if text else ():
                    hit = known[token]
                    if hit:
                        active.update(hit)
                z = model.bias + math.fsum(weights[f] for f in active)
                out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(out, pa.float64())], [*part.schema.names[:kept], "score"])

    return run


#: A name that no table is expected to use; scored() checks.
SCORE = "toxicity score 5f1d"


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of docs, whatever their names, and SCORE of the whole text; null and empty texts get the score of no words."""
    keep = docs.columns if keep is None else keep
    if SCORE in keep:
        raise ValueError(f"a column is named {SCORE!r}")
    given = docs.select(*(F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(keep)))
    at = keep.index(text_col) if text_col in keep else len(keep)  # a text that is kept goes to Python once
    schema = T.StructType([*given.schema.fields, T.StructField("score", T.DoubleType())])
    given = given if at < len(keep) else docs.select(*(F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    return given.mapInArrow(_scores(model, at, len(keep)), schema).toDF(*keep, SCORE)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, swap_weight: float = 5.0) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs; a null id is not held out. Other columns are not read."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(base, train(base, labels, swap_weight=swap_weight), keep=["doc_id"])
    held, score = F.coalesce(crc_fold(F.col("doc_id")) == 1, F.lit(False)), F.col(f"`{SCORE}`")
    return out.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
