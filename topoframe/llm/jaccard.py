"""N-gram Jaccard self-join by T-occurrence search.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of word shingles. A linked
pair shares at least ``T(n) = ceil(percent * n / 100)`` shingles of either document (n = its set size).

* Equal sets collapse to their smallest doc_id first, so a group of copies costs one document.
* Every set is put in one global order (its 64-bit shingle hashes). Of the first ``n - T + l`` shingles of
  both documents a linked pair shares ``l``; these prefixes are the inverted lists that are merged over
  the whole corpus. A document that meets fewer than ``t`` lists with another entry links with nothing. Of
  the rest each may leave out its ``t - 1`` longest lists (the rarest shared list is never among
  them), so very common passages and phrases generate no candidates.
* The lists left connect documents by a star per list, never by all pairs; connected documents form a candidate class.
* Within a class, cut into blocks of bounded size, each document runs DivideSkip: heap-merge of its short
  inverted lists, binary probes of its long ones, kept if the exact overlap suffices. Documents that are already connected
  are not compared again. Results leave as spanning links and become components.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, prepare, slices, sorted_groups, written
from .components import components

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
#: Shingles in a block of a candidate class; one task holds two blocks.
BLOCK_SHINGLES = 2_000_000
#: Share of a set's size by which the prefix is longer than the least that is needed.
SLACK = 0.08

_words: dict[str, Memo] = {}


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (A-Z lower-cased, words split at ASCII white space).

    Fewer words than ``width`` give one shingle of all of them; no words (or null) an empty set.
    """
    memo = _words.get("hash")
    if memo is None:
        memo = _words["hash"] = Memo(_word_hash, 150_000)
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    ids = np.array([memo[w] for w in words], dtype=np.int64).view(np.uint64)
    k = min(width, len(ids))
    with np.errstate(over="ignore"):
        acc = np.full(len(ids) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            acc = (acc ^ (ids[j : j + len(acc)] * _MULT[j % len(_MULT)])) * _MULT[(j + 3) % len(_MULT)]
            acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def need(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix_lists(n: int, percent: int) -> tuple[int, int]:
    """(length of the prefix, lists at least that a linked partner shares with it)."""
    t = need(n, percent)
    spare = lambda x: max(1, math.ceil(SLACK * x))
    return min(n, n - t + spare(n)), spare(t)


def _prefixes(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.claim("shingles")
        for part in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                s = shingle_set(text, width)
                sign = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""
                size, least = prefix_lists(len(s), percent) if len(s) else (0, 0)
                for col, x in zip(out, (doc, len(s), sign, least, s[:size].view(np.int64)), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.list_(pa.int64()))], ["doc_id", "n", "sign", "least", "pre"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.claim("shingles")
        for part in slices(batches):
            sets = [shingle_set(t, width).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *[part.column(i) for i in range(2, part.num_columns)], pa.array(sets, pa.binary())], [part.schema.names[0], *part.schema.names[2:], "shingles"])

    return run


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(document, lists it is in) for documents in at least ``least`` of the ascending lists, by a heap; lists that cannot
    complete such a number skip ahead by binary search."""
    at = [0] * len(lists)
    heap = [(x[0], k) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            yield top, len(popped)
            goal = top + 1
        else:
            while len(popped) < least - 1 and heap:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            goal = heap[0][0]
        for k in popped:
            own = lists[k]
            at[k] = i = bisect.bisect_left(own, goal, at[k])
            if i < len(own):
                heapq.heappush(heap, (own[i], k))


def divide_skip(sets: list[np.ndarray], percent: int, queries: list[int], indexed: list[int]) -> Iterator[tuple[int, int]]:
    """Links (spanning, not all) between the query documents and the indexed ones; both are positions in ``sets``.

    A query's short lists are merged by a heap, documents that occur often enough in them are looked for in its long lists by
    binary search. Documents that are connected already are left out of the lists. Where the queries are the indexed
    documents, a document that was asked leaves the index, and those of the largest component are asked
    last: once only they are left, every pair is settled.
    """
    indexed, same = sorted(indexed), sorted(queries) == sorted(indexed)
    label = np.arange(len(sets))  # connected documents share a number
    members = {i: [i] for i in {*queries, *indexed}}
    largest = -1
    at = {d: i for i, d in enumerate(indexed)}
    docs, alive = np.array(indexed), np.ones(len(indexed), bool)
    keys, lists = np.unique(np.concatenate([sets[d] for d in indexed]), return_inverse=True)
    n_of = np.array([len(sets[d]) for d in indexed])
    owner = np.repeat(np.arange(len(indexed)), n_of)
    order = np.argsort(lists, kind="stable")
    postings = owner[order]
    places = lists[order] * len(indexed) + postings  # ascending: list by list, document by document
    sizes = np.bincount(lists, minlength=len(keys))
    starts = np.cumsum(sizes) - sizes
    own = np.split(lists, np.cumsum(n_of)[:-1])

    def ask(q: int) -> Iterator[tuple[int, int]]:
        nonlocal largest
        n = len(sets[q])
        if q in at:
            mine = own[at[q]]
        else:
            pos = np.searchsorted(keys, sets[q])
            pos[pos == len(keys)] = 0
            mine = pos[keys[pos] == sets[q]]
        t = need(n, percent)
        if len(mine) < t:
            return
        by_length = mine[np.argsort(sizes[mine], kind="stable")]
        n_long = max(0, min(t - 1, int(t / (0.02 * math.log2(int(sizes[by_length[-1]]) + 1) + 1))))
        n_long = min(n_long, len(mine) - 1)
        short, long = by_length[: len(mine) - n_long], np.sort(by_length[len(mine) - n_long :])
        each = sizes[short]
        if int(each.sum()) == len(short) and q in at:
            return  # every short list holds the query alone
        which = np.repeat(np.arange(len(short)), each)
        found = postings[np.repeat(starts[short] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
        fits = (100 * np.minimum(n, n_of) >= percent * np.maximum(n, n_of)) & alive
        more, last = True, -1
        while more:
            more = False
            keep = (fits & (label[docs] != label[q]))[found] & (found > last)
            found, which = found[keep], which[keep]
            if not len(found):
                return
            merged = [x.tolist() for x in np.split(found, np.flatnonzero(np.diff(which)) + 1)]
            for d, seen in merge_skip(merged, max(1, t - n_long)):
                other = indexed[d]
                if label[q] == label[other]:
                    continue
                wanted = long * len(indexed) + d
                probe = np.searchsorted(places, wanted)
                probe[probe == len(places)] = 0
                both = seen + int((places[probe] == wanted).sum())
                if 100 * both >= percent * (n + int(n_of[d]) - both):
                    joined = len(members[int(label[other])])
                    a, b = sorted((int(label[q]), int(label[other])), key=lambda x: -len(members[x]))
                    moved = members.pop(b)
                    members[a] += moved
                    label[moved] = a
                    if largest not in members or len(members[a]) > len(members[largest]):
                        largest = a
                    yield q, other
                    if joined > 16:  # leave the others of that component out of the lists
                        more, last = True, d
                        break

    waiting = list(queries)
    while waiting:
        later = []
        for q in waiting:
            if same and label[q] == largest:
                later.append(q)
                continue
            if len(members) == 1:
                return
            yield from ask(q)
            if same:
                alive[at[q]] = False
        waiting = [] if all(label[q] == largest for q in later) else later


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in sorted_groups(batches, ["cls", "i", "j"]):
            docs = group.column("doc_id").to_pylist()
            blocks = group.column("b").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            queries = [k for k, b in enumerate(blocks) if b == i]
            indexed = [k for k, b in enumerate(blocks) if b == j]
            if not queries or not indexed:
                continue
            links = [(docs[a], docs[b]) for a, b in divide_skip(sets, percent, queries, indexed)]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["src", "dst"])

    return run


def jaccard_classes(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Null and empty texts have an empty set and link with nothing; their component is their own id. Rows with a null id
    keep a null component and link with nothing. Repeated rows are copies of each other; rows that share an id
    are one document to the links. Other columns of the input are not read.
    """
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(base.mapInArrow(_prefixes(width, percent), "doc_id long, n long, sign binary, least long, pre array<long>"), "shingles")
    full = rows.filter("n > 0 and doc_id is not null")
    classes = written(full.groupBy("n", "sign").agg(F.min("doc_id").alias("rep")), "copies")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "n", "sign"), ["doc_id", "n", "sign"], "left_semi").dropDuplicates(["doc_id", "n", "sign"])

    entry = reps.select("doc_id", "least", F.explode("pre").alias("h"))
    by_doc = Window.partitionBy("doc_id")
    common = entry.groupBy(F.col("h").alias("k")).agg(F.count("*").alias("df")).filter("df > 1")  # counts meet, never the rows of a list
    shared = entry.join(common.select(F.expr("k + 0L").alias("h"), "df"), "h")
    ranked = shared.withColumns({"met": F.count("*").over(by_doc), "longest": F.row_number().over(by_doc.orderBy(F.desc("df"), "h"))})
    short = written(ranked.filter("met >= least and longest >= least").select("doc_id", "h"), "lists")
    heads = short.groupBy("h").agg(F.min("doc_id").alias("dst"), F.count("*").alias("c")).filter("c > 1").drop("c")
    stars = short.join(heads, "h").filter("doc_id != dst").select(F.col("doc_id").alias("src"), "dst").distinct()
    cand = components(stars).select(F.col("node").alias("doc_id"), F.col("component").alias("cls"))

    sized = written(cand.join(full.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id"), "classes")
    blocks = sized.groupBy("cls").agg(F.sum("n").alias("total")).select("cls", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("g"))
    placed = sized.join(blocks, "cls").select("doc_id", "cls", "g", F.pmod(F.xxhash64("doc_id"), F.col("g")).cast("int").alias("b"))
    texts = base.filter("doc_id is not null and text is not null").join(placed.hint("merge"), "doc_id").select("doc_id", "text", "cls", "g", "b")
    sets = texts.mapInArrow(_sets(width), "doc_id long, cls long, g int, b int, shingles binary").filter("length(shingles) > 0")
    pairs = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("doc_id", "cls", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "shingles")
    links = pairs.repartition("cls", "i", "j").sortWithinPartitions("cls", "i", "j", "doc_id").mapInArrow(_verify(percent), "src long, dst long")
    comp = components(links)
    named = classes.join(comp, classes.rep == comp.node, "left").select("n", "sign", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "sign").join(named, ["n", "sign"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
