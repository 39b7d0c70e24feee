"""Best-fit packing planned on a histogram of lengths.

The plan works on counts, not documents: lengths in descending order, each put into the open sequences with the
least room that still fits it, a whole run of equal sequences at a time. The histogram has at most ``size`` rows,
whatever the corpus. Pieces then take the planned slots by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, text_slices, written
from .word_ids import WORD_ENTRIES, word_ids

#: Pieces of one length that are ranked in one task at most (on average).
RANKED = 20_000


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots as (length, first rank, number, first sequence, offset): rank r of a length goes to sequence ``first + r - first rank``."""
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # space left -> runs of sequences (first, number)
    spaces: list[int] = []  # the keys of room, ascending
    opened = 0

    def give(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                bisect.insort(spaces, left)
                room[left] = []
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                break
            left = spaces[at]
            first, n = room[left].pop()
            if not room[left]:
                del room[left], spaces[at]
            k = min(n, todo)
            slots.append((length, rank, k, first, size - left))
            give(left, first + k, n - k)
            give(left - length, first, k)
            rank, todo = rank + k, todo - k
        if todo:
            each = size // length
            full, rest = divmod(todo, each)
            for j in range(each if full else 0):
                slots.append((length, rank, full, opened, j * length))
                rank += full
            give(size - each * length, opened, full)
            opened += full
            for j in range(rest):
                slots.append((length, rank, 1, opened, j * length))
                rank += 1
            if rest:
                give(size - rest * length, opened, 1)
                opened += 1
    return slots


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if they fit, else a shorter first piece (if any is left over) and full ones."""
    if n <= size:
        return [(0, n)] if n else []
    head = n % size
    return ([(0, head)] if head else []) + [(s, size) for s in range(head, n, size)]


def _pieces(path: str, end_id: int, size: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path, words)
        for part in text_slices(batches, 1, most=min(8 << 20, words * 14)):
            ids, at = encoder.columns(part.column(1), end_id)
            data, out = ids.view("u1").data, []
            for doc, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                out += [(doc, k, s, n, zlib.crc32(data[4 * (a + s) : 4 * (a + s + n)])) for k, (s, n) in enumerate(cut(b - a, size))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", words: int = WORD_ENTRIES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A null or empty text is its end id alone. Only documents longer than a sequence are cut. Every row is packed, rows with
    a null id and repeated rows too. An empty table gives no rows. Sequence ids are numbered from 0; pieces of a
    sequence lie without gaps from offset 0. Rows that share an id take places in the order of their content, so a task that runs
    again after a lost executor ranks them as before. Other columns are not read. ``words`` bounds what a worker remembers (some 200 bytes each), for speed only.
    """
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(base.mapInArrow(_pieces(path, end_id, size, words), "doc_id long, piece long, start long, length long, ids_crc32 long"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    lanes = spark.createDataFrame([(n, max(1, -(-c // RANKED))) for n, c in counts.items()], "length long, lanes long")
    rows = pieces.join(F.broadcast(lanes), "length")
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("lanes"))).drop("lanes")
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "lane").agg(F.count("*").alias("c")).select("length", "lane", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("r", F.row_number().over(inside) - 1).join(starts, ["length", "lane"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("base")).alias("rank"))
    slots = spark.createDataFrame(plan(counts, size), "length long, from_rank long, n long, seq long, offset long")
    fits = (ranked["length"] == slots["length"]) & (ranked["rank"] >= slots["from_rank"]) & (ranked["rank"] < slots["from_rank"] + slots["n"])
    return ranked.join(F.broadcast(slots), fits).select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("seq") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")
