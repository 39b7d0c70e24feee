"""Shared plumbing of the training-data operators: shared storage, materialised cuts, slices of Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time; the Arrow batch itself stays columnar.
SLICE_ROWS = 256
#: Upper bound of entries in a memo table of a worker, some 200 bytes each.
MEMO_ENTRIES = 600_000
#: Places of the marks that tell which keys were asked for before; a power of two.
SEEN = 1 << 21


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed but its folder is visible to them."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset in local mode. On a cluster it must be set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="topoframe-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/topoframe-{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Have a scratch folder removed when the driver's JVM ends: results read from it later still find it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).deleteOnExit(folder)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder, so that a lost executor costs no recomputation from the start."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    discard(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 4096, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and so many bytes of text (a longer text is a slice of its own)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before, at = np.concatenate([[0], np.cumsum(size)]), 0
        while at < batch.num_rows:
            stop = min(at + rows, max(at + 1, int(np.searchsorted(before, before[at] + most, "right")) - 1))
            yield batch.slice(at, stop - at)
            at = stop


def numbered_words(texts: pa.Array, odd: str) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, pa.Array]:
    """Texts split at single spaces: (rows that match ``odd``, which have no words here; distinct words; number of the word at each place; offsets of the rows; all words)."""
    skip = pc.fill_null(pc.match_substring_regex(texts, odd), False).to_numpy(zero_copy_only=False)
    where = np.flatnonzero(skip)
    split = pc.split_pattern(texts.take(pa.array(np.arange(len(texts)), mask=skip)) if len(where) else texts, " ")
    words, count = split.flatten(), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    stops = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    if not len(words):
        return where, [], np.empty(0, np.int64), stops, words
    numbered = words.dictionary_encode()
    return where, numbered.dictionary.to_pylist(), numbered.indices.to_numpy().astype(np.int64), stops, words


def with_rows(code: np.ndarray, stops: np.ndarray, where: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """One entry more, numbered from ``first``, for each of the rows ``where``."""
    added = np.zeros(len(stops), np.int64)
    added[where + 1] = 1
    return np.insert(code, stops[where], first + np.arange(len(where))), stops + np.cumsum(added)


def laid_out(entries: list[bytes], code: np.ndarray, stops: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries in the order of code, one after the other, and the offset of each row's first byte."""
    if not len(code):
        return memoryview(b""), np.zeros(len(stops), np.int64)
    joined = pa.array(entries, pa.large_binary()).take(pa.array(code))
    _, ends, data = joined.buffers()
    return memoryview(data), np.frombuffer(ends, np.int64)[: len(code) + 1][stops]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of adjacent equal keys of a sorted partition, one in memory at a time."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*cols, strict=True)):
            if key != current:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield current, pa.Table.from_batches(held)
                held, current, start = [], key, i
        held.append(batch.slice(start))
    if held:
        yield current, pa.Table.from_batches(held)


class Memo(dict):
    """A dict that fills itself, in two generations: when the young one is full it becomes the old one, from which used entries return.

    All memos of a worker together hold one operator's entries: claim() empties those of the one before.
    """

    owner: str | None = None
    living: list[Memo] = []

    def __init__(self, make, most: int = MEMO_ENTRIES, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most // 2, longest, {}
        self.seen = bytearray(SEEN)
        Memo.living.append(self)

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def many(self, keys: list) -> list:
        """The values of distinct keys. A key is remembered from the second call on that asks for it: most words occur once."""
        out, make, longest, seen = [*map(self.get, keys)], self.make, self.longest, self.seen
        for i, x in enumerate(out):
            if x is None:
                key = keys[i]
                out[i] = value = self.old.get(key) or make(key)
                at = hash(key) & SEEN - 1
                if seen[at] and len(key) <= longest:
                    self[key] = value
                seen[at] = 1
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        return out

    def __reduce__(self):
        raise TypeError("a memo stays in its worker")

    @classmethod
    def claim(cls, owner: str) -> None:
        """Called where an operator starts in a task; a reused worker doesn't keep what other operators remembered."""
        if cls.owner not in (None, owner):
            for memo in cls.living:
                memo.clear()
                memo.old = {}
                memo.seen = bytearray(SEEN)
            pa.default_memory_pool().release_unused()  # else a reused worker keeps what Arrow freed
        cls.owner = owner


def crc_fold(col):
    """crc32 of an id written as text, modulo 3."""
    return F.crc32(col.cast("string").cast("binary")) % 3
