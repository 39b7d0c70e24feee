"""Token-id files with bit- or byte-plane shuffling.

A file holds the ids of documents in ascending doc_id order as unsigned 32-bit integers, in chunks of a fixed number of ids. A
chunk is transposed into planes - the k-th byte (or bit) of every id - and each plane is compressed by zstandard on its own.
Layout: magic, plane kind; chunk data; the compressed document table (doc ids, null marks, lengths); the compressed
chunk index (file offset of each plane, ids in the chunk); a footer of fixed size that says where both tables are.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, prepare, scratch, slices, text_slices, written
from .word_ids import vocabulary_size, word_ids

MAGIC = b"TFIDPLN1"
#: ids in a chunk; a multiple of 8, so that bit planes are whole bytes but in the last chunk.
CHUNK_IDS = 1 << 16
FOOTER = struct.Struct("<QQQQQQ")  # documents at, documents, chunk index at, chunks, ids, planes
#: Text in a file, roughly, in the unit of the size column; files grow beyond it where there would be more than MOST_FILES.
FILE_BYTES, MOST_FILES = 64 << 20, 20_000


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    data = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [data[:, k].tobytes() for k in range(4)]
    spread = np.unpackbits(data, axis=1, bitorder="little")
    return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    spread = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(spread, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Streams documents into a file; holds one chunk and the document table."""

    def __init__(self, out, bits: bool = False, level: int = 3):
        self.out, self.bits, self.zip = out, bits, zstandard.ZstdCompressor(level=level)
        self.held, self.n_held, self.at, self.total = [], 0, 0, 0
        self.index: list[list[int]] = []
        self.docs = (array("q"), array("q"), array("q"))  # id, whether it is null, number of ids
        self._put(MAGIC + bytes([bits]))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        for column, x in zip(self.docs, (doc_id or 0, doc_id is None, len(ids) // 4), strict=True):
            column.append(x)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= CHUNK_IDS:
            data = np.frombuffer(b"".join(self.held), "<u4")
            whole = len(data) // CHUNK_IDS * CHUNK_IDS
            for s in range(0, whole, CHUNK_IDS):
                self._chunk(data[s : s + CHUNK_IDS])
            self.held, self.n_held = [data[whole:].tobytes()], len(data) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        entry = [len(ids)]
        for plane in to_planes(ids, self.bits):
            entry.append(self.at)
            self._put(self.zip.compress(plane))
        self.index.append([*entry, self.at])
        self.total += len(ids)

    def close(self) -> int:
        if self.n_held:
            self._chunk(np.frombuffer(b"".join(self.held), "<u4"))
        docs_at = self.at
        self._put(self.zip.compress(b"".join(column.tobytes() for column in self.docs)))
        index_at = self.at
        self._put(self.zip.compress(np.array(self.index, dtype="<i8").tobytes()))
        self._put(FOOTER.pack(docs_at, len(self.docs[0]), index_at, len(self.index), self.total, 32 if self.bits else 4))
        return self.total


@dataclass
class Reader:
    """Random access by chunk, or documents in order."""

    source: object  # a seekable binary file

    def __post_init__(self):
        size = self.source.seek(0, 2)
        head = self._at(0, len(MAGIC))
        if head != MAGIC:
            raise ValueError("not a token-id file")
        docs_at, n_docs, index_at, n_chunks, self.total, self.n_planes = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        unzip = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(unzip.decompress(self._at(docs_at, index_at - docs_at)), "<i8").reshape(3, n_docs)
        self.index = np.frombuffer(unzip.decompress(self._at(index_at, size - FOOTER.size - index_at)), "<i8").reshape(n_chunks, self.n_planes + 2)
        self.unzip = unzip

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        n, *at = (int(x) for x in self.index[k])
        return from_planes([self.unzip.decompress(self._at(a, b - a)) for a, b in zip(at, at[1:], strict=False)], n)

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        held, used, k = b"", 0, 0
        for doc, null, n in zip(*(x.tolist() for x in self.docs), strict=True):
            if len(held) - used < 4 * n:
                parts, have = [held[used:]], len(held) - used
                while have < 4 * n:
                    parts.append(self.chunk(k).tobytes())
                    have += len(parts[-1])
                    k += 1
                held, used = b"".join(parts), 0
            yield None if null else doc, held[used : used + 4 * n]
            used += 4 * n


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as Spark writes it, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _encode(path: str, end_id: int, bounds: np.ndarray, null_files: int, keys: np.ndarray, width: int):
    """(key, file, doc_id, n, crc, ids): the file of each document, and a key that hash partitioning sends to the partition of that number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for part in text_slices(batches, 1):
            ids, at = encoder.columns(part.column(1), end_id)
            data = ids.view("u1").data
            crc = np.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
            doc, null = part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
            file = np.where(null, crc % max(null_files, 1), null_files + low + crc % (high - low + 1))  # an id at a bound may lie on either side
            small = pa.py_buffer(ids.astype(f"<u{width}"))
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at * width), small]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys[file]), pa.array(file.astype(np.int32)), part.column(0), pa.array(np.diff(at)), pa.array(crc), binary], ["key", "file", "doc_id", "n", "crc", "ids"])

    return run


def _write(folder: str, bits: bool, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, (store, root) = TaskContext.get(), _store(folder)
        writer = out = current = name = None

        def finished() -> pa.RecordBatch:
            total = writer.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([total], pa.int64()), pa.array([len(writer.docs[0])], pa.int64())], ["part", "path", "n_ids", "n_docs"])

        for part in slices(batches):
            for file, doc, ids in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("file", "doc_id", "ids")), strict=True):
                if file != current:
                    if writer is not None:
                        yield finished()
                    current, name = file, f"{file:06d}-{task.taskAttemptId()}.ids"  # an attempt never touches another's file
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}")
                    writer = Writer(out, bits)
                writer.add(doc, ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes())
        if writer is not None:
            yield finished()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            store, name = _store(path)
            with store.open_input_file(name) as source:
                out: list[tuple] = []
                for doc, ids in Reader(source).documents():
                    out.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                    if len(out) == 4096:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _layout(base: DataFrame, size: Column) -> tuple[int, np.ndarray, int]:
    """(files for null ids, bounds of the ids in the other files, files), from two scans of the id and size columns."""
    seen = base.select("doc_id", size.alias("size")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    files = min(MOST_FILES, max(1, -(-(seen["size"] or 0) // FILE_BYTES)))
    null_files = -(-files * (seen.n - seen.known) // max(seen.n, 1))
    cuts = max(1, files - null_files) - 1
    bounds: list[int] = []
    if cuts and seen.known:
        at = F.array(*(F.lit((k + 1) / (cuts + 1)) for k in range(cuts)))
        bounds = base.agg(F.percentile_approx("doc_id", at, max(10_000, 10 * cuts)).alias("b")).first().b
    return null_files, np.array(sorted(bounds), np.int64), null_files + len(bounds) + 1


def _keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions an integer that hash partitioning sends there."""
    tried = spark.range(40 * n + 40).select(F.col("id").cast("int").alias("k")).withColumn("p", F.pmod(F.hash("k"), F.lit(n)))
    found = {r.p: r.k for r in tried.groupBy("p").agg(F.min("k").alias("k")).collect()}
    return np.array([found[p] for p in range(n)], np.int32)


def write(docs: DataFrame, path: str, folder: str, end_id: int = 1, bits: bool = False, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """Write ids in ascending doc_id order (null ids first); the manifest (part, path, n_ids, n_docs, start) is returned.

    Texts are scanned once: ids of two bytes, where the vocabulary allows, go to the file of their range of doc_ids. The ranges come
    from quantiles of the id column and the sum of ``size_col`` (of text lengths, if it isn't given). Rows with equal ids may lie in
    several files, in the order of their content, and so do null ids, so no id makes a file of its own size.

    ``folder`` is a URI that every executor sees. Null and empty texts are their end id alone; repeated rows stay as rows; an empty
    table gives an empty manifest. Other columns are not read. The manifest names only files of successful attempts, so a lost
    executor or a retried task leaves no wrong file in it.
    """
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.col(size_col) if size_col else F.octet_length(text_col)).cast("long").alias("size"))
    null_files, bounds, files = _layout(base, F.coalesce("size", F.lit(0)))
    width = 2 if max(end_id, vocabulary_size(path) - 1) < 1 << 16 else 4
    encoded = base.select("doc_id", "text").mapInArrow(_encode(path, end_id, bounds, null_files, _keys(spark, files), width), "key int, file int, doc_id long, n long, crc long, ids binary")
    ordered = encoded.repartition(files, "key").sortWithinPartitions("file", "doc_id", "n", "crc", "ids")
    manifest = written(ordered.mapInArrow(_write(folder, bits, width), "part int, path string, n_ids long, n_docs long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file, MOST_FILES at most
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    n = max(1, manifest.count())
    return manifest.select("path", "start", "part").repartitionByRange(n, "part").select("path", "start").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 1, bits: bool = False, size_col: str | None = None) -> DataFrame:
    """Write the files into the shared folder, which removes them when the session ends, and read them back."""
    spark = docs.sparkSession
    folder = scratch(spark, "ids")
    manifest = write(docs, path, folder, end_id, bits, size_col=size_col)
    discard(spark, folder)
    return read(manifest)
