"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves hold runs of pre-tokens (text and token count), inner nodes the
sums of characters and tokens. An edit finds its leaves by character offset, takes in the neighbouring
pre-tokens (their borders depend on one character of context on either side), cuts and encodes that region again
and updates the sums above; the rest of the text is not looked at.

build() keeps the trees of a table of documents in shared storage; apply() takes them and a table of edits and gives the new trees, so a
corpus that changes is encoded again only where it changed. Documents without edits are passed on as they are.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices
from .word_ids import _CHUNK, SPACES, WordIds, word_ids

LEAF = 32
#: Pre-tokens on either side of an edit that are cut again: a run of white space is two at most, so three hold a word.
CONTEXT = 3
_SPACE_RUN = re.compile(f"[{SPACES}]+")


class CountTree:
    """Pre-tokens of a text with subtree sums of characters and tokens, open to edits."""

    def __init__(self, text: str, encoder: WordIds, kept: tuple[bytes, bytes] | None = None):
        """A tree over a text; ``kept`` are the lengths and token counts of its pre-tokens as kept() gave them, so nothing is encoded."""
        self.encoder = encoder
        if kept is None:
            pre = _CHUNK.findall(text)
        else:
            ends = np.cumsum(np.frombuffer(kept[0], "<u4"), dtype=np.int64).tolist()
            pre = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.leaves = [pre[i : i + LEAF] for i in range(0, len(pre), LEAF)] or [[]]
        self.encoded_chars = len(text) if kept is None else 0
        self._build(None if kept is None else np.frombuffer(kept[1], "<u4").tolist())

    def kept(self) -> tuple[str, bytes, bytes]:
        """The text, and the lengths and token counts of its pre-tokens."""
        pre, table = [p for leaf in self.leaves for p in leaf], self.encoder.chunks
        return "".join(pre), np.array([len(p) for p in pre], "<u4").tobytes(), np.array([len(table[p]) // 4 for p in pre], "<u4").tobytes()

    def _sums(self, leaf: list[str]) -> tuple[int, int]:
        table = self.encoder.chunks
        return sum(map(len, leaf)), sum([len(table[p]) for p in leaf]) // 4

    def _build(self, counts: list[int] | None = None) -> None:
        n = len(self.leaves)
        self.size = 1 << max(0, (n - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            sums = self._sums(leaf) if counts is None else (sum(map(len, leaf)), sum(counts[i * LEAF : (i + 1) * LEAF]))
            self.chars[self.size + i], self.tokens[self.size + i] = sums
        for k in range(self.size - 1, 0, -1):
            self._pull(k)

    def _pull(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, offset in it) of a character; the last leaf's end for the end of the text."""
        k = 1
        while k < self.size:
            left = self.chars[2 * k]
            if at < left or (at == left and not self.chars[2 * k + 1]):
                k = 2 * k
            else:
                at -= left
                k = 2 * k + 1
        return min(k - self.size, len(self.leaves) - 1), at

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters start to stop (clamped to the text) by ``new``."""
        start = max(0, min(start, self.n_chars))
        stop = max(start, min(stop, self.n_chars))
        first, offset = self._find(start)
        last, end = self._find(stop)
        before, after, head, tail = first, last, [], []
        while before > 0 and len(head) < CONTEXT:  # leaves may be short or empty after earlier edits
            before -= 1
            head = self.leaves[before] + head
        while after + 1 < len(self.leaves) and len(tail) < CONTEXT + 2:
            after += 1
            tail = tail + self.leaves[after]
        front, back = "".join(self.leaves[first])[:offset], "".join(self.leaves[last])[end:]
        keep_head, keep_tail = max(0, len(head) - CONTEXT), min(len(tail), CONTEXT)
        while keep_tail < len(tail) and _SPACE_RUN.fullmatch(tail[keep_tail - 1]):
            keep_tail += 1  # how a run of white space is cut depends on what follows it
        region = "".join(head[keep_head:]) + front + new + back + "".join(tail[:keep_tail])
        fresh = head[:keep_head] + _CHUNK.findall(region) + tail[keep_tail:]
        self.encoded_chars += len(region)
        if len(fresh) <= 2 * LEAF * (after - before + 1):
            step = -(-len(fresh) // (after - before + 1)) or 1
            for n, i in enumerate(range(before, after + 1)):
                self.leaves[i] = fresh[n * step : (n + 1) * step]
            for i in range(before, after + 1):
                self.chars[self.size + i], self.tokens[self.size + i] = self._sums(self.leaves[i])
            low, high = (self.size + before) // 2, (self.size + after) // 2
            while low:
                for k in range(low, high + 1):
                    self._pull(k)
                low, high = low // 2, high // 2
        else:  # the leaves are too few now: cut them anew; token counts come from the memo
            self.leaves[before : after + 1] = [fresh[i : i + LEAF] for i in range(0, len(fresh), LEAF)]
            self._build()

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)


def sample_edits(doc_id: int | None, text: str, n: int = 4) -> list[tuple[int, int, str]]:
    """Deterministic edits of a document (start, stop, new text), to be applied in turn: insertions, deletions and replacements."""
    r = random.Random(f"{doc_id}:{len(text)}")
    size, out = len(text), []
    for k in range(n):
        start = r.randint(0, size)
        stop = start if k % 3 == 0 else min(size, start + r.randint(1, 40))
        new = "" if k % 3 == 1 else r.choice([" revised", "\n", " 2024", "x", "  ", " new words here,", "'s"])
        out.append((start, stop, new))
        size += len(new) - (stop - start)
    return out


def _run(path: str, n_edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for part in slices(batches):
            out = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                tree = CountTree(text or "", encoder)
                before, spent = tree.n_tokens, tree.encoded_chars
                edits = sample_edits(doc, text or "", n_edits)
                for e in edits:
                    tree.edit(*e)
                out.append((doc, before, len(edits), tree.n_tokens, tree.n_chars, tree.encoded_chars - spent))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "chars_reencoded"])

    return run


def edited_counts(docs: DataFrame, path: str, n_edits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_chars_after, chars_reencoded) of every document before and after its edits.

    A null text counts as an empty one and is edited like it; rows with a null id and repeated rows stay.
    Texts with marks of special tokens are counted as ordinary text. Other columns are not read.
    """
    prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_run(path, n_edits), "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, chars_reencoded long")


TREE = "doc_id long, text string, lengths binary, counts binary, n_tokens long, n_chars long"


def _trees(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for part in slices(batches):
            yield _tree_batch([(doc, CountTree(text or "", encoder)) for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)])

    return run


def _tree_batch(trees: list[tuple[int | None, CountTree]], changed: list[tuple[int, int]] | None = None) -> pa.RecordBatch:
    rows = [(doc, *tree.kept(), tree.n_tokens, tree.n_chars) for doc, tree in trees]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
    names = ["doc_id", "text", "lengths", "counts", "n_tokens", "n_chars"]
    if changed is not None:
        cols += [pa.array([c[i] for c in changed], pa.int64()) for i in (0, 1)]
        names += ["n_edits", "chars_reencoded"]
    return pa.RecordBatch.from_arrays(cols, names)


def build(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a tree for every row of docs to a table in ``folder`` (null texts as empty ones) and read it: (doc_id, text, lengths, counts, n_tokens, n_chars)."""
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base.mapInArrow(_trees(path), TREE).write.parquet(folder)
    return spark.read.parquet(folder)


def _apply(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        current, held, done = None, [], 0

        def finished() -> Iterator[pa.RecordBatch]:
            if held:
                yield _tree_batch([(current, t) for t in held], [(done, t.encoded_chars) for t in held])

        for part in slices(batches):
            rows = {c: part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "seq", "start", "stop", "text", "lengths", "counts")}
            for doc, seq, start, stop, text, lengths, counts in zip(*rows.values(), strict=True):
                if doc != current:
                    yield from finished()
                    current, held, done = doc, [], 0
                if lengths is not None:  # trees come before edits
                    held.append(CountTree(text, encoder, (lengths, counts)))
                else:
                    done += 1
                    for tree in held:
                        tree.edit(start or 0, tree.n_chars if stop is None else stop, text or "")
        yield from finished()

    return run


def apply(trees: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """The trees after a table of edits (doc_id, seq, start, stop, text), with n_edits and chars_reencoded.

    A document's edits are taken in the order of seq (then start, stop, text); each replaces the characters from start up to stop, as the
    text stands then, clamped to it. A null start is 0, a null stop the text's end, a null text empty. Rows that share an id
    get the same edits each. Edits of no document, and of a null id, change nothing; trees without edits, and those with a null id, are passed
    on without being moved. A document's edits pass one task one after the other, each in turn, and are never held together.
    """
    prepare(trees.sparkSession)
    own = trees.select("doc_id", "text", "lengths", "counts", "n_tokens", "n_chars")
    given = edits.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "text")
    ids = given.select("doc_id").distinct()
    still = own.join(ids, "doc_id", "left_anti").withColumns({"n_edits": F.lit(0).cast("long"), "chars_reencoded": F.lit(0).cast("long")})
    touched = own.join(ids, "doc_id", "left_semi").select("doc_id", F.lit(0).alias("late"), "text", "lengths", "counts", *(F.lit(None).cast("long").alias(c) for c in ("seq", "start", "stop")))
    work = touched.unionByName(given.select("doc_id", F.lit(1).alias("late"), "text", *(F.lit(None).cast("binary").alias(c) for c in ("lengths", "counts")), "seq", "start", "stop"))
    ordered = work.repartition("doc_id").sortWithinPartitions("doc_id", "late", "seq", "start", "stop", "text")
    return ordered.mapInArrow(_apply(path), f"{TREE}, n_edits long, chars_reencoded long").unionByName(still)
