"""SentencePiece BPE encoding by backtracking, and decoding, without the library.

A sequence of pieces is the encoding of a text if and only if every adjacent pair is the encoding of its own
concatenation (and each piece the encoding of itself). So: Aho-Corasick finds the longest piece at each position;
a piece is accepted if it is compatible with the one before it, which is checked by merging the two
again; otherwise the next shorter piece is tried, and a position from which nothing fits is marked
in a bitfield and never entered again. Pieces hold no white space after other characters, so a text is encoded word by word.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, laid_out, numbered_words, prepare, slices, text_slices, with_rows

#: Fixed values of the model file format: piece types, and the space mark.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
_NONE = 1 << 60


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: (number, bytes, int or raw fixed bytes)."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


class PieceBpe:
    """Vocabulary, ranks and merge histories of a BPE model file."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.types: list[int] = []
        scores: list[float] = []
        normal = {}
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                one = dict(_fields(value))
                self.pieces.append(one[1].decode("utf-8"))
                scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                self.types.append(one.get(3, NORMAL))
            elif number == 3:
                normal = dict(_fields(value))
        self.dummy_prefix, self.squeeze, charsmap = bool(normal.get(3, 1)), bool(normal.get(4, 1)), normal.get(2, b"")
        if self.squeeze or charsmap or USER in self.types or UNUSED in self.types or not normal.get(5, 1):
            raise ValueError("only models without normalisation rules, user symbols and unused pieces are supported")
        self.unk = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        usable = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        place = {s: n for n, s in enumerate(sorted({scores[i] for i in usable.values()}, reverse=True))}
        self.rank = {p: place[scores[i]] for p, i in usable.items()}
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in usable)
        self.id_of, self.history = {}, {}
        self.auto = ahocorasick.Automaton()
        for p, i in usable.items():
            h = self._history(p)
            if h is not None:
                self.id_of[p], self.history[p] = i, h
                self.auto.add_word(p, len(p))
        self.auto.make_automaton()
        starts = lambda p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id_of or k == 1), "")
        self.shorter = {p: starts(p) for p in self.id_of}  # the next shorter piece that a piece starts with; one character always can stand
        self.number = [f"{i}," for i in range(len(self.pieces))]
        self.plain = [p.replace(MARK, " ") if t == NORMAL else None for p, t in zip(self.pieces, self.types, strict=True)]
        self._fits: dict[str, dict[str, bool]] = {}
        self._n_fits = 0
        self.words = Memo(self._word)

    def _history(self, piece: str) -> tuple[list[int], list[str], list[str]] | None:
        """Ranks of the merges that build a piece alone, in order, with its first and last symbol after each; None if they end elsewhere."""
        symbols, rank = list(piece), self.rank
        ranks, firsts, lasts = [], [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            r, i = min((rank.get(symbols[k] + symbols[k + 1], _NONE), k) for k in range(len(symbols) - 1))
            if r == _NONE:
                return None
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            ranks.append(r)
            firsts.append(symbols[0])
            lasts.append(symbols[-1])
        return ranks, firsts, lasts

    def fits(self, a: str, b: str) -> bool:
        """Merge both again side by side, best rank first and leftmost on ties: does no merge cross the border?"""
        left, right = self.history.get(a) or ([], [a], [a]), self.history.get(b) or ([], [b], [b])
        (ra, _, lasts), (rb, firsts, _) = left, right
        na, nb, i, j, rank, ok = len(ra), len(rb), 0, 0, self.rank, True
        while True:
            across = rank.get(lasts[i] + firsts[j], _NONE)
            x, y = ra[i] if i < na else _NONE, rb[j] if j < nb else _NONE
            if x < _NONE and x <= across and x <= y:
                i += 1
            elif across < _NONE and across <= y:
                ok = False
                break
            elif y < _NONE:
                j += 1
            else:
                break
        if self._n_fits > 600_000:
            self._fits.clear()
            self._n_fits = 0
        self._n_fits += 1
        self._fits.setdefault(a, {})[b] = ok
        return ok

    def segment(self, s: str) -> list[str]:
        """Pieces of a marked string; a character of no piece stands alone."""
        n = len(s)
        if s in self.id_of:
            return [s]
        longest = [1] * n
        for end, length in self.auto.iter(s):  # ends ascend, so the longest match from a place is the last one seen
            longest[end - length + 1] = length
        dead = bytearray(n + 1)
        out: list[str] = []
        pos, piece, shorter, seen, none = 0, s[: longest[0]] if n else "", self.shorter, self._fits, {}
        while pos < n:
            while piece:
                stop = pos + len(piece)
                if not dead[stop]:
                    if not out:
                        break
                    ok = seen.get(out[-1], none).get(piece)
                    if ok or ok is None and self.fits(out[-1], piece):
                        break
                piece = shorter.get(piece, "")
            if piece:
                out.append(piece)
                pos = stop
                piece = s[pos : pos + longest[pos]] if pos < n else ""
            else:
                dead[pos] = 1
                if not out:
                    raise AssertionError("no segmentation")
                last = out.pop()
                pos -= len(last)
                piece = shorter.get(last, "")
        return out

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.id_of.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[x] for x in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def _word(self, word: str) -> tuple[int, str, str]:
        """Of a word with a space before it: number of ids, the ids, each with a comma behind it, and what they decode to."""
        pieces = self.segment(MARK + word)
        try:
            ids = [self.id_of[p] for p in pieces]
            return len(ids), "".join([self.number[i] for i in ids]), "".join([self.plain[i] for i in ids])
        except KeyError:
            ids = self.ids(pieces)
            return len(ids), "".join([self.number[i] for i in ids]), self.raw_decode(ids)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        s = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        parts = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", s) if self.by_word else [s]
        return [i for p in parts for i in self.ids(self.segment(p))]

    def raw_decode(self, ids: list[int]) -> str:
        """Text of ids with the leading space of a dummy prefix still there."""
        out, run = [], bytearray()

        def flush() -> None:
            if run:
                out.append(run.decode("utf-8", "replace_each"))
                run.clear()

        for i in ids:
            kind = self.types[i]
            if kind == BYTE:
                run.append(int(self.pieces[i][3:-1], 16))
                continue
            flush()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind != CONTROL:
                out.append(self.pieces[i].replace(MARK, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if self.types[i] != CONTROL), None)
        text = self.raw_decode(ids)
        return text[1:] if self.dummy_prefix and first is not None and self.pieces[first].startswith(MARK) else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by commas, decoded text)."""
        ids = self.encode(text or "")
        return len(ids), ",".join(map(str, ids)), self.decode(ids)

    def digests(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """Of every text the number of ids and the sha256 of both texts of digest(); a word costs one lookup in a column, however often it occurs there."""
        if not (self.by_word and self.dummy_prefix):
            where, names, code, stops = np.arange(len(texts)), [], np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        else:
            where, names, code, stops, _ = numbered_words(texts, f"{MARK}|  |^ | $|^$")
        known = self.words.many(names)
        size, joined, decoded = [k[0] for k in known], [k[1].encode() for k in known], [k[2].encode("utf-8", "surrogatepass") for k in known]
        if len(where):
            code, stops = with_rows(code, stops, where, len(known))
            for n, a, b in map(self.digest, texts.take(pa.array(where)).to_pylist()):
                size.append(n)
                joined.append(f"{a},".encode() if a else b"")
                decoded.append(f" {b}".encode("utf-8", "surrogatepass"))
        counts = np.concatenate([[0], np.cumsum(np.array(size, np.int64)[code])])[stops]
        sha = lambda data, at, head, tail: [hashlib.sha256(data[min(a + head, b) : max(a, b - tail)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return np.diff(counts).tolist(), sha(*laid_out(joined, code, stops), 0, 1), sha(*laid_out(decoded, code, stops), 1, 0)


def _replace_each(error: UnicodeDecodeError):
    """One replacement character for each byte that starts no character."""
    return "�", error.start + 1


import codecs  # noqa: E402

codecs.register_error("replace_each", _replace_each)

_models: dict[str, PieceBpe] = {}


def model(path: str) -> PieceBpe:
    Memo.claim(path)
    if path not in _models:
        _models[path] = PieceBpe(path)
    return _models[path]


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for part in text_slices(batches, 1):
            n, ids, decoded = bpe.digests(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for part in slices(batches):
            ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids])], ["doc_id", "ids", "decoded"])

    return run


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): whole texts to ids and back. Null and empty texts have no ids and decode to nothing; every row stays, null and repeated ids too."""
    return _base(docs, id_col, text_col).mapInArrow(_encoded(path), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), but with the number of ids and sha256 of the comma-joined ids and of the decoded text."""
    return _base(docs, id_col, text_col).mapInArrow(_run(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
