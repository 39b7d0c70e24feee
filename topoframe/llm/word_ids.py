"""Token ids of whole texts by the tokenizers library, through a bounded memo of white-space-delimited pieces.

Both kinds of vocabulary cut a text at every space that stands before a non-space, so such pieces
encode alone as they do in the text; texts where that isn't plain (runs of spaces, special-token marks) go to the library whole
or are cut by the pattern that keeps white space exact.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .common import Memo, laid_out, numbered_words, with_rows

#: The characters that the vocabularies' patterns call white space.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]")
_HAS_SPACE = re.compile(f"[{SPACES}]")

#: Letters up to the Latin extensions; words of these, digits and ASCII marks are cut here as the vocabularies' patterns cut them.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_PLAIN = re.compile(f"[!-~{_LETTERS}]+(?:\n[!-~{_LETTERS}]+)*")
_UNITS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+|\n| ?[^ \n{_LETTERS}0-9]+")
_LOWER_UNITS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^ \n{_LETTERS}0-9]+")
#: Texts that aren't plain runs of words between single spaces.
_ODD = rf"<\|| [ {SPACES}]|[{SPACES}] |^ | $|^$"
#: Words that a worker remembers, some 200 bytes each.
WORD_ENTRIES = 900_000


def _byte_marks() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + n for n, b in enumerate(others)}


_BYTE_MARKS = _byte_marks()


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class WordIds:
    """ids of a text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None  # the word-end vocabulary normalises and drops white space
        self.words = Memo(self._word, WORD_ENTRIES)
        self.chunks = Memo(self._chunk)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """A word with the space before it."""
        if word.isascii() and word.isalpha():  # most words, without a look at the patterns
            return _packed([t.id for t in self.model.tokenize(word.lower() if self.lower else "\u0120" + word)])
        text = word if self.lower else " " + word
        if _PLAIN.fullmatch(word):
            return self._plain(text)
        return self._pieces(text) if _HAS_SPACE.search(word) else self._whole(text)

    def _chunk(self, text: str) -> bytes:
        return self._plain(text) if _PLAIN.fullmatch(text, text.startswith(" ")) else self._whole(text)

    def _plain(self, text: str) -> bytes:
        """Units of the pattern go to the library's model one by one, as its byte-level alphabet writes them; letters after a space are remembered as words."""
        if self.lower:
            if "\u0130" in text:  # the one letter here that lower case makes two of
                return self._whole(text)
            text = text.lower()
        units = (_LOWER_UNITS if self.lower else _UNITS).findall(text)
        if len(units) != 1:
            words, chunks = self.words, self.chunks
            if self.lower:
                return b"".join([words[u] if u.isalpha() else chunks[u] for u in units])
            return b"".join([words[u[1:]] if u[0] == " " and u[1:].isalpha() else chunks[u] for u in units])
        unit = units[0]
        unit = unit.replace(" ", "\u0120").replace("\n", "\u010a") if unit.isascii() else unit.encode("utf-8").decode("latin-1").translate(_BYTE_MARKS)
        return _packed([t.id for t in self.model.tokenize(unit)])

    def _pieces(self, text: str) -> bytes:
        table = self.chunks
        if self.lower:
            return b"".join([table[w] for w in re.split(f"[{SPACES}]+", text) if w])
        return b"".join([table[w] for w in _CHUNK.findall(text)])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self._whole(text)
        if self.lower and (text.isascii() or ("\u0130" not in text and max(text) < "\u0250")):
            text = text.lower()  # letter by letter up to here, without compositions, so one memo entry serves every case
        words = text.split(" ")
        if self.lower or "" in words:
            return self._pieces(text) if "" in words else self._joined(words)
        if len(words[0]) and not _HAS_SPACE.search(words[0]):
            return self.chunks[words[0]] + self._joined(words[1:])
        return self._pieces(words[0]) + self._joined(words[1:])

    def _joined(self, words: list[str]) -> bytes:
        table = self.words
        return b"".join([table[w] for w in words])

    def columns(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text): as ids(), each text followed by end_id if given.

        Words are split and numbered by Arrow, so a word costs one lookup in a column, however often it occurs there.
        """
        where, names, code, stops, flat = numbered_words(texts, _ODD)
        if self.lower:
            names = [w.lower() if w.isascii() or _PLAIN.fullmatch(w) and "\u0130" not in w else w for w in names]
        known = self.words.many(names)
        if not self.lower:  # a text's first word has no space before it
            first = np.unique(stops[:-1][stops[:-1] < stops[1:]])
            code[first] = len(known) + np.arange(len(first))
            known += [self._first(w) for w in flat.take(pa.array(first)).to_pylist()] if len(first) else []
        if len(where):
            code, stops = with_rows(code, stops, where, len(known))
            known += [self.ids(t) for t in texts.take(pa.array(where)).to_pylist()]
        if end_id is not None:
            code = np.insert(code, stops[1:], len(known))
            known.append(_packed([end_id]))
            stops = stops + np.arange(len(stops))
        data, at = laid_out(known, code, stops)
        return np.frombuffer(data, "<u4"), at // 4

    def _first(self, word: str) -> bytes:
        return self._pieces(word) if _HAS_SPACE.search(word) else self.chunks[word]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str, words: int = WORD_ENTRIES) -> WordIds:
    """The encoder of a vocabulary in this process, which remembers so many words."""
    Memo.claim(path)
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    _loaded[path].words.most = words // 2
    return _loaded[path]


def vocabulary_size(path: str) -> int:
    return word_ids(path).tokenizer.get_vocab_size()
