"""Cached encoding with the public byte-pair vocabularies.

BPE never merges across a pre-token, so the ids of a text are those of its
pre-tokens in order.  Pieces between single spaces are looked up in a cache
that lives in the Python worker; a new piece is cut into its pre-tokens, plain
letter runs go straight to the library's BPE model and everything else through
its full encode.  A text with runs of white space is cut at every change from
non-space to space instead, which is a pre-token boundary too.  A text that holds an added token's own spelling is
left to the library as a whole.  The result is the library's own for every text
(``tests/llm/test_tokens_packing_store.py``).
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Letters whose UTF-8 form is stable under NFC and that lower-case one to one
# (U+0130 and U+0149 are left to the full encode).
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
# Punctuation after a word is one pre-token, whatever its length; apostrophes start others.
_MARKS = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*"""
_SIMPLE = re.compile(rf"( ?)([{_LETTERS}]+)({_MARKS})")
_RUNS = re.compile(r"\s*\S+|\s+")
_ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_NOT_RUST_SPACE = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the code points from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return table


def _runs_of_space(text: str) -> bool:
    """Whether white space other than single spaces and line ends occurs."""
    return "  " in text or "\n\n" in text or "\n " in text or " \n" in text or _ODD_SPACE.search(text) is not None


class Encoder(dict):
    """text -> packed ids; the dict itself is the piece cache."""

    def __init__(self, path: str, typecode: str = "I", capacity: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.typecode, self.capacity = self.tokenizer.model, typecode, capacity
        self.itemsize = array(typecode).itemsize
        self.old: dict[str, bytes] = {}
        self.word_ends = self.tokenizer.normalizer is not None  # lower case, white space dropped
        self.letters = _byte_letters()
        self.space = " ".translate(self.letters)
        self.marks: dict[str, bytes] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added_starts = sorted({x for c in added for x in (c[0], c[0].lower(), c[0].upper())})
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self._encode(piece)
        self[piece] = got
        return got

    def _full(self, chunk: str) -> bytes:
        return array(self.typecode, self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _model(self, pretoken: str) -> bytes:
        mapped = pretoken.encode().decode("latin-1").translate(self.letters)
        return array(self.typecode, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _encode(self, chunk: str) -> bytes:
        spaced = chunk[:1] == " "
        body = chunk[1:] if spaced else chunk
        if "\n" in body and not body[0].isspace() and not body[-1].isspace():
            # single line ends between words are pre-tokens of their own
            first, *rest = chunk.split("\n")
            return self[first] + b"".join(map(self.__getitem__, rest if self.word_ends else [p for r in rest for p in ("\n", r)]))
        # ASCII letters stand for themselves in the byte alphabet, so the most
        # common kind of piece needs neither the pattern nor the mapping
        word, mark = (body[:-1], body[-1]) if body[-1:] in (".", ",") else (body, "")
        if word.isascii() and word.isalpha() and len(word) <= 200:
            if self.word_ends:
                ids = [t.id for t in self.model.tokenize(word.lower())]
            else:
                ids = [t.id for t in self.model.tokenize(self.space + word if spaced else word)]
            out = array(self.typecode, ids).tobytes()
            return out + self._mark(mark) if mark else out
        m = _SIMPLE.fullmatch(chunk)
        if not m or len(chunk) > 200:
            return self._full(chunk)
        space, word, mark = m.groups()
        if self.word_ends:
            out = self._model(unicodedata.normalize("NFC", word).lower())
        else:
            out = self._model(space + word)
        return out + self._mark(mark) if mark else out

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._model(mark)
        return self.marks[mark]

    def encode(self, text: str) -> bytes:
        if any(c in text for c in self.added_starts) and self.added.search(text):
            return self._full(text)
        if _runs_of_space(text):
            if _NOT_RUST_SPACE.search(text):
                return self._full(text)
            return b"".join(map(self.__getitem__, _RUNS.findall(text)))
        if self.word_ends:
            return b"".join(map(self.__getitem__, text.split(" ")))
        first, *rest = text.split(" ")
        head = self[first] if first else b""
        return head + b"".join(map(self.__getitem__, [" " + p for p in rest]))

    def trim(self) -> None:
        """Between batches: keep at most two generations of ``capacity`` pieces."""
        if len(self) > self.capacity:
            self.old = dict(self)
            self.clear()
            self.marks.clear()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, typecode: str = "I") -> Encoder:
    """One encoder per worker process, so its cache serves every task there."""
    if (path, typecode) not in _ENCODERS:
        _ENCODERS[path, typecode] = Encoder(path, typecode)
    return _ENCODERS[path, typecode]
