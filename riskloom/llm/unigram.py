"""Unigram token counts of whole documents, shared along a trie of pre-tokens.

A pre-token is a white-space word behind the mark ``▁``.  Its best unigram
segmentation is a forward recurrence over its prefixes: the score of a prefix
is the best over the pieces that end there of (score of what precedes the
piece) + (log-probability of the piece).  Prefixes are the nodes of a trie, so
distinct pre-tokens are put in depth-first order (sorted), and each node is
scored once: only the path to the current word is held, a word starts at the
node where it leaves the one before.  The terminal's token count and score go
to a bounded store that serves every document of the Python worker.

Piece probabilities come from the public vocabulary's order by Zipf's law,
``-ln(rank + shift)``; nothing is trained.  A character without a piece falls
back to its UTF-8 bytes, each a token at the last rank's score less a penalty.

One narrow pass: no shuffle, no key, no collected group.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARK = "▁"
SCHEMA = "doc_id long, n_words long, n_tokens long, log_prob double"


class Vocabulary:
    """Pieces with log-probabilities, and the suffixes of pieces that bound
    how far back a search has to look."""

    def __init__(self, pieces: Iterable[str], shift: float = 2.7, byte_penalty: float = 2.0):
        pieces = list(pieces)
        total = sum(1 / (r + shift) for r in range(len(pieces)))
        self.score = {p: -math.log((r + shift) * total) for r, p in enumerate(pieces)}
        self.byte_score = -math.log((len(pieces) + shift) * total) - byte_penalty
        self.suffixes = {p[i:] for p in pieces for i in range(len(p))}

    @classmethod
    def from_sentencepiece(cls, path: str) -> "Vocabulary":
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        plain = (i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
        return cls(sp.id_to_piece(i) for i in plain)


class TrieCounter(dict):
    """pre-token -> (tokens, log-probability), at most two generations of
    ``capacity`` pre-tokens."""

    def __init__(self, vocabulary: Vocabulary, capacity: int = 400_000):
        super().__init__()
        self.vocabulary, self.capacity, self.old, self.nodes = vocabulary, capacity, {}, 0

    def add(self, words: Iterable[str]) -> None:
        """Score every new word; nodes shared by words of one call are scored once."""
        if len(self) > self.capacity:
            self.old = dict(self)
            self.clear()
        score, suffixes, byte_score = self.vocabulary.score, self.vocabulary.suffixes, self.vocabulary.byte_score
        new = []
        for w in words:
            if w not in self:
                if w in self.old:
                    self[w] = self.old[w]
                else:
                    new.append(w)
        path, best, count = "", [0.0], [0]  # of every prefix of the current path
        for w in sorted(new):
            full = MARK + w
            shared = len(commonprefix((path, full)))
            del best[shared + 1:], count[shared + 1:]
            for end in range(shared + 1, len(full) + 1):
                self.nodes += 1
                top, n, start = -math.inf, 0, end - 1
                while start >= 0:
                    piece = full[start:end]
                    if piece not in suffixes:
                        break
                    s = score.get(piece)
                    if s is not None:
                        s += best[start]
                        if s > top or s == top and count[start] + 1 < n:
                            top, n = s, count[start] + 1
                    start -= 1
                if full[end - 1] not in score:
                    size = len(full[end - 1].encode("utf-8", "surrogatepass"))
                    s = best[end - 1] + byte_score * size
                    if s > top:
                        top, n = s, count[end - 1] + size
                best.append(top)
                count.append(n)
            path = full
            self[w] = (count[-1], best[-1])


_COUNTERS: dict[str, TrieCounter] = {}


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, words, unigram tokens and log-probability of every whole text.

    A null or empty text, or one of white space, has 0 words and 0 tokens; null
    ids stay null, repeated rows are counted each, an empty table gives no rows;
    columns other than ``doc_id`` and ``text`` are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _COUNTERS:
            _COUNTERS[model_path] = TrieCounter(Vocabulary.from_sentencepiece(model_path))
        counter = _COUNTERS[model_path]
        for batch in batches:
            words = [WORD.findall(t) if t else [] for t in batch.column(1).to_pylist()]
            counter.add(set().union(*words) if words else ())
            found = [[counter[w] for w in doc] for doc in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(d) for d in found], pa.int64()),
                 pa.array([sum(n for n, _ in d) for d in found], pa.int64()),
                 pa.array([math.fsum(s for _, s in d) for d in found], pa.float64())],
                names=["doc_id", "n_words", "n_tokens", "log_prob"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
