"""Cost-balanced packing of documents into fixed-length training sequences.

Attention over a piece of n tokens costs ``linear * n + quadratic * n * n``
(a piece attends to itself only).  Documents are packed in windows of about
``window_tokens``: every full ``seq_len`` cut of a long document is a sequence
of its own; the remainders are taken in descending order and each goes to the
sequence with the lowest cost so far among those with room for it.  When none
has room, the cheapest sequence with any room takes a cut and the rest is
placed again.  A window opens exactly as much capacity as it has tokens: full
sequences, and for the odd rest sequences at the powers of two that sum to it,
which need no padding.

One narrow pass: no shuffle, so no key can be hot; a window and the worker's
piece cache bound the memory; a lost task is rerun by itself, and all pieces
and sequences of a document are made by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tokens import encoder

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")


def capacities(total: int, seq_len: int) -> np.ndarray:
    """Full sequences, then the powers of two of the rest, largest first."""
    full, rest = divmod(total, seq_len)
    return np.array([seq_len] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], dtype=np.int64)


def pack(lengths: list[int], seq_len: int = 1024, linear: float = 1.0, quadratic: float = 1e-3) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one window.

    Each token lies in exactly one piece; a sequence's pieces are gapless from
    0.  Documents of no tokens have no piece.
    """
    pieces, rests, n_seq = [], [], 0
    for doc, n in enumerate(lengths):
        for k in range(n // seq_len):
            pieces.append((doc, k * seq_len, seq_len, n_seq, 0))
            n_seq += 1
        if n % seq_len:
            rests.append((n % seq_len, doc, n - n % seq_len))
    room = capacities(sum(r for r, _, _ in rests), seq_len)
    size, cost = room.copy(), np.zeros(len(room))
    order = sorted(rests, key=lambda r: (-r[0], r[1]))
    for length, doc, start in order:
        while length:
            fits = np.where(room >= length, cost, np.inf)
            s = int(fits.argmin())
            if room[s] < length:
                s = int(np.where(room > 0, cost, np.inf).argmin())
            put = min(length, int(room[s]))
            pieces.append((doc, start, put, n_seq + s, int(size[s] - room[s])))
            room[s] -= put
            cost[s] += linear * put + quadratic * put * put
            length, start = length - put, start + put
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, seq_len: int = 1024,
                   window_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1e-3) -> DataFrame:
    """One row per piece of every document; see ``SCHEMA``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null
    or empty text is its end id alone; a null doc_id stays null; repeated rows
    are packed each; an empty table gives no rows.
    """
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seq = encoder(tokenizer), TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4").tobytes()
        window: list[tuple[int | None, bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq
            pieces = pack([len(ids) // 4 for _, ids in window], seq_len, linear, quadratic)
            filled: dict[int, int] = {}
            for _, _, n, s, _ in pieces:
                filled[s] = filled.get(s, 0) + n
            rows = [(window[d][0], start, n, zlib.crc32(memoryview(window[d][1])[4 * start:4 * (start + n)]),
                     len(window[d][1]) // 4, seq + s, off, filled[s]) for d, start, n, s, off in pieces]
            seq += len(filled)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(text or "") + end
                window.append((doc_id, ids))
                held += len(ids) // 4
                if held >= window_tokens:
                    yield flush()
                    window, held = [], 0
            enc.trim()
        if window:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
