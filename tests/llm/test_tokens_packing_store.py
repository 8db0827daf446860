"""Encoding, packing and the id store against the plain library."""

import zlib
from functools import lru_cache

import numpy as np
import pytest

from riskloom.llm import id_store, packing, queries
from riskloom.llm.tokens import Encoder

BYTE, WORD = (queries.tokenizer_path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
TEXTS = ["", " ", "a", "Hello, world.", "don't  stop\n\n now", " lead", "trail ", "a\tb\u00a0c", "x \ny", "x\n y  ",
         "Größe Éa ñ, ß. ĳ ŉ İstanbul", "\x1d a", "# a! b*** $5,000.5 'tis", "e\u0301 E\u0301", "日本 語, です", "a." * 300,
         "<|endoftext|> x", "word " * 400, "A,B .C ,D", "\u3000x \u2028 y", "line one.\nLine two, it's.\n"]
ROWS = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "Hello, world.", "x"), (None, None, None), (None, "null id", "y"), (99, None, "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, length string")  # length clashes with an output column


@lru_cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(path, text, end):
    t = library(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_encoding_is_the_library_s(path):
    enc = Encoder(path, capacity=3)
    for _ in range(2):
        for text in TEXTS:
            got = np.frombuffer(enc.encode(text), "<u4").tolist()
            assert got == plain(path, text, 0)[:-1], repr(text)
            enc.trim()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_random_texts_and_spelled_out_tokens_are_the_library_s(path):
    import random
    rng = random.Random(8)
    alphabet = ["a", "b", "é", "ß", "Ω", "İ", "ŉ", "e\u0301", "中", "😀", ".", ",", "'", "'s", "1", "23", "-", "\n", "\t", "\u00a0", "\x1f", "\x85", "|", "<", "##", "A"]
    spelled = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<unk>", "<|end", "[UNK]"]
    texts = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 7))) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts += [t + rng.choice(["", " ", "\n"]) + s + rng.choice(["", " x", "."]) for t in texts[:60] for s in spelled]
    enc = Encoder(path)
    for text in texts:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain(path, text, 0)[:-1], repr(text)


def test_encoding_of_the_test_table(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for path in (BYTE, WORD):
        enc = Encoder(path)
        assert all(np.frombuffer(enc.encode(t), "<u4").tolist() == plain(path, t, 0)[:-1] for t in texts)


@pytest.mark.parametrize("lengths", [[], [0], [1], [1024], [1025], [700, 700, 700], [5000, 3, 3, 3, 1023, 512], [1] * 3000,
                                     list(range(1, 1500, 7))])
def test_pack_covers_every_token_without_padding(lengths):
    pieces = packing.pack(lengths)
    per_doc, per_seq = {}, {}
    for d, start, n, s, off in pieces:
        assert n > 0
        per_doc.setdefault(d, []).append((start, n))
        per_seq.setdefault(s, []).append((off, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, size in sorted(per_doc.get(d, [])):
            assert start == at
            at += size
        assert at == n
    for parts in per_seq.values():
        at = 0
        for off, size in sorted(parts):
            assert off == at
            at += size
        assert at <= 1024 and at & (at - 1) == 0


def test_pack_balances_cost():
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 600, 400)]
    cost = {}
    for _, _, n, s, _ in packing.pack(lengths):
        cost[s] = cost.get(s, 0) + n + 1e-3 * n * n
    full = sorted(c for c in cost.values() if c > 1024)
    assert full[-1] < 1.35 * full[0]


def test_pack_documents(spark, docs):
    got = packing.pack_documents(docs, BYTE).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for doc_id, text, _ in ROWS:
        ids = plain(BYTE, text, 0)
        rows = by_doc[doc_id, len(ids)]
        for r in rows:
            assert any(zlib.crc32(np.array(plain(BYTE, t, 0)[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
                       for d, t, _ in ROWS if d == doc_id)
    assert sum(r.length for r in got) == sum(len(plain(BYTE, t, 0)) for _, t, _ in ROWS)
    seen = {}
    for r in got:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 5000):
        keys = np.unique(rng.integers(-2**62, 2**62, n))
        index = id_store.PerfectHash.build(keys)
        assert sorted(index.slots(keys).tolist()) == list(range(len(keys))) and index.size == len(keys)


def test_id_store(spark, docs):
    manifest = id_store.write_ids(docs.repartition(3), WORD, end_id=2, shard_ids=200)
    got = id_store.read_ids(spark, manifest).orderBy("start").collect()
    want = sorted(((d, plain(WORD, t, 2)) for d, t, _ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    at, left = 0, {}
    for d, ids in want:
        left.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        left[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(left.values())
    shards = [id_store.Shard(r.path) for r in manifest.collect()]
    assert len(shards) >= 3
    assert [x.tolist() for s in shards for x in s.get(13)] == [plain(WORD, TEXTS[13], 2)]
    assert sum(len(s.get(3)) for s in shards) == 2 and sum(len(s.get(None)) for s in shards) == 2
    assert not any(s.get(12345) for s in shards)
    assert id_store.read_ids(spark, id_store.write_ids(docs.limit(0), WORD, 2)).count() == 0
