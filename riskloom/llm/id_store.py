"""Token-id shards with a minimal perfect hash index.

``write_ids`` sorts documents by ``doc_id`` across range partitions, encodes
them and writes shard files; ``read_ids`` reads them back through the index;
``Shard.get`` is the keyed access for a single document.

A shard file (little-endian) holds, one after the other:

======== =============================================================
header   magic ``RLIDS001``, then int64: id width in bytes, documents,
         ids, keys, null-key documents, hash levels
ids      the raw ids of all documents, in ascending doc_id order
offsets  int64 per document and one more: first id of each document
keys     int64 per distinct doc_id, ascending
levels   per level: int64 bits, then the bit set (8 bits a byte)
slots    per key, at its hash position: uint32 fingerprint,
         int64 first document, int64 documents with that key
======== =============================================================

The hash is a cascade of bit sets: at each level every key still unplaced is
hashed to a bit, keys alone on their bit stay, the others go on.  A key's slot
is the number of set bits before its own, so n keys fill n slots exactly; a
lookup is a few hashes and one fingerprint compare.  Null keys sort first and
have no slot; the header counts them.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.tables import written
from riskloom.llm.tokens import encoder
from riskloom.session import scratch_path

MAGIC = b"RLIDS001"
SLOT = np.dtype([("fingerprint", "<u4"), ("first", "<i8"), ("count", "<i8")])
MANIFEST = "shard long, path string, n_docs long, n_ids long"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 finaliser of key + seed * odd constant; a bijection per seed."""
    z = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct int64 keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # one boolean array per level
        self.before = []
        base = 0
        for bits in levels:
            self.before.append(base + np.concatenate([[0], np.cumsum(bits)[:-1]]) if len(bits) else np.zeros(0, np.int64))
            base += int(bits.sum())
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray, spare: float = 1.6) -> "PerfectHash":
        levels, left = [], keys
        while len(left):
            n_bits = max(8, -(-int(len(left) * spare) // 8) * 8)
            at = (_mix(left, len(levels) + 1) % np.uint64(n_bits)).astype(np.int64)
            alone = np.bincount(at, minlength=n_bits) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for a key that no level holds."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.levels, self.before)):
            at = (_mix(keys[open_], level + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = before[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0) >> np.uint64(32)).astype("<u4")


def shard_bytes(doc_ids: list[int | None], ids: list[bytes], width: int) -> Iterator[bytes]:
    """The parts of a shard file; ``doc_ids`` ascending, nulls first."""
    nulls = sum(d is None for d in doc_ids)
    own = np.array(doc_ids[nulls:], dtype=np.int64)
    keys, first, count = np.unique(own, return_index=True, return_counts=True)
    lengths = np.array([len(b) // width for b in ids], dtype=np.int64)
    index = PerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = index.slots(keys)
    slots["fingerprint"][at], slots["first"][at], slots["count"][at] = fingerprints(keys), first + nulls, count
    yield MAGIC + np.array([width, len(ids), lengths.sum(), len(keys), nulls, len(index.levels)], "<i8").tobytes()
    yield b"".join(ids)
    yield np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes()
    yield keys.astype("<i8").tobytes()
    for bits in index.levels:
        yield np.array([len(bits)], "<i8").tobytes() + np.packbits(bits, bitorder="little").tobytes()
    yield slots.tobytes()


class Shard:
    """Random access to one shard file; the index is read once, ids on demand."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{uri} is no id shard")
        self.width, self.n_docs, self.n_ids, n_keys, self.nulls, n_levels = np.frombuffer(self.file.read(48), "<i8").tolist()
        self.dtype = np.dtype(f"<u{self.width}")
        self.file.seek(56 + self.width * self.n_ids)
        self.offsets = np.frombuffer(self.file.read(8 * (self.n_docs + 1)), "<i8")
        self.keys = np.frombuffer(self.file.read(8 * n_keys), "<i8")
        levels = []
        for _ in range(n_levels):
            n_bits = int(np.frombuffer(self.file.read(8), "<i8")[0])
            levels.append(np.unpackbits(np.frombuffer(self.file.read(n_bits // 8), np.uint8), bitorder="little").astype(bool))
        self.index = PerfectHash(levels)
        self.slots = np.frombuffer(self.file.read(SLOT.itemsize * n_keys), SLOT)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key; a key that the
        shard lacks gets 0 documents (a chance of 2**-32 a foreign key aside)."""
        at = self.index.slots(keys)
        known = at >= 0
        slot = self.slots[np.where(known, at, 0)] if len(self.slots) else np.zeros(len(keys), SLOT)
        known = known & (slot["fingerprint"] == fingerprints(keys))
        return np.where(known, slot["first"], 0), np.where(known, slot["count"], 0)

    def ids(self, doc: int) -> np.ndarray:
        a, b = self.offsets[doc], self.offsets[doc + 1]
        self.file.seek(56 + self.width * int(a))
        return np.frombuffer(self.file.read(self.width * int(b - a)), self.dtype)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with that key (repeated rows: all of them)."""
        if doc_id is None:
            return [self.ids(d) for d in range(self.nulls)]
        first, count = self.find(np.array([doc_id], np.int64))
        return [self.ids(d) for d in range(int(first[0]), int(first[0] + count[0]))]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None,
              shard_ids: int = 8_000_000) -> DataFrame:
    """Write the shards of ``docs`` and return their manifest, in shard order
    by ``shard``: one row per file with ``start_id``, the ids before it.

    Null or empty texts hold the end id alone, null doc_ids come first,
    repeated rows are kept, an empty table writes no file; columns other than
    ``doc_id`` and ``text`` are ignored.  A file appears under its final name
    only when whole, so a rerun or speculative task does no harm.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "ids")
    uri = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:", "file://", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        probe = encoder(tokenizer, "H") if _fits16(tokenizer) else encoder(tokenizer, "I")
        width, part, k = probe.itemsize, TaskContext.get().partitionId(), 0
        end = array(probe.typecode, [end_id]).tobytes()
        keys: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal k
            name = f"{root}/shard-{part:07d}-{k:05d}.ids"
            tmp = f"{name}.{os.urandom(6).hex()}.tmp"
            with fs.open_output_stream(tmp) as out:
                for chunk in shard_bytes(keys, held, width):
                    out.write(chunk)
            fs.move(tmp, name)
            row = [part << 20 | k, f"{uri.rstrip('/')}/{os.path.basename(name)}", len(held), size // width]
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["shard", "path", "n_docs", "n_ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = probe.encode(text or "") + end
                keys.append(doc_id)
                held.append(ids)
                size += len(ids)
                if size >= shard_ids * width:
                    yield flush()
                    keys, held, size = [], [], 0
            probe.trim()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # the text's hash only splits repeated keys: one key may hold many rows
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), tie)
    manifest = written(ranged.mapInArrow(run, MANIFEST), "ids-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _fits16(tokenizer: str) -> bool:
    return encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16


def read_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    Each shard is read by one task: every key goes through the hash index to
    its documents, whose ids are checked off against the raw payload.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(uri)
                first, count = shard.find(shard.keys)
                own = [None] * shard.nulls + np.repeat(shard.keys, count).tolist()
                docs = np.concatenate([np.arange(shard.nulls), *(np.arange(f, f + c) for f, c in zip(first, count))]).astype(np.int64)
                crcs = [zlib.crc32(shard.ids(d).astype("<u4").tobytes()) for d in docs.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array(start + shard.offsets[docs]),
                     pa.array(shard.offsets[docs + 1] - shard.offsets[docs]), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a number of partitions, since the few bytes of the manifest would be merged into one task
    return (manifest.select("path", "start_id").repartition(max(1, manifest.count()), F.col("path"))
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))
