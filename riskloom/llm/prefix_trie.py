"""Conversation prefix trie by the van Emde Boas recursion.

A turn sequence of any length is cut at half of a power of two: the upper half
is a trie of its own, the lower halves are a forest for every cut prefix.  Both
are cut again at half their depth, all tries and forests of one size at once,
so ``log2(depth)`` steps do what a walk by turns does in ``depth``.

Up (blocks): a turn has a name, a digest of role and text; the name of a
block of 2^j turns digests the names of its halves.  Down (cut prefixes): the
cut in the middle of a segment is named by the segment's own root and the block
above the cut.  After the last step every prefix has a name that depends on its
turns alone, so equal prefixes have equal names and nodes come from one
grouping.  Upward (totals): when two halves are put together again, the totals
of each lower forest are grafted onto its cut prefix and onto the prefix's
ancestors in the upper half, found along one member's row of prefixes.

A step over segments of 2^j turns holds one row a segment (a graft: one
a turn), keyed by conversation and segment.  So a conversation of any length
and a first turn that all share are spread over tasks; nothing is collected.
The one sequential thing is the contract's SHA-256 over a node's conv_ids,
which are streamed in order through one hash state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import written
from riskloom.operators.rank import distributed_rank

WORD = r"[^\x20\x09-\x0D]+"
ROOT = "unhex('00')"  # the name of the empty prefix; others have 16 bytes


def _digest(*parts) -> F.Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (0, 1, ... by turn, null first; equal turns by role, then
    text), sym (the turn's name) and words of its text; null role or text is
    empty, rows without a conv_id are in no conversation."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    named = rows.select("conv_id", "turn", "role", "text",
                        _digest(F.length("role").cast("string"), F.lit(":"), "role", F.col("text")).alias("sym"),
                        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    ranked = written(distributed_rank(named, order, "at", None).select("conv_id", "at", "sym", "words"), "ranked-turns")
    first = ranked.groupBy("conv_id").agg(F.min("at").alias("first"))
    return ranked.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "sym", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, pos, sym and words of every rebuilt conversation: the first
    ``h`` turns of conversation c - c % 20, then c's own after its first h."""
    convs = turns.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(20))).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h"))
    heads = turns.where("pos < 3").select(F.col("conv_id").alias("base"), "pos", "sym", "words")
    borrowed = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "sym", "words")
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    n_head = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    shift = convs.join(n_head, "base", "left").select("conv_id", (F.least("h", F.coalesce("n", F.lit(0))) - F.col("h")).alias("shift"))
    kept = turns.where(F.col("pos") >= own).join(shift, "conv_id").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "sym", "words")
    return borrowed.unionByName(kept)


def blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Names of all whole blocks of 2^j turns: conv_id, seg, name, for j under ``levels``."""
    out = [turns.select("conv_id", F.col("pos").alias("seg"), F.col("sym").alias("name"))]
    for j in range(1, levels):
        half = out[-1].select("conv_id", F.shiftright("seg", 1).alias("seg"), (F.col("seg") % 2).alias("side"), "name")
        both = half.groupBy("conv_id", "seg").agg(F.max(F.when(F.col("side") == 0, F.col("name"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("name"))).alias("r"))
        out.append(written(both.where("r IS NOT NULL").select("conv_id", "seg", _digest("l", "r").alias("name")), f"blocks-{j}"))
    return out


def prefixes(convs: DataFrame, block: list[DataFrame]) -> DataFrame:
    """conv_id, depth and name of every prefix, the empty one included."""
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("seg"), F.expr(ROOT).alias("name"))
    for j in reversed(range(len(block))):
        upper = block[j].where("seg % 2 = 0").select("conv_id", F.shiftright("seg", 1).alias("seg"), F.col("name").alias("above"))
        cut = F.struct((F.col("seg") * 2 + 1).alias("seg"), _digest("name", "above").alias("name"))
        both = F.array(F.struct((F.col("seg") * 2).alias("seg"), "name"), F.when(F.col("above").isNotNull(), cut))
        halves = roots.join(upper, ["conv_id", "seg"], "left").select("conv_id", F.explode(both).alias("s")).where("s IS NOT NULL")
        roots = written(halves.select("conv_id", "s.seg", "s.name"), f"prefixes-{j}")
    return roots.withColumnRenamed("seg", "depth")


def grafted(nodes: DataFrame, paths: DataFrame, levels: int, values: list[str]) -> DataFrame:
    """name and, for each of ``values``, its total over the node's subtree.

    ``nodes``: name, parent, conv_id (a member), depth and the values;
    ``paths``: conv_id, depth, name."""
    total = nodes.select("name", "parent", "conv_id", "depth", *values)
    for j in range(levels):
        # segment: (depth - 1) >> j; lower forests are the odd ones, their tops come first in them
        tops = total.where((F.col("depth") > 0) & ((F.col("depth") - 1) % (1 << (j + 1)) == (1 << j)))
        forest = tops.groupBy("parent").agg(F.min("conv_id").alias("conv_id"), F.min(F.shiftright(F.col("depth") - 1, j) - 1).alias("seg"),
                                            *[F.sum(v).alias(v) for v in values]).drop("parent")
        above = paths.where("depth > 0").select("conv_id", F.shiftright(F.col("depth") - 1, j).alias("seg"), "name").where("seg % 2 = 0")
        more = forest.join(above, ["conv_id", "seg"]).select("name", *values)
        # a node keeps its own columns; grafts bring none
        blank = [F.lit(None).cast(total.schema[c].dataType).alias(c) for c in ("parent", "conv_id", "depth")]
        total = written(total.unionByName(more.select("name", *blank, *values)).groupBy("name").agg(
            *[F.max(c).alias(c) for c in ("parent", "conv_id", "depth")], *[F.sum(v).alias(v) for v in values]), f"grafted-{j}")
    whole = total.where("depth = 1").agg(*[F.sum(v).alias(v) for v in values])
    root = total.where("depth = 0").select("name", *values).unionByName(whole.select(F.expr(ROOT).alias("name"), *values))
    return total.where("depth > 0").select("name", *values).unionByName(root.groupBy("name").agg(*[F.sum(v).alias(v) for v in values]))


def id_hashes(ends: DataFrame) -> DataFrame:
    """name and the SHA-256 of its conv_ids, numerically ascending and
    comma-joined: the ids stream through one hash state, none are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != name:
                    if name is not None:
                        done.append((name, state.hexdigest()))
                    name, state = node, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], names=["name", "sha"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["name", "sha"])

    spread = ends.select("name", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id")
    return spread.mapInArrow(run, "name binary, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``conversations`` has conv_id, turn, role and text.  Null role or text is
    empty; turns are ordered null first, equal ones by role, then text, and a
    repeated row is one more turn; rows without a conv_id are in no
    conversation; an empty table gives no nodes, not even a root.  Extra
    columns are ignored.
    """
    own = written(ordered_turns(conversations), "turns")
    turns = written(rebuilt(own), "rebuilt-turns")
    convs = own.select("conv_id").distinct()
    longest = turns.agg(F.max("pos").alias("p")).first()["p"]
    levels = 0 if longest is None else (longest + 1).bit_length()  # 2^levels > longest conversation
    paths = written(prefixes(convs, blocks(turns, levels) if levels else []), "paths")

    parents = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    words = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "words")
    rows = paths.join(parents, ["conv_id", "depth"], "left").join(words, ["conv_id", "depth"], "left")
    nodes = written(rows.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
                                             F.count(F.lit(1)).alias("n_convs"), F.coalesce(F.max("words"), F.lit(0)).alias("words")), "nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(kids, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = written(known.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
                    .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")), "node-values")
    totals = grafted(known, paths, levels, ["n_leaves", "saved_tokens"])

    last = paths.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    hashes = id_hashes(paths.join(last, ["conv_id", "depth"]))
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = (known.drop("n_leaves", "saved_tokens").join(totals, "name").join(above, "parent", "left").join(hashes, "name", "left"))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
