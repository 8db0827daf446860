"""Embedding near-duplicates by random-hyperplane signs.

Two vectors at an angle fall on the same side of a random hyperplane with
probability ``p = 1 - angle / pi``.  A table's code is the signs of ``bits``
hyperplanes, and vectors that share a code in some table are compared.  The
number of different vectors sets ``bits`` so that about ``crowd`` unlike vectors
share a code by chance, and ``tables`` follows from the target recall of a pair
exactly at the threshold: ``1 - (1 - p ** bits) ** tables >= recall`` (closer
pairs: more).  Both grow with the logarithm and a small power of the input, and
nothing is capped.

Equal vectors are collapsed first and counted with their number.  A crowded code
(more vectors than one block) is thinned by balls: its members are measured
against one pivot, the vector with the least hash, which a dense group shares
over its tables; those within half the threshold's angle are in its ball.  Two
vectors of one ball are within the whole angle, so they are linked for certain
and are counted by the size of the ball, without being compared.  What is left
of a code, the members outside its largest ball, meets all its members block
against block: a block pair is one bounded matrix product in double precision.
A pair counts only in the first table whose code it shares, so no pair is
emitted: a block gives its members' link counts and a spanning forest of its links.
Components are found by rounds over the edge table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.near_dup import components
from riskloom.llm.tables import written

KEY = ["dim", "t", "code"]


def table_shape(n: int, threshold: float, recall: float, crowd: int) -> tuple[int, int]:
    """(bits, tables) for ``n`` different vectors."""
    p = 1 - math.acos(threshold) / math.pi
    bits = min(31, max(1, math.ceil(math.log2(max(n, 2) / crowd))))  # a code is one int
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p**bits))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, v and uid, a 128-bit digest of the vector; uid is null where
    the vector is null, empty, zero or holds null or non-finite components."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = []
            for v in batch.column(1):
                x = v.values if v.is_valid else None
                if x is None or not len(x) or x.null_count:
                    uids.append(None)
                    continue
                x = x.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero
                good = np.isfinite(x).all() and x.any()
                uids.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(uids, pa.binary())], names=["vec_id", "v", "uid"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, v array<double>, uid binary")


def signed(held: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``held`` (uid, v, ...) with codes, one int a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                v = batch.column("v")
                dims = np.array([len(x) for x in v])
                codes = np.zeros((len(dims), tables), np.int32)
                for dim in set(dims.tolist()):
                    if dim not in planes:
                        planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
                    at = np.flatnonzero(dims == dim)
                    sides = unit(_matrix(v.take(pa.array(at)), dim)) @ planes[dim] > 0
                    codes[at] = (sides.reshape(len(at), tables, bits) * powers).sum(2)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "codes"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields)
    return held.mapInArrow(run, f"{fields}, codes array<int>")


def stars(edges: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The rows (uid, pivot) of ``edges`` whose vectors' cosine is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            dims = np.array([len(x) for x in batch.column("va")], int)
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                a, b = (unit(_matrix(batch.column(c).take(pa.array(at)), dim)) for c in ("va", "vb"))
                keep[at] = np.einsum("ij,ij->i", a, b) >= least
            yield batch.select(["uid", "pivot"]).filter(pa.array(keep))

    a, b = held.select("uid", F.col("v").alias("va")), held.select(F.col("uid").alias("pivot"), F.col("v").alias("vb"))
    return edges.join(a, "uid").join(b, "pivot").select("uid", "pivot", "va", "vb").mapInArrow(run, "uid binary, pivot binary")


def _forest(pairs: np.ndarray, left: list[bytes], right: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Links that join what the links before have not joined."""
    up: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while x in up:
            x = up[x]
        return x

    kept = []
    for i, j in pairs:
        a, b = find(left[i]), find(right[j])
        if a != b:
            up[a] = b
            kept.append((left[i], right[j]))
    return kept


def _side(rows: pa.Array) -> tuple:
    """uids, labels, copies, unit vectors, codes and who is outside the code's largest ball."""
    f = {name: rows.field(name) for name in ("uid", "label", "n", "v", "codes", "outside")}
    uids, dim = f["uid"].to_pylist(), len(f["v"][0])
    return (uids, np.array(f["label"].to_pylist(), dtype=object), f["n"].to_numpy(), unit(_matrix(f["v"], dim)),
            _matrix(f["codes"], len(f["codes"][0])), f["outside"].to_numpy(zero_copy_only=False))


def compared(blocks: DataFrame, threshold: float) -> DataFrame:
    """(uid, links, other) from block pairs (t, l, r; no l: r with itself):
    a uid's number of linked rows in this block pair, or a link of its spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, same = batch.column("t")[i].as_py(), not batch.column("l")[i].is_valid
                right = _side(batch.column("r")[i].values)
                left = right if same else _side(batch.column("l")[i].values)
                (lu, ll, ln, lv, lc, _), (ru, rl, rn, rv, rc, outside) = left, right
                hits = np.argwhere(lv @ rv.T >= threshold)
                a, b = hits[:, 0], hits[:, 1]
                fresh = (ll[a] != rl[b]) & ~(lc[a, :t] == rc[b, :t]).any(1)
                if same:
                    fresh &= a < b
                a, b = a[fresh], b[fresh]
                if not len(a):
                    continue
                count_l, count_r = np.zeros(len(lu), np.int64), np.zeros(len(ru), np.int64)
                np.add.at(count_l, a, rn[b])
                # a member outside the ball meets this one again from its own outer block
                once = np.ones(len(b), bool) if same else ~outside[b]
                np.add.at(count_r, b[once], ln[a[once]])
                out = [(u, int(c), None) for us, cs in ((lu, count_l), (ru, count_r)) for u, c in zip(us, cs) if c]
                out += [(u, 0, v) for u, v in _forest(np.stack([a, b], 1), lu, ru)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t_) for c, t_ in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))], names=["uid", "links", "other"])

    return blocks.select("t", "l", "r").mapInArrow(run, "uid binary, links long, other binary")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98, crowd: int = 32, block: int = 256, seed: int = 13) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    ``n_links`` counts the other rows found with a cosine of at least
    ``threshold`` (no lower one is ever linked), ``component_id`` is the least
    vec_id of the row's component, and ``kept`` says that the row's vec_id is
    that one.  A vector that is null, empty, zero or has null or non-finite
    components links with nothing, like vectors of different lengths.  Rows
    with equal vectors are linked.  Rows whose vec_id is null take part; a
    component of only such rows has a null component_id and its rows are kept.  Rows
    that repeat a vec_id each count.  An empty table gives no rows; extra
    columns are ignored.
    """
    rows = written(keyed(vectors), "keyed-vectors")
    ids = rows.select("vec_id", "uid")
    usable = rows.where("uid IS NOT NULL")
    n = usable.select("uid").distinct().count()
    held = usable.groupBy("uid").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))
    bits, tables = table_shape(n, threshold, recall, crowd)
    held = written(signed(held, bits, tables, seed), "signed-vectors")

    entries = held.select("uid", F.size("v").alias("dim"), F.posexplode("codes").alias("t", "code"))
    pivot = F.min(F.struct(F.xxhash64("uid").alias("h"), "uid"))["uid"]
    sizes = written(entries.groupBy(KEY).agg(F.count(F.lit(1)).alias("m"), pivot.alias("pivot")).where("m > 1"), "codes")
    met = entries.join(sizes, KEY)
    edges = met.where((F.col("m") > block) & (F.col("uid") != F.col("pivot"))).select("uid", "pivot").distinct()
    star = written(stars(edges, held, math.cos(math.acos(threshold) / 2) + 1e-12), "stars")
    label = F.min(F.struct(F.xxhash64("pivot").alias("h"), "pivot"))["pivot"]
    balls = star.groupBy("uid").agg(label.alias("ball"))
    labelled = written(held.join(balls, "uid", "left").withColumn("label", F.coalesce("ball", "uid")).drop("ball"), "labelled-vectors")

    row = F.struct("uid", "label", "n", "v", "codes", "outside")
    few = met.where(F.col("m") <= block).join(labelled, "uid").withColumn("outside", F.lit(True))
    few = few.groupBy(KEY).agg(F.collect_list(row).alias("r"))
    crowded = met.where(F.col("m") > block).select(*KEY, "uid", "m").join(labelled.select("uid", "label"), "uid")
    crowded = written(crowded, "crowded-codes")
    per = (crowded.groupBy(*KEY, "label").agg(F.count(F.lit(1)).alias("c")).groupBy(KEY)
           .agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1"))
    open_ = (crowded.drop("label").join(per, KEY).join(labelled, "uid")
             .withColumn("outside", F.col("label") != F.col("top.label")))

    def grouped(df: DataFrame, size: F.Column, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("uid"), F.ceil(size / block))
        return df.withColumn("part", part).groupBy(*KEY, "part").agg(F.collect_list(row).alias(name), F.max("m").alias("m"))

    # an outer block goes to each inner block's own key: the block pairs of one
    # code are dealt over many tasks
    inner = grouped(open_, F.col("m"), "r")
    outer = grouped(open_.where("outside"), F.col("m") - F.col("top.c"), "l")
    outer = outer.select(*KEY, "l", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / block) - 1)).alias("part"))
    many = outer.join(inner.drop("m"), [*KEY, "part"]).select("t", "l", "r")
    found = few.select("t", F.lit(None).cast(many.schema["l"].dataType).alias("l"), "r").unionByName(many)
    found = written(compared(found, threshold), "links")

    links = found.where("other IS NULL").groupBy("uid").agg(F.sum("links").alias("links"))
    joined = found.where("other IS NOT NULL").select(F.col("uid").alias("a"), F.col("other").alias("b"))
    roots = components(joined.unionByName(star.select(F.col("uid").alias("a"), F.col("pivot").alias("b"))), "vector-components")
    balls = labelled.groupBy("label").agg(F.sum("n").alias("in_ball"))
    per = (labelled.select("uid", "label", "first_id").join(balls, "label").join(links, "uid", "left").join(roots, "uid", "left")
           .select("uid", "first_id", F.coalesce("root", "uid").alias("root"), (F.col("in_ball") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least = per.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per = written(per.join(least, "root").select("uid", "n_links", "component_id"), "vector-links")
    alone = ids.where("uid IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = ids.where("uid IS NOT NULL").join(per, "uid").select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
