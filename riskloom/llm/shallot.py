"""Centroid clustering by Shallot search: exact k-means on integer vectors.

A vector keeps its nearest and its second-nearest centroid, an upper bound on
the distance to the first and a lower bound on the distance to every other.
After the centroids have moved, the bounds are widened by how far they moved.
A vector whose upper bound lies under its lower bound, or under half the gap
between its centroid and the next, cannot change and costs nothing more.  Any
other measures both remembered centroids, starts from the closer one, ``a``,
and walks a's neighbours by rising distance from a.  A neighbour j can be first
or second only if ``d(a, j) <= d(x, a) + s`` for the second-best distance s
found so far, so the ball shrinks while the walk goes on and the walk ends at
the first neighbour outside.

Bounds are floats rounded outwards; whatever survives them is compared by exact
64-bit squared distances, equal ones by the smaller number.  So the result is
that of plain k-means, integer for integer.

Each round is one pass over the written state (vectors with their bounds),
which writes the next one; the state before is removed then.  Centroids are
exact integer sums over the vectors that changed side: Spark adds them up, and
only k rows come back.  What is broadcast is k centroids and their k x k gaps.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import drop
from riskloom.session import scratch_path

OUT, IN = 1 + 1e-9, 1 - 1e-9  # outward rounding of float bounds
STATE = "vec_id long, v array<int>, near int, second int, upper double, lower double, was int, distance long"


def largest_component(dims: int) -> int:
    """Components of this size still give squared distances that fit a long."""
    return 2 ** int((62 - math.log2(dims)) / 2 - 1)


def integer_vectors(vectors: DataFrame, dims: int, scale: int = 1024) -> DataFrame:
    """vec_id and v, the integers floor(scale * x), of every row whose vector
    has ``dims`` components, none null or non-finite; components beyond
    ``largest_component`` count as that bound."""
    bound = float(largest_component(dims))

    def whole(x):
        return F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(bound)), F.lit(-bound))).cast("int")

    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return (rows.where((F.size("embedding") == dims) & F.coalesce(finite, F.lit(False)))
            .select("vec_id", F.transform("embedding", whole).alias("v")))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """The centroids of one round, every one's neighbours by rising distance,
    and how far each has moved since the round before."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None):
        self.at = np.array(rows, np.int64)
        k = len(rows)
        gaps = np.array([squared(self.at, np.broadcast_to(c, self.at.shape)) for c in self.at])
        first = gaps - 2 * np.eye(k, dtype=np.int64) * (gaps.max() + 1)  # itself before a copy of it
        self.order = np.argsort(first, axis=1, kind="stable")
        self.gap = np.sqrt(gaps.astype(np.float64)) * IN
        self.half = self.gap[np.arange(k), self.order[:, 1]] / 2 if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(squared(self.at, np.array(before, np.int64)).astype(np.float64)) * OUT
        self.moved = moved
        rank = np.argsort(-moved, kind="stable")
        self.others_moved = np.full(k, moved[rank[0]])  # the most that any other centroid moved
        self.others_moved[rank[0]] = moved[rank[1]] if k > 1 else 0.0


def search(x: np.ndarray, a: np.ndarray, b: np.ndarray, c: Centroids) -> tuple[np.ndarray, ...]:
    """Nearest, second-nearest and their squared distances, from two remembered centroids."""
    k = len(c.at)
    da = squared(x, c.at[a])
    if k == 1:
        return a, b, da, np.full(len(a), np.iinfo(np.int64).max)
    db = squared(x, c.at[b])
    swap = (db < da) | ((db == da) & (b < a))
    a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
    start, known, radius = a.copy(), b.copy(), np.sqrt(da.astype(np.float64))
    live = np.arange(len(a))
    for rank in range(1, k):
        j = c.order[start[live], rank]
        inside = c.gap[start[live], j] <= (radius[live] + np.sqrt(db[live].astype(np.float64))) * OUT
        live, j = live[inside], j[inside]
        if not len(live):
            break
        new = j != known[live]
        i, j = live[new], j[new]
        d = squared(x[i], c.at[j])
        best = (d < da[i]) | ((d == da[i]) & (j < a[i]))
        up = i[best]
        b[up], db[up], a[up], da[up] = a[up], da[up], j[best], d[best]
        next_ = ~best & ((d < db[i]) | ((d == db[i]) & (j < b[i])))
        b[i[next_]], db[i[next_]] = j[next_], d[next_]
    return a, b, da, db


def assign(x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, ...]:
    """The bounds and centroids of the vectors ``x`` after a move of the centroids."""
    near, second = near.copy(), second.copy()
    upper, lower = (upper + c.moved[near]) * OUT, (lower - c.others_moved[near]) * IN
    safe = np.maximum(lower, c.half[near])
    open_ = np.flatnonzero(~(upper < safe))
    if len(open_):  # the true distance often closes the gap between the bounds
        upper[open_] = np.sqrt(squared(x[open_], c.at[near[open_]]).astype(np.float64)) * OUT
        open_ = open_[~(upper[open_] < safe[open_])]
    if len(open_):
        a, b, da, db = search(x[open_], near[open_], second[open_], c)
        near[open_], second[open_] = a, b
        upper[open_] = np.sqrt(da.astype(np.float64)) * OUT
        lower[open_] = np.sqrt(db.astype(np.float64)) * IN
    return near, second, upper, lower


def _pass(state: DataFrame, c: Centroids, dims: int, first: bool, last: bool) -> DataFrame:
    k = len(c.at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, dims).astype(np.int64)
            if first:  # nothing is known: measure two centroids and search from the closer one
                was = np.full(n, -1, np.int32)
                held = (np.zeros(n, np.int64), np.full(n, min(1, k - 1)), np.full(n, np.inf), np.full(n, -np.inf))
            else:
                was, second, upper, lower = (batch.column(f).to_numpy(zero_copy_only=False) for f in ("near", "second", "upper", "lower"))
                held = (was.astype(np.int64), second.astype(np.int64), upper, lower)
            near, second, upper, lower = assign(x, *held, c)
            distance = pa.array(squared(x, c.at[near])) if last else pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(second.astype(np.int32)),
                 pa.array(upper), pa.array(lower), pa.array(was.astype(np.int32)), distance],
                names=["vec_id", "v", "near", "second", "upper", "lower", "was", "distance"])

    return state.mapInArrow(run, STATE)


def _changes(state: DataFrame, dims: int) -> list:
    """(c, n, i, s): by how many vectors, and by what in component i, each
    cluster changes; added up in each task first, k x dims rows in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims).astype(np.int64)
            x = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)  # the count goes first
            for sign, side in ((1, "near"), (-1, "was")):
                at = batch.column(side).to_numpy(zero_copy_only=False)
                for c in set(at[at >= 0].tolist()):
                    total[c] = total.get(c, 0) + sign * x[at == c].sum(0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tolist() for s in total.values()], pa.list_(pa.int64()))], names=["c", "s"])

    moved = state.where("near <> was").select("v", "near", "was")
    parts = moved.mapInArrow(run, "c int, s array<long>").select("c", F.posexplode("s").alias("i", "s"))
    return parts.groupBy("c", "i").agg(F.sum("s").alias("s")).collect()


def clusters(vectors: DataFrame, k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256
    of every row of ``vectors`` (vec_id, embedding) that ``integer_vectors`` keeps.

    Centroids start as the k kept vectors with the smallest hex sha256 of
    ``seed:vec_id``; rows with a null vec_id come after all others, rows with
    one vec_id by their components.  Fewer than k kept rows give as many
    clusters; none give an empty result.  Repeated rows each count.  An inertia
    beyond a long is null.  Extra columns are ignored.
    """
    spark = vectors.sparkSession
    state = integer_vectors(vectors, dims, scale)
    path = scratch_path(spark, "shallot")
    state.write.parquet(path)
    state = spark.read.schema("vec_id long, v array<int>").parquet(path)
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = state.select("v", by_hash.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    if not seeds:
        nothing = state.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in _RESULT))
        return nothing
    rows = [list(r["v"]) for r in seeds]
    sums, before = [[0] * (dims + 1) for _ in rows], None  # count and sums of each cluster
    for turn in range(rounds + 1):
        c = Centroids(rows, before)
        new_path = scratch_path(spark, "shallot")
        _pass(state, c, dims, first=turn == 0, last=turn == rounds).write.parquet(new_path)
        state = spark.read.schema(STATE).parquet(new_path)
        drop(spark, path)
        path = new_path
        if turn == rounds:
            break
        for r in _changes(state, dims):
            sums[r["c"]][r["i"]] += r["s"]
        before = rows
        rows = [[s // n for s in total] if n else old for (n, *total), old in zip(sums, rows)]
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = {r["near"]: r["d"] for r in state.groupBy("near").agg(wide.alias("d")).collect()}  # k rows
    total = _long(sum(per.values()))
    shas = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in rows]
    table = spark.createDataFrame([(i, _long(per.get(i, 0)), total, sha) for i, sha in enumerate(shas)],
                                  "near int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = state.select("vec_id", "near", "distance").join(F.broadcast(table), "near")  # k rows
    return found.select("vec_id", F.col("near").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


_RESULT = [("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")]


def _long(x) -> int | None:
    return int(x) if x < 2**63 else None
