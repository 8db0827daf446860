"""Boosted trees by second-order gain, grown level by level with grouped sums.

Features are cut into at most 254 bins (bin 0: missing), once, by one
aggregate of quantile sketches.  A level of a tree is one Spark job: every task
adds the gradients and hessians of its rows up by (open node, feature, bin) and
Spark sums these tables; what comes back is nodes x features x bins rows,
whatever the input.  The driver turns the sums into gains

    G_L^2 / (H_L + l2) + G_R^2 / (H_R + l2) - G^2 / (H + l2)

for every cut and for both directions of missing values, and splits every node
at the best one.  A leaf's weight is ``-rate * G / (H + l2)``.

Gradients are summed as 64-bit fixed-point integers, so the sums, and with them
the trees, do not depend on how rows are dealt over tasks or on retries.  Rows
and columns of a tree are sampled by hash.

The binned training table is written once, a row per block of up to
``ROWS_A_TASK`` training rows, and held as an RDD of arrays, so a level's job has
no plan to make and no rows to convert.  Margins lie in the blocks: the first job
of a tree adds the tree before to them.  Every ``refresh`` trees the blocks are
checkpointed, which bounds what a lost executor costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import schemas as S
from riskloom.session import materialize

BINS = 255          # bin numbers 1..255, 0 is missing: one byte
FIXED = 1 << 24     # gradients and hessians are summed in units of 2^-24
LEAST_GAIN = 1e-6
ROWS_A_TASK = 50_000
LEAST_ROWS = 10_000  # fewer rows would cost less than their task
FEW_TASKS = 32
PARTS = ("key", "y", "w", "b", "margin")
STATE = ", ".join(f"{c} binary" for c in PARTS)
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # bins: feature x row


@dataclass
class BoostSettings:
    rounds: int = 300
    depth: int = 5
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 1.0
    min_child: float = 1.0
    seed: int = S.RANDOM_SEED
    refresh: int = 10


@dataclass
class Tree:
    """Nodes by number, the root first; feature -1 marks a leaf."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])          # bins up to this one go left
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.missing_left[node], self.gain[node] = feature, cut, missing_left, gain
        self.left[node], self.right[node] = first, first + 1
        for v in values:
            for name, blank in (("feature", -1), ("cut", 0), ("missing_left", False), ("left", 0), ("right", 0), ("value", v), ("gain", 0.0)):
                getattr(self, name).append(blank)
        return first, first + 1

    def node_of(self, b: np.ndarray) -> np.ndarray:
        """The leaf of every row of binned features."""
        f, cut, ml, left, right = (np.array(x) for x in (self.feature, self.cut, self.missing_left, self.left, self.right))
        node = np.zeros(len(b), np.int64)
        inner = np.flatnonzero(f[node] >= 0)
        while len(inner):
            at = node[inner]
            bins = b[inner, f[at]]
            go_left = np.where(bins == 0, ml[at], bins <= cut[at])
            node[inner] = np.where(go_left, left[at], right[at])
            inner = inner[f[node[inner]] >= 0]
        return node

    def values_of(self, b: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.node_of(b)]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform values in [0, 1) by hash."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sampled_rows(keys: np.ndarray, tree: int, s: BoostSettings) -> np.ndarray:
    return _mixed(keys, 2 * (tree + 1) + (s.seed << 20)) < s.row_share


def sampled_columns(n: int, tree: int, s: BoostSettings) -> list[int]:
    """The features of one tree: the share with the least hashes, at least one."""
    order = np.argsort(_mixed(np.arange(n), 2 * (tree + 1) + 1 + (s.seed << 20)), kind="stable")
    return sorted(order[: max(1, int(s.column_share * n))].tolist())


def gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted log loss, in fixed point."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - y) * w * FIXED), np.rint(np.maximum(p * (1 - p), 1e-16) * w * FIXED)


def best_split(g: np.ndarray, h: np.ndarray, s: BoostSettings) -> tuple | None:
    """(gain, feature place, cut, missing_left, GL, HL) of the best split of one
    node from its sums (feature x bin); None when none gains.  Equal gains: the
    first feature, lowest cut, missing to the right."""
    g, h = g / FIXED, h / FIXED
    total_g, total_h = g[0].sum(), h[0].sum()
    left_g, left_h = np.cumsum(g[:, 1:-1], 1), np.cumsum(h[:, 1:-1], 1)  # a cut after each bin but the last
    left_g = np.stack([left_g, left_g + g[:, :1]], 2)
    left_h = np.stack([left_h, left_h + h[:, :1]], 2)
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = left_g**2 / (left_h + s.l2) + right_g**2 / (right_h + s.l2) - total_g**2 / (total_h + s.l2)
    gain = np.where((left_h >= s.min_child) & (right_h >= s.min_child), gain, -np.inf)
    at = int(gain.argmax())
    f, cut, ml = np.unravel_index(at, gain.shape)
    if not gain[f, cut, ml] > LEAST_GAIN:
        return None
    return float(gain[f, cut, ml]), int(f), int(cut) + 1, bool(ml), float(left_g[f, cut, ml]), float(left_h[f, cut, ml]), float(total_g), float(total_h)


def grow_level(tree: Tree, open_: list[int], sums: np.ndarray, columns: list[int], s: BoostSettings) -> list[int]:
    """Split every open node that gains; the new open nodes, those with hessian
    enough for two children.  ``sums``: open node x feature x bin x (gradient,
    hessian)."""
    children: list[int] = []
    for node, gh in zip(open_, sums):
        found = best_split(gh[..., 0], gh[..., 1], s)
        if found is None:
            continue
        gain, f, cut, ml, gl, hl, g, h = found
        weights = (-s.rate * gl / (hl + s.l2), -s.rate * (g - gl) / (h - hl + s.l2))
        pair = tree.split(node, columns[f], cut, ml, gain, weights)
        children += [c for c, weight in zip(pair, (hl, h - hl)) if weight >= 2 * s.min_child]
    return children


def bin_edges(frame: DataFrame, n_features: int, feature: str = "x") -> list[list[float]]:
    """Up to 254 ascending cuts per feature, one aggregate over all features."""
    probs = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    def value(i):
        v = F.col(feature)[i]
        return F.when(~F.isnan(v), v)
    row = frame.agg(*[F.percentile_approx(value(i), probs, 10_000).alias(f"f{i}") for i in range(n_features)]).first()
    return [sorted(set(row[f"f{i}"] or [])) for i in range(n_features)]


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin 1 holds values up to the first cut, and so on; 0 holds NaN."""
    out = np.zeros(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(x[:, i]), 0, 1 + np.searchsorted(np.array(e), x[:, i], side="left"))
    return out


def matrix(column: pa.Array, n_features: int) -> np.ndarray:
    """An array column as a matrix; missing elements are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), n_features)


@dataclass
class BoostedTrees:
    edges: list[list[float]]
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = binned(x, self.edges), np.zeros(len(x))
        for t in self.trees:
            out = out + t.values_of(b)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))

    def importances(self) -> list[float]:
        """Average gain of a feature's splits, as shares of one."""
        gain, n = np.zeros(len(self.edges)), np.zeros(len(self.edges))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gain[f] += g
                    n[f] += 1
        mean = np.divide(gain, n, out=np.zeros_like(gain), where=n > 0)
        return (mean / mean.sum()).tolist() if mean.sum() else mean.tolist()


def _after(block: Block, tree: Tree) -> Block:
    """The block with the tree added to its margins."""
    return *block[:4], block[4] + tree.values_of(block[3].T)


def block_sums(blocks: Iterator[Block], tree: Tree, number: int, open_: list[int], columns: list[int], bins: int,
               s: BoostSettings) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian sums of one task's rows by (open node, feature, bin)
    in one line: the places that hold any, and their sums (2 x places)."""
    width = len(columns) * (bins + 1)
    total = np.zeros((2, len(open_), len(columns), bins + 1), np.int64)
    place = np.full(len(tree.feature), -1)
    place[open_] = np.arange(len(open_))
    for key, y, w, b, margin in blocks:
        at = place[tree.node_of(b.T)]
        rows = np.flatnonzero((at >= 0) & sampled_rows(key, number, s))
        sides = gradients(margin[rows], y[rows], w[rows])
        slot = at[rows] * (bins + 1)
        for c, column in enumerate(columns):
            own = slot + b[column, rows]
            for side, v in enumerate(sides):
                total[side, :, c] += np.bincount(own, v, len(open_) * (bins + 1)).astype(np.int64).reshape(len(open_), bins + 1)
    flat = total.reshape(2, len(open_) * width)
    used = np.flatnonzero(flat.any(0))
    return used, flat[:, used]


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of sums as one."""
    used, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    out = np.zeros((2, len(used)), np.int64)
    out[:, at[:len(a[0])]] = a[1]
    out[:, at[len(a[0]):]] += b[1]
    return used, out


def level_sums(state: RDD, tasks: int, tree: Tree, number: int, open_: list[int], columns: list[int], s: BoostSettings) -> np.ndarray:
    """Gradient and hessian sums (open node x feature x bin x 2) of one level: one
    job.  The tables of up to ``FEW_TASKS`` tasks are added here; those of more
    tasks are added by Spark first, so few tables come back."""
    bins = BINS
    found = state.mapPartitions(lambda blocks: [block_sums(blocks, tree, number, open_, columns, bins, s)])
    tables = [found.treeReduce(_added)] if tasks > FEW_TASKS else found.collect()
    sums = np.zeros((len(open_) * len(columns) * (bins + 1), 2), np.int64)
    for used, values in tables:
        sums[used] += values.T
    return sums.reshape(len(open_), len(columns), bins + 1, 2)


def _block_row(parts: list[np.ndarray]) -> pa.RecordBatch:
    """One row of the written table."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], names=list(PARTS))


def _blocks(rows: DataFrame, n_features: int) -> RDD:
    """The written blocks as arrays."""
    def block(r) -> Block:
        key, y, w, margin = (np.frombuffer(r[c], np.int64 if c == "key" else np.float64) for c in ("key", "y", "w", "margin"))
        return key, y, w, np.frombuffer(r["b"], np.uint8).reshape(n_features, len(key)), margin

    return rows.rdd.map(block)


def _binned_rows(train: DataFrame, edges: list[list[float]], most: int) -> DataFrame:
    """Blocks of up to ``most`` rows: key, y, w, bins (feature by feature) and a margin of 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                if rows + part.num_rows > most:
                    yield _block_row([np.concatenate(p, -1) for p in zip(*held)])
                    held, rows = [], 0
                b = binned(matrix(part.column("x"), len(edges)), edges)
                held.append([*(part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "y", "w")), b.T, np.zeros(len(b))])
                rows += part.num_rows
        if held:
            yield _block_row([np.concatenate(p, -1) for p in zip(*held)])

    return train.select("key", "y", "w", "x").mapInArrow(run, STATE)


def fit(train: DataFrame, n_features: int, s: BoostSettings | None = None) -> BoostedTrees:
    """Boosted trees for ``train``: key (long, for the row sample), y (0 or 1),
    w (weight) and x (array of ``n_features`` doubles; null or NaN is missing)."""
    s = s or BoostSettings()
    edges = bin_edges(train, n_features)
    sc = train.sparkSession.sparkContext
    # a job a level: tasks of few rows would cost more than the rows, and full waves end together
    rows, cores = train.count(), sc.defaultParallelism
    tasks = max(1, min(rows // min(LEAST_ROWS, ROWS_A_TASK), -(-rows // (ROWS_A_TASK * cores)) * cores))
    table = materialize(_binned_rows(train.repartition(tasks), edges, ROWS_A_TASK), "boost")
    state = _blocks(table, n_features).persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[Tree] = []
    for number in range(s.rounds):
        columns = sampled_columns(n_features, number, s)
        tree, open_, before = Tree(), [0], None
        if trees:
            before, last = state, trees[-1]
            state = before.map(lambda block, last=last: _after(block, last)).persist(StorageLevel.MEMORY_AND_DISK)
            if number % s.refresh == 0:
                state.checkpoint()
        for _ in range(s.depth):
            sums = level_sums(state, tasks, tree, number, open_, columns, s)
            if before is not None:
                before.unpersist()  # the first level's job has made the margins
                before = None
            open_ = grow_level(tree, open_, sums, columns, s)
            if not open_:
                break
        trees.append(tree)
    state.unpersist()
    return BoostedTrees(edges, trees)
