"""Exact global ranks, quintile scores and exact quantiles without a
single-partition window.

A plain ``Window.orderBy(...)`` with no partition moves every row into one
task.  Here the rows are range-partitioned on the full sort key (value plus a
unique tie-break, so one hot value is spread over many partitions), sorted
within each partition, and numbered by ``monotonically_increasing_id`` (whose
high bits are the partition index and low bits the position).  That numbering
is written once to the checkpoint folder (a parquet table), because range
bounds come from a sample and a recomputation must not move rows between
partitions.  Only the row count of each partition comes back to the driver
(one number per partition, bounded by the partition count, not by the data);
the running offsets form a small local table that is broadcast back.
"""

from __future__ import annotations

import math

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import exprs as X
from riskloom.session import materialize

_POS_BITS = 33  # monotonically_increasing_id: partition index << 33 | row position


def _numbered(df: DataFrame, order: list[Column], num_partitions: int | None) -> DataFrame:
    """Range-partition on ``order``, sort within partitions and number the
    rows (partition index, position); written once to the checkpoint folder."""
    # Without an explicit count the range exchange starts from
    # spark.sql.shuffle.partitions and AQE coalesces adjacent ranges to the
    # advisory size, so partition order stays the sort order at any scale.
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    mid = F.col("_rk_mid")
    numbered = (ranged
                .sortWithinPartitions(*order)
                .withColumn("_rk_mid", F.monotonically_increasing_id())
                .withColumn("_rk_part", F.shiftright(mid, _POS_BITS))
                .withColumn("_rk_pos", mid.bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
                .drop("_rk_mid"))
    # freeze the partition assignment: written once to the shared checkpoint folder
    return materialize(numbered, "rank")


def _counts(numbered: DataFrame, group: list[str]) -> list:
    """Row counts per (partition, *group): at most partitions x groups rows,
    independent of the data size."""
    return numbered.groupBy("_rk_part", *group).agg(F.count(F.lit(1)).alias("n")).collect()


def distributed_rank(df: DataFrame, order: list[Column], rank_col: str = "rank",
                     total_col: str | None = "n_rows", num_partitions: int | None = None) -> DataFrame:
    """Add the 1-based position of each row in the total order ``order``.

    ``order`` must be a total order (end it with a unique key).  Also adds the
    row count as ``total_col`` when given.  The per-partition offsets are a
    small local table (one row per partition), broadcast to the numbering.
    """
    numbered = _numbered(df, order, num_partitions)
    per_part = sorted((r["_rk_part"], r["n"]) for r in _counts(numbered, []))
    offsets, run = [], 0
    for part, n in per_part:
        offsets.append((int(part), run))
        run += n
    spark = df.sparkSession
    off_df = spark.createDataFrame(offsets or [(0, 0)], "_rk_part long, _rk_offset long")
    out = (numbered.join(F.broadcast(off_df), "_rk_part", "inner")
           .withColumn(rank_col, F.col("_rk_offset") + F.col("_rk_pos") + F.lit(1)))
    if total_col:
        out = out.withColumn(total_col, F.lit(run).cast("long"))
    return out.drop("_rk_part", "_rk_pos", "_rk_offset")


def quintile_score(df: DataFrame, key: str, value: str | Column, score_col: str,
                   descending: bool = False, q: int = 5, num_partitions: int | None = None) -> DataFrame:
    """qcut(value.rank(method='first'), q, labels=1..q) for every row of ``df``.

    Ties are broken by ``key`` (the reference breaks them by file order,
    which is not reproducible).  Only (key, value) is ranked; the scores are
    joined back on the key.
    """
    v = X.col(value)
    narrow = df.select(F.col(key), v.alias("_qv"))
    vord = F.col("_qv").desc_nulls_last() if descending else F.col("_qv").asc_nulls_first()
    ranked = distributed_rank(narrow, [vord, F.col(key).asc()], "_q_rank", "_q_n", num_partitions)
    scores = ranked.select(F.col(key), X.qcut_from_rank("_q_rank", "_q_n", q).alias(score_col))
    return df.join(scores, key, "inner")


def global_rank(df: DataFrame, key: str, value: str, descending: bool = False,
                num_partitions: int | None = None) -> DataFrame:
    """(key, value, rank, n_rows): rank(method='first') with ties on key."""
    vord = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    return distributed_rank(df.select(key, value), [vord, F.col(key).asc()], "rank", "n_rows",
                            num_partitions)


def value_quintile_label(value: str | Column, edges: str | Column, q: int = 5, prefix: str = "Q") -> Column:
    """Right-closed bins over inner edges: <= e1 -> Q1, ... > e_{q-1} -> Qq."""
    v = X.col(value).cast("double")
    e = X.col(edges)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for k in range(q - 1):
        out = out.when(v <= e.getItem(k), F.lit(f"{prefix}{k + 1}"))
    return out.otherwise(F.lit(f"{prefix}{q}"))


@dataclass
class RankLayout:
    """Where each rank lives: the written numbering plus per-partition and
    per-column row counts (all bounded by partitions x columns)."""
    numbered: DataFrame
    specs: list
    part_off: dict
    part_total: dict
    col_start: dict
    col_total: dict

    def locate(self, ci: int, rank: int) -> tuple[int, int]:
        """(partition, position) of the row with per-column ``rank``."""
        g = self.col_start[ci] + rank - 1
        for part in sorted(self.part_off):
            if self.part_off[part] <= g < self.part_off[part] + self.part_total[part]:
                return part, g - self.part_off[part]
        raise IndexError(rank)

    def values_at(self, wanted: list[tuple[int, int]]) -> dict:
        """{(ci, rank): value} for a few ranks, from one filtered scan of the
        numbering (partition / position filters reach the parquet reader)."""
        if not wanted:
            return {}
        loc = {self.locate(ci, r): (ci, r) for ci, r in wanted}
        cond = None
        for part, pos in loc:
            c = (F.col("_rk_part") == part) & (F.col("_rk_pos") == pos)
            cond = c if cond is None else (cond | c)
        got = {}
        for row in self.numbered.where(cond).select("_rk_part", "_rk_pos", "sv").collect():
            ci, r = loc[(row["_rk_part"], row["_rk_pos"])]
            got[(ci, r)] = -row["sv"] if self.specs[ci][2] else row["sv"]
        return got


def layout_of(ranked: DataFrame) -> RankLayout:
    """The layout attached by rank_columns to the DataFrame it returned."""
    lay = getattr(ranked, "rank_layout", None)
    if lay is None:
        raise ValueError("pass the DataFrame returned by rank_columns")
    return lay


def rank_columns(df: DataFrame, key: str, specs: list[tuple[str, str | Column, bool]],
                 num_partitions: int | None = None) -> DataFrame:
    """Rank several columns in ONE distributed sort.

    ``specs`` = [(name, value, descending)].  Rows are unpivoted to
    (ci, v, key) -- v negated for descending columns, so ties still break on
    ascending key -- and sorted on that total order, so each column's values
    form a contiguous rank range.  Counts per (partition, column) give each
    row's per-column rank through a small local offset table.  Nulls / NaN
    are left out.  Returns (key, ci, name, v, rank, n) with v in the
    original sign and n the column's non-null count.
    """
    items = []
    for i, (_, value, desc) in enumerate(specs):
        v = X.col(value).cast("double")
        items.append(F.struct(F.lit(i).alias("ci"), (-v if desc else v).alias("sv")))
    long = (df.select(F.col(key).alias("_k"), F.explode(F.array(*items)).alias("_s"))
            .select("_k", F.col("_s.ci").alias("ci"), F.col("_s.sv").alias("sv"))
            .where(F.col("sv").isNotNull() & ~F.isnan("sv")))
    numbered = _numbered(long, [F.col("ci").asc(), F.col("sv").asc(), F.col("_k").asc()], num_partitions)
    counts = sorted((int(r["_rk_part"]), int(r["ci"]), int(r["n"])) for r in _counts(numbered, ["ci"]))
    part_total: dict[int, int] = {}
    col_total: dict[int, int] = {}
    for part, ci, n in counts:
        part_total[part] = part_total.get(part, 0) + n
        col_total[ci] = col_total.get(ci, 0) + n
    part_off, run = {}, 0
    for part in sorted(part_total):
        part_off[part] = run
        run += part_total[part]
    col_start, run = {}, 0
    for ci in sorted(col_total):
        col_start[ci] = run
        run += col_total[ci]
    rows = [(part, ci, part_off[part] - col_start[ci], col_total[ci], specs[ci][0], bool(specs[ci][2]))
            for part, ci, _ in counts]
    spark = df.sparkSession
    offs = spark.createDataFrame(rows or [(0, 0, 0, 0, "", False)],
                                 "_rk_part long, ci int, _off long, n long, name string, desc boolean")
    j = numbered.join(F.broadcast(offs), ["_rk_part", "ci"], "inner")
    out = j.select(F.col("_k").alias(key), "ci", "name",
                   F.when(F.col("desc"), -F.col("sv")).otherwise(F.col("sv")).alias("v"),
                   (F.col("_off") + F.col("_rk_pos") + F.lit(1)).alias("rank"), "n")
    out.rank_layout = RankLayout(numbered, specs, part_off, part_total, col_start, col_total)
    return out


def quintiles_from_ranks(ranked_long: DataFrame, key: str, names: list[str], q: int = 5) -> DataFrame:
    """(key, <score columns>) from rank_columns output: one aggregate by key."""
    score = X.qcut_from_rank("rank", "n", q)
    return (ranked_long.where(F.col("name").isin(*names))
            .groupBy(key)
            .agg(*[F.max(F.when(F.col("name") == n, score)).alias(n) for n in names]))


def quantile_values(ranked_long: DataFrame, names: list[str], probs: list[float]) -> dict:
    """{(column, prob): value}; see quantiles_from_ranks."""
    return {(c, p): v for c, p, v in _quantile_rows(ranked_long, names, probs)}


def quantiles_from_ranks(ranked_long: DataFrame, names: list[str], probs: list[float]) -> DataFrame:
    return ranked_long.sparkSession.createDataFrame(_quantile_rows(ranked_long, names, probs),
                                                    "column string, prob double, value double")


def _quantile_rows(ranked_long: DataFrame, names: list[str], probs: list[float]) -> list:
    """(column, prob, value): exact linear-interpolation quantiles
    lo + (pos - floor(pos)) * (hi - lo), pos = prob * (n - 1), from the
    rows at the two bracketing ranks of each column (at most 2 x columns x
    probs rows are read back)."""
    lay = layout_of(ranked_long)
    idx = {spec[0]: i for i, spec in enumerate(lay.specs)}
    plan, wanted = [], []
    for name in names:
        ci = idx[name]
        n = lay.col_total.get(ci, 0)
        for p in probs:
            if n == 0:
                plan.append((name, p, None, None, 0.0))
                continue
            pos = float(p) * float(n - 1)
            lo, hi = math.floor(pos) + 1, math.ceil(pos) + 1
            if lay.specs[ci][2]:  # ranked descending: ascending position i is rank n + 1 - i
                lo, hi = n + 1 - lo, n + 1 - hi
            plan.append((name, p, (ci, lo), (ci, hi), pos - math.floor(pos)))
            wanted += [(ci, lo), (ci, hi)]
    got = lay.values_at(sorted(set(wanted)))
    rows = []
    for name, p, lo_k, hi_k, frac in plan:
        if lo_k is None:
            rows.append((name, float(p), None))
            continue
        lo, hi = got[lo_k], got[hi_k]
        rows.append((name, float(p), lo + frac * (hi - lo)))
    return rows
