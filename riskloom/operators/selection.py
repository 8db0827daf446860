"""Exact order statistics without a sort: selection by refining histograms.

The value at a rank is found by counting.  A round splits every interval that
still holds a wanted rank into buckets and counts the rows of each, together
with its least and greatest value, in one aggregate for all columns and ranks;
only the bucket that holds the rank goes on, shrunk to its least and greatest
value, until these are equal.  Rows are never shuffled, only partial counts are:
intervals x buckets rows a round, whatever the input.  A round divides an
interval of evenly spread values by the number of buckets, so a few rounds do.

A place in the order (value, key) is found by two selections: the value at the
rank, then the key among the rows with that value.  Rows are then compared with
the place itself, so quintiles and splits need no rank column and no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import exprs as X


@dataclass
class Spread:
    """Rows that have a value, the least and the greatest one."""
    n: int
    lo: float | int | None
    hi: float | int | None


@dataclass
class Found:
    """The value at a rank, with the rows before it and those equal to it."""
    value: float | int
    before: int
    equal: int


def number(v: str | Column) -> Column:
    """A numeric column as double; NaN counts as missing."""
    d = X.col(v).cast("double")
    return F.when(~F.isnan(d), d + F.lit(0.0))  # one zero


def spreads(df: DataFrame, values: list[Column]) -> list[Spread]:
    """Count, least and greatest of every column, in one aggregate."""
    if not values:
        return []
    row = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(values) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    return [Spread(row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i in range(len(values))]


def _bucket(v: Column, lo, hi, buckets: int) -> Column:
    """The bucket of a value in [lo, hi]: monotone in v, 0 for lo and more for hi."""
    if isinstance(lo, int):
        width = (hi - lo) // buckets + 1
        return F.floor((v.cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("long")
    width = hi / 2 / buckets - lo / 2 / buckets  # halves: hi - lo may overflow
    if not width > 0 or not math.isfinite(1 / width):
        return F.when(v > F.lit(lo), F.lit(1)).otherwise(F.lit(0)).cast("long")
    return F.floor((v / 2 - F.lit(lo / 2)) / F.lit(width)).cast("long")


def at_ranks(df: DataFrame, values: list[Column], ranks: list[list[int]], known: list[Spread] | None = None,
             buckets: int = 512, few: int = 20_000) -> list[dict[int, Found]]:
    """For every column the value at each of its 1-based ``ranks`` (nulls are
    left out; a rank beyond the count is not answered).  ``values`` are all
    doubles without NaN or all longs.  When the intervals hold no more than
    ``few`` rows in all, their different values are counted, which ends the search."""
    known = known or spreads(df, values)
    out: list[dict[int, Found]] = [{} for _ in values]
    # (column, lo, hi, rows before, ranks wanted in it, rows)
    todo = []
    for c, (spread, wanted) in enumerate(zip(known, ranks)):
        inside = sorted({r for r in wanted if 1 <= r <= spread.n})
        if inside and spread.lo == spread.hi:
            out[c] = {r: Found(spread.lo, 0, spread.n) for r in inside}
        elif inside:
            todo.append((c, spread.lo, spread.hi, 0, inside, spread.n))
    while todo:
        inside = [values[c].between(F.lit(lo), F.lit(hi)) for c, lo, hi, *_ in todo]
        last = sum(rows for *_, rows in todo) <= few
        cells = [F.when(hit, F.struct(F.lit(i).alias("i"), (values[c] if last else _bucket(values[c], lo, hi, buckets)).alias("b"), values[c].alias("v")))
                 for i, (hit, (c, lo, hi, *_)) in enumerate(zip(inside, todo))]
        counted = (df.where(reduce(or_, inside)).select(F.explode(F.array(*cells)).alias("s")).where("s IS NOT NULL")
                   .groupBy("s.i", "s.b").agg(F.count(F.lit(1)).alias("n"), F.min("s.v").alias("lo"), F.max("s.v").alias("hi")).collect())
        per: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: r["lo"]):
            per.setdefault(r["i"], []).append(r)
        following = []
        for i, (c, _, _, before, wanted, _) in enumerate(todo):
            for r in per.get(i, []):
                inside = [k for k in wanted if before < k <= before + r["n"]]
                if inside and r["lo"] == r["hi"]:
                    out[c] |= {k: Found(r["lo"], before, r["n"]) for k in inside}
                elif inside:
                    following.append((c, r["lo"], r["hi"], before, inside, r["n"]))
                before += r["n"]
        todo = following
    return out


def quantiles(df: DataFrame, columns: list[str], probs: list[float], known: list[Spread] | None = None) -> dict[tuple[str, float], float | None]:
    """{(column, prob): exact linear-interpolation quantile}; None without values."""
    values = [number(c) for c in columns]
    known = known or spreads(df, values)
    places = [{p: float(p) * float(max(s.n - 1, 0)) for p in probs} for s in known]
    wanted = [[math.floor(x) + 1 for x in own.values()] + [math.ceil(x) + 1 for x in own.values()] for own in places]
    found = at_ranks(df, values, wanted, known)
    out: dict[tuple[str, float], float | None] = {}
    for c, own, got, s in zip(columns, places, found, known):
        for p, x in own.items():
            if not s.n:
                out[c, float(p)] = None
                continue
            lo, hi = got[math.floor(x) + 1].value, got[math.ceil(x) + 1].value
            out[c, float(p)] = lo + (x - math.floor(x)) * (hi - lo)
    return out


def places(df: DataFrame, specs: list[tuple[Column, list[int]]], key: str, known: list[Spread] | None = None) -> list[dict[int, tuple]]:
    """For every (value, ranks) the (value, key) of the row at each rank in the
    order (value, key).  ``key`` is an integer column; values are doubles.
    ``known``: the spreads of the values and, last, of the key."""
    values, k = [v for v, _ in specs], F.col(key).cast("long")
    *known, keys = known or spreads(df, [*values, k])
    first = at_ranks(df, values, [r for _, r in specs], known)
    ties, owner = [], []
    out: list[dict[int, tuple]] = [{} for _ in specs]
    for i, found in enumerate(first):
        for rank, f in found.items():
            # among the rows with this value the key at the rest of the rank
            ties.append((F.when(values[i] == F.lit(f.value), k), rank - f.before, f.equal))
            owner.append((i, rank, f.value))
    got = at_ranks(df, [t for t, *_ in ties], [[r] for _, r, _ in ties], [Spread(n, keys.lo, keys.hi) for *_, n in ties])
    for (i, rank, value), answer, (_, r, _) in zip(owner, got, ties):
        out[i][rank] = (value, answer[r].value)
    return out


def quintile_scores(df: DataFrame, key: str, specs: list[tuple[str, str | Column, bool]], q: int = 5) -> DataFrame:
    """``df`` with a score column per (name, value, descending): the quintile
    1..q of the row's rank by (value, ``key``), as ``exprs.qcut_from_rank`` gives
    it; null or NaN values get none.

    The score changes after the ranks ``1 + floor(j (n - 1) / q)``, so the rows at
    these ranks are found and every row is compared with them."""
    values = [-number(v) if desc else number(v) for _, v, desc in specs]
    known = spreads(df, [*values, F.col(key).cast("long")])
    ranks = [[1 + j * (s.n - 1) // q for j in range(1, q)] if s.n > 1 else [] for s in known[:-1]]
    found = places(df, list(zip(values, ranks)), key, known)
    out = df
    for (name, _, _), v, s, own, edges in zip(specs, values, known, ranks, found):
        score = F.lit(1)
        for r in own:
            value, last = edges[r]
            after = (v > F.lit(value)) | ((v == F.lit(value)) & (F.col(key) > F.lit(last)))
            score = score + after.cast("int")
        out = out.withColumn(name, F.when(v.isNotNull(), score.cast("int")))
    return out
