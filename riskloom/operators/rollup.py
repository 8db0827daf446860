"""Roll-ups kept current from a merge's changes: every group holds exact counts
and sums (decimals, no averages), a replaced row is taken out and its successor
added, and the summary is read from the held sums.  A merge costs its changed
rows and the groups, not the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import exprs as X
from riskloom.operators.analyst import SEGMENT_KEYS

MEASURES = ["churn_probability", "total_revenue", "total_orders", "orders_per_month", "return_rate"]


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(38,6)")


def signed_sums(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """``rows`` (with a sign of 1 or -1) added up per group: rows, and for every
    measure its sum and its number of values."""
    sign = F.col("sign")
    aggs = [F.sum(sign.cast("long")).alias("rows")]
    for m in measures:
        aggs += [F.coalesce(F.sum(_wide(m) * sign.cast("decimal(1,0)")), F.lit(0)).cast("decimal(38,6)").alias(f"sum_{m}"),
                 F.sum(F.when(F.col(m).isNotNull(), sign).otherwise(0).cast("long")).alias(f"n_{m}")]
    return rows.groupBy(*keys).agg(*aggs)


def apply_changes(held: DataFrame | None, changes: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """The held sums after ``changes``; groups without rows left go."""
    delta = signed_sums(changes, keys, measures)
    both = delta if held is None else held.unionByName(delta)
    names = [f"{p}_{m}" for m in measures for p in ("sum", "n")]
    return both.groupBy(*keys).agg(*[F.sum(c).cast(delta.schema[c].dataType).alias(c) for c in ["rows", *names]]).where("rows > 0")


def segment_rows(view: DataFrame) -> DataFrame:
    """Rows of the served view with the flag of one-time buyers as a number."""
    return view.withColumn("one_time", F.when(F.col("one_time_buyer"), 1).otherwise(0))


SEGMENT_MEASURES = [*MEASURES, "one_time"]


def segment_changes(held: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Held segment sums after a merge's ``changes`` (rows of the view with a sign)."""
    return apply_changes(held, segment_rows(changes), SEGMENT_KEYS, SEGMENT_MEASURES)


def _mean(measure: str, dtype: T.DataType, digits: int) -> Column:
    """The mean as the full roll-up gives it: of decimals with four more places,
    of other numbers in double, rounded."""
    total, n = F.col(f"sum_{measure}"), F.col(f"n_{measure}")
    if isinstance(dtype, T.DecimalType):
        places = min(dtype.precision + 4, 38), min(dtype.scale + 4, 38)
        mean = F.try_divide(total.cast(f"decimal(28,{dtype.scale})"), n.cast("decimal(18,0)")).cast(T.DecimalType(*places))
    else:
        mean = F.try_divide(total.cast("double"), n)
    return X.round_double(mean, digits)


def segment_summary(held: DataFrame, view_schema: T.StructType) -> DataFrame:
    """``analyst.segment_summary`` read from the held sums."""
    t = {f.name: f.dataType for f in view_schema.fields}
    return held.select(
        *SEGMENT_KEYS, F.col("rows").alias("user_count"), _mean("churn_probability", t["churn_probability"], 3).alias("avg_churn_prob"),
        F.when(F.col("n_total_revenue") > 0, X.round_double("sum_total_revenue", 2)).alias("total_revenue_at_risk"),
        _mean("total_orders", t["total_orders"], 1).alias("avg_orders"), _mean("orders_per_month", t["orders_per_month"], 2).alias("avg_orders_per_month"),
        _mean("return_rate", t["return_rate"], 3).alias("avg_return_rate"), F.col("sum_one_time").cast("long").alias("one_time_buyers"))


def tier_summary(held: DataFrame, view_schema: T.StructType) -> DataFrame:
    """``analyst.tier_summary`` read from the held segment sums."""
    t = {f.name: f.dataType for f in view_schema.fields}
    names = ["rows", "sum_churn_probability", "n_churn_probability", "sum_total_revenue", "n_total_revenue"]
    per = held.groupBy("risk_tier").agg(*[F.sum(c).alias(c) for c in names])
    revenue = F.when(F.col("n_total_revenue") > 0, X.round_double("sum_total_revenue", 2))
    return (per.select("risk_tier", F.col("rows").alias("users"), _mean("churn_probability", t["churn_probability"], 3).alias("avg_score"),
                       revenue.alias("revenue_at_risk"))
            .orderBy(F.col("avg_score").desc(), F.col("risk_tier")))
