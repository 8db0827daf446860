"""Exploratory aggregates behind the reference's charts: churn rates by
dimension, class comparisons, histograms, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import schemas as S
from riskloom.functions import exprs as X
from riskloom.operators import selection
from riskloom.operators.rank import value_quintile_label


def churn_rate(features: DataFrame, buyer: F.Column | None = None) -> DataFrame:
    """Share churned (mean of the label) and US share for all customers and,
    given the buyer predicate, count and churn share of buyers: one aggregate,
    one pass over the feature table."""
    aggs = [F.count(F.lit(1)).alias("customers"),
            F.avg("churned").alias("churn_rate"),
            F.count_if(F.col("is_us_customer")).alias("us_customers"),
            F.avg(F.col("is_us_customer").cast("int")).alias("us_share")]
    if buyer is not None:
        aggs += [F.count_if(buyer).alias("buyers"), F.avg(F.when(buyer, F.col("churned"))).alias("buyer_churn_rate")]
    return features.agg(*aggs)


def churn_by(df: DataFrame, key: str | F.Column, name: str | None = None) -> DataFrame:
    """Mean churn per group, null keys dropped (pandas groupby)."""
    k = X.col(key)
    alias = name or (key if isinstance(key, str) else "group")
    return (df.where(k.isNotNull()).groupBy(k.alias(alias))
            .agg(F.avg("churned").alias("churn_rate"), F.count(F.lit(1)).alias("customers")))


def churn_by_domain(df: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """reindex(domain): one row per listed value in order, missing -> null,
    unlisted values dropped."""
    spark = df.sparkSession
    dom = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], f"position int, {key} string")
    rates = churn_by(df, key)
    return (F.broadcast(dom).join(rates, key, "left")
            .select("position", key, "churn_rate", F.coalesce("customers", F.lit(0)).alias("customers")))


def churn_by_state(df: DataFrame, min_count: int = S.STATE_MIN_CUSTOMERS, top: int = S.STATE_TOP_N) -> DataFrame:
    """US buyers: mean churn and count per state, count >= min, top by mean."""
    return (df.where(F.col("is_us_customer") & F.col("state").isNotNull())
            .groupBy("state").agg(F.avg("churned").alias("churn_rate"), F.count(F.lit(1)).alias("customers"))
            .where(F.col("customers") >= min_count)
            .orderBy(F.col("churn_rate").desc(), F.col("state"))
            .limit(top))


def churn_by_rpd(df: DataFrame) -> DataFrame:
    """Churn by revenue-per-day quintile Q1..Q5 (value cut, right-closed).
    The four inner edges are exact quantiles, found by counting passes; they
    are four scalars, inlined as literals."""
    probs = [0.2, 0.4, 0.6, 0.8]
    got = selection.quantiles(df, ["revenue_per_day"], probs)  # q-1 scalars
    edges = F.array(*[F.lit(got.get(("revenue_per_day", p))).cast("double") for p in probs])
    labeled = df.withColumn("rev_per_day_bucket", value_quintile_label("revenue_per_day", edges))
    return churn_by(labeled, "rev_per_day_bucket")


def one_time_analysis(df: DataFrame) -> DataFrame:
    one = F.col("total_orders") == 1
    a = df.agg(F.count(F.lit(1)).alias("buyers"),
               F.count_if(one).alias("one_time_buyers"),
               F.count_if(one & (F.col("churned") == 1)).alias("one_time_churned"))
    return a.select("*",
                    F.try_divide(F.col("one_time_buyers").cast("double"), F.col("buyers")).alias("one_time_share"),
                    F.try_divide(F.col("one_time_churned").cast("double"), F.col("one_time_buyers")).alias("one_time_churn_share"))


def class_comparison(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean of each metric per class, rounded to 3, then the retained/churned
    ratio of the rounded means rounded to 2 (null when churned mean is 0)."""
    cols = [c for c in (columns or S.CLASS_COMPARE_COLUMNS) if c in df.columns]
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs.append(F.avg(F.when(F.col("churned") == 0, v)).alias(f"{c}__0"))
        aggs.append(F.avg(F.when(F.col("churned") == 1, v)).alias(f"{c}__1"))
    wide = df.agg(*aggs)
    stack = F.expr("stack({n}, {a}) as (metric, retained_avg, churned_avg)".format(
        n=len(cols), a=", ".join(f"'{c}', `{c}__0`, `{c}__1`" for c in cols)))
    long = wide.select(stack).select(
        "metric", X.round_double("retained_avg", 3).alias("retained_avg"),
        X.round_double("churned_avg", 3).alias("churned_avg"))
    return long.withColumn("ratio", X.round_double(F.try_divide(F.col("retained_avg"), F.col("churned_avg")), 2))


def histogram(df: DataFrame, value: str, clip: float, bins: int, by: str = "churned") -> DataFrame:
    """numpy-style histogram of min(value, clip) per class, with the edges of
    every bin: equal-width bins between the class's own min and max, last bin
    closed.  Bounds are one row per class, joined as the planner sees fit; the
    binning is one expression."""
    v = F.least(F.col(value).cast("double"), F.lit(float(clip)))
    x = df.where(F.col(value).isNotNull()).select(F.col(by), v.alias("x"))
    bounds = x.groupBy(by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = ~(F.col("hi") > F.col("lo"))
    bounds = bounds.select(by, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                           F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    raw = F.floor((F.col("x") - F.col("lo")) * F.lit(bins) / (F.col("hi") - F.col("lo")))
    b = F.least(raw, F.lit(bins - 1)).cast("int")
    counted = x.join(bounds, by).groupBy(by, b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    edge = lambda n: F.col("lo") + (F.col("hi") - F.col("lo")) * n / F.lit(bins)
    return counted.select(by, "bin", "count", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"))


def clipped_means(df: DataFrame) -> DataFrame:
    return df.groupBy("churned").agg(
        X.round_double(F.avg(F.least(F.col("orders_per_month"), F.lit(S.HIST_ORDERS_MONTH_CLIP))), 6).alias("orders_per_month_clipped"),
        X.round_double(F.avg(F.least(F.col("total_revenue").cast("double"), F.lit(S.HIST_REVENUE_CLIP))), 6).alias("total_revenue_clipped"))


def corr_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson r for every pair of columns (a before b), one aggregate pass;
    constants give null instead of an ANSI division error."""
    cols = [c for c in (columns or S.CORR_MATRIX_COLUMNS) if c in df.columns]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = [X.pearson(a, b).alias(f"{a}__{b}") for a, b in pairs]
    wide = df.agg(*aggs)
    stack = F.expr("stack({n}, {a}) as (col_a, col_b, corr)".format(
        n=len(pairs), a=", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)))
    return wide.select(stack).select("col_a", "col_b", X.round_double("corr", 6).alias("corr"))


def label_correlations(encoded: DataFrame, columns: list[str], label: str = "churned") -> DataFrame:
    """|r(feature, label)| for each feature, one pass."""
    wide = encoded.agg(*[F.abs(X.pearson(c, label)).alias(c) for c in columns])
    stack = F.expr("stack({n}, {a}) as (feature, abs_corr)".format(
        n=len(columns), a=", ".join(f"'{c}', `{c}`" for c in columns)))
    return wide.select(stack)


def leak_detector(encoded: DataFrame, columns: list[str], label: str = "churned",
                  threshold: float = S.LEAK_CORRELATION_THRESHOLD, top: int = S.LEAK_TOP_N) -> DataFrame:
    """Top correlates of the label with a flag above the threshold (reports
    only; drops nothing)."""
    c = label_correlations(encoded, columns, label)
    return (c.select("feature", X.round_double("abs_corr", 6).alias("abs_corr"),
                     (F.col("abs_corr") > threshold).alias("flagged"))
            .orderBy(F.col("abs_corr").desc_nulls_last(), F.col("feature"))
            .limit(top))
