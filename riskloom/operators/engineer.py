"""Engineered features, RFM quintile scores, label encoding and the model
feature projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import schemas as S
from riskloom.functions import exprs as X
from riskloom.operators.rank import distributed_rank
from riskloom.operators.selection import quintile_scores


def rfm_scores(df: DataFrame, key: str = "user_id", with_recency: bool = True) -> DataFrame:
    """Frequency (total_orders) and monetary (total_revenue, capped upstream)
    quintiles 1..5, recency quintile with the most recent order = 5, and
    their sum rfm_total -- all from the same counting passes over ``df`` (a
    written table), without a sort or a join."""
    specs = [("rfm_frequency_score", "total_orders", False), ("rfm_monetary_score", "total_revenue", False)]
    if with_recency:
        specs.append(("rfm_recency_score", "days_since_last_order", True))
    out = quintile_scores(df, key, specs)
    if with_recency:
        out = out.withColumn("rfm_total", F.col("rfm_frequency_score") + F.col("rfm_monetary_score")
                             + F.col("rfm_recency_score"))
    return out


def engineered_features(df: DataFrame) -> DataFrame:
    """Smoothed ratios and 0/1 flags (null compares as false -> 0)."""
    return df.select(
        "*",
        X.smoothed_ratio("total_events", "total_orders").alias("events_per_order"),
        F.coalesce((F.col("return_rate") > S.HIGH_RETURN_RATE).cast("int"), F.lit(0)).alias("high_return_flag"),
        F.coalesce((F.col("total_orders") == 1).cast("int"), F.lit(0)).alias("one_time_buyer"),
        X.smoothed_ratio("cancelled_orders", "total_orders").alias("cancel_rate"),
        X.smoothed_ratio("total_revenue", "customer_tenure_days").alias("revenue_per_day"),
    )


def model_features(df: DataFrame) -> DataFrame:
    """Projection by exclusion: drop the leakage and meta registries."""
    return df.select(S.model_feature_columns(df.columns))


def string_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    cols = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in cols if isinstance(types[c], T.StringType)]


def label_encode(df: DataFrame, columns: list[str] | None = None, suffix: str = "") -> DataFrame:
    """LabelEncoder on astype(str): null becomes the category 'nan'; codes are
    0..k-1 in sorted order of the distinct strings.

    Codes come from the distributed rank of each column's distinct values, at
    any size of the domain, and are joined back by the planner's choice.  Null
    rows, which may be most of a column, need no join: their one code is a
    literal, and their join keys are spread over values that no code has.
    """
    cols = columns if columns is not None else string_columns(df)
    out = df
    for c in cols:
        domain = df.select(F.coalesce(F.col(c), F.lit("nan")).alias("_lv")).distinct()
        codes = distributed_rank(domain, [F.col("_lv").asc()], "_r", None).select("_lv", (F.col("_r") - 1).cast("int").alias("_code"))
        nan = codes.where(F.col("_lv") == "nan").first()
        spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*out.columns), F.lit(4096)).cast("string"))
        code = F.when(F.col("_null"), F.lit(nan["_code"] if nan else None).cast("int")).otherwise(F.col("_code"))
        out = (out.withColumn("_null", F.col(c).isNull()).withColumn("_lv", F.coalesce(F.col(c), spread))
               .join(codes, "_lv", "left").withColumn(f"{c}{suffix}_code", code).drop("_lv", "_null", "_code"))
        if not suffix:
            out = out.drop(c).withColumnRenamed(f"{c}_code", c)
    return out.select(df.columns + ([f"{c}{suffix}_code" for c in cols] if suffix else []))


def adaptive_projection(df: DataFrame, wanted: list[tuple[str, object]]) -> DataFrame:
    """Keep wanted columns that exist, fill the others with a default."""
    from riskloom.sources.tables import optional_columns
    return optional_columns(df, wanted)
