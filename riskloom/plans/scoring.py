"""End-to-end plans: raw tables -> prepared buyer features -> scored rows.

The cleaned buyer table is checkpointed once (one row per customer, far
smaller than the fact tables) so the quantile and rank jobs that follow read
it instead of re-running the fact-table aggregation each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schemas as S
from riskloom.functions import exprs as X
from riskloom.operators import clean, engineer, features
from riskloom.session import ensure_checkpoint_dir
from riskloom.session import materialize as _materialize
from riskloom.sources.tables import RawTables


def tables(spark: SparkSession, sf_dir: str) -> RawTables:
    ensure_checkpoint_dir(spark)
    return RawTables(spark, sf_dir)


def cleaned_buyers(t: RawTables, materialize: bool = True) -> DataFrame:
    """feature_base -> buyers -> numeric coercion (before capping); written
    once to the checkpoint folder so the rank jobs below read one compact
    table instead of re-running the fact-table aggregation."""
    df = clean.clean_numeric(features.buyers(features.feature_base(t)))
    if materialize:
        df = _materialize(df, "buyers")
    return df


def prepared_buyers(t: RawTables, with_recency: bool = True) -> DataFrame:
    """Cleaned, winsorised, scored and engineered buyer features.

    The caps and the quintile places are found by counting passes over the
    written buyer table; what follows is one projection of it with literals, so
    nothing is sorted, ranked or joined.
    """
    capped = clean.winsorize(cleaned_buyers(t))
    return engineer.engineered_features(engineer.rfm_scores(capped, with_recency=with_recency))


def base_probability_column() -> F.Column:
    return X.base_score("orders_per_month", "one_time_buyer", "rfm_monetary_score", "return_rate")


def with_base_score(df: DataFrame) -> DataFrame:
    """Deterministic churn probability (no trained model), risk tier on the
    unrounded value, probability rounded to 4 places after."""
    p = base_probability_column()
    return (df.withColumn("_p", p)
            .withColumn("risk_tier", X.risk_tier("_p"))
            .withColumn("churn_probability", F.round("_p", 4))
            .drop("_p"))


def predictions_from(df: DataFrame, top_features: list[str] | None = None) -> DataFrame:
    """The 18-column scored-row projection (winsorised revenue, int flags)."""
    tops = top_features or S.BASE_TOP_FEATURES
    return df.select(
        F.col("user_id").cast("long"),
        F.col("churn_probability").cast("double"),
        "risk_tier",
        F.col("churned").cast("int").alias("actual_churned"),
        F.col("total_orders").cast("long"),
        F.col("total_revenue").cast("double"),
        F.col("orders_per_month").cast("double"),
        F.col("customer_tenure_days").cast("double"),
        F.col("return_rate").cast("double"),
        F.col("one_time_buyer").cast("int"),
        F.col("rfm_frequency_score").cast("int"),
        F.col("rfm_monetary_score").cast("int"),
        "age_bucket", "gender", "traffic_source",
        F.lit(tops[0]).alias("top_feature_1"),
        F.lit(tops[1]).alias("top_feature_2"),
        F.lit(tops[2]).alias("top_feature_3"),
    )


def predictions(t: RawTables) -> DataFrame:
    return predictions_from(with_base_score(prepared_buyers(t, with_recency=False)))
