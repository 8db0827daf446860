"""Served tables and their maintenance: typed customers / risk_scores
tables, the joined customer_risk view, keyed merge (upsert), backfill and
constraint checks.  Set logic is joins (anti / semi / full outer); no key
set ever passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import schemas as S


class DuplicateKeyError(ValueError):
    pass


def _dec(c: str, p: int, s: int) -> F.Column:
    return F.round(F.col(c).cast("double"), s).cast(T.DecimalType(p, s))


def _exact_avg_order_value() -> F.Column:
    """revenue / orders (0 -> 1) rounded half-up to cents in DECIMAL
    arithmetic: rounding the binary double would turn x.xx5 into x.xx4."""
    orders_nz = F.when(F.col("total_orders") == 0, F.lit(1)).otherwise(F.col("total_orders"))
    rev = F.col("total_revenue").cast(T.DecimalType(18, 2))
    return F.round(rev / orders_nz.cast(T.DecimalType(20, 0)), 2).cast(T.DecimalType(10, 2))


def customers_table(scored: DataFrame, with_created_at: bool = True) -> DataFrame:
    """customers payload: derived average order value (orders 0 -> 1),
    NUMERIC precisions, truncating int casts, boolean flag."""
    cols = [
        F.col("user_id").cast("long"),
        "age_bucket", "gender", "traffic_source",
        F.col("total_orders").cast("int").alias("total_orders"),
        _dec("total_revenue", 10, 2).alias("total_revenue"),
        _exact_avg_order_value().alias("avg_order_value"),
        _dec("orders_per_month", 8, 3).alias("orders_per_month"),
        F.col("customer_tenure_days").cast("int").alias("customer_tenure_days"),
        _dec("return_rate", 5, 3).alias("return_rate"),
        F.col("one_time_buyer").cast("boolean").alias("one_time_buyer"),
        F.col("rfm_frequency_score").cast("smallint").alias("rfm_frequency_score"),
        F.col("rfm_monetary_score").cast("smallint").alias("rfm_monetary_score"),
    ]
    if with_created_at:
        cols.append(F.current_timestamp().alias("created_at"))
    return scored.select(cols)


def risk_scores_table(predictions: DataFrame, with_defaults: bool = True) -> DataFrame:
    """risk_scores payload (+ surrogate id and scored_at default).  The id is
    monotonically_increasing_id: unique, gaps allowed, no global sort."""
    cols = [
        F.col("user_id").cast("long"),
        F.round(F.col("churn_probability").cast("double"), 4).cast(T.DecimalType(6, 4)).alias("churn_probability"),
        "risk_tier",
        F.col("actual_churned").cast("boolean").alias("actual_churned"),
        "top_feature_1", "top_feature_2", "top_feature_3",
    ]
    out = predictions.select(cols)
    if with_defaults:
        out = out.select(F.monotonically_increasing_id().alias("id"), "*",
                         F.current_timestamp().alias("scored_at"))
    return out


def customer_risk(customers: DataFrame, scores: DataFrame) -> DataFrame:
    """Inner join of the two tables on user_id (the served view)."""
    c = customers.select("user_id", "age_bucket", "gender", "traffic_source", "total_orders",
                         "total_revenue", "avg_order_value", "orders_per_month",
                         "customer_tenure_days", "return_rate", "one_time_buyer",
                         "rfm_frequency_score", "rfm_monetary_score")
    r_cols = ["user_id", "churn_probability", "risk_tier", "actual_churned",
              "top_feature_1", "top_feature_2", "top_feature_3"]
    if "scored_at" in scores.columns:
        r_cols.append("scored_at")
    return c.join(scores.select(r_cols), "user_id", "inner")


def duplicate_keys(df: DataFrame, key: str = "user_id") -> DataFrame:
    """Keys that occur more than once (primary / unique key check)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def assert_unique(df: DataFrame, key: str = "user_id") -> None:
    """Raise when ``key`` is not unique (one distributed aggregate, stops at
    the first offending key)."""
    if duplicate_keys(df, key).limit(1).count() > 0:
        raise DuplicateKeyError(f"duplicate values of {key} in merge input")


def merge(existing: DataFrame, incoming: DataFrame, key: str, payload: list[str],
          defaults: dict[str, F.Column] | None = None, check_unique: bool = True) -> DataFrame:
    """Keyed upsert: rows of ``incoming`` replace the payload columns of
    matching keys (a null in incoming is written, not skipped), other columns
    keep the existing value; unmatched incoming rows are inserted with
    ``defaults`` for non-payload columns; unmatched existing rows are kept.

    One full outer join shuffled on the key.  Incoming keys must be unique.
    """
    if check_unique:
        assert_unique(incoming, key)
    defaults = defaults or {}
    new_cols = [c for c in payload if c != key]
    old = existing.alias("old")
    new = incoming.select([key] + new_cols).alias("new")
    j = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    has_new = F.col(f"new.{key}").isNotNull()
    has_old = F.col(f"old.{key}").isNotNull()
    out = [F.coalesce(F.col(f"new.{key}"), F.col(f"old.{key}")).alias(key)]
    for c in existing.columns:
        if c == key:
            continue
        if c in new_cols:
            out.append(F.when(has_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
        else:
            dflt = defaults.get(c, F.lit(None))
            out.append(F.when(has_old, F.col(f"old.{c}")).otherwise(dflt).alias(c))
    return j.select(out)


def missing_keys(parents: DataFrame, children: DataFrame, key: str = "user_id") -> DataFrame:
    """Keys of ``parents`` without a row in ``children`` (set difference)."""
    return parents.select(key).distinct().join(children.select(key), key, "left_anti")


def rows_for_keys(rows: DataFrame, keys: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows whose key is in ``keys`` (semi join, never a collected isin)."""
    return rows.join(keys.select(key), key, "left_semi")


def backfill(existing: DataFrame, candidates: DataFrame, parents: DataFrame, key: str = "user_id") -> DataFrame:
    """Append the candidate rows of parents that have no existing row."""
    todo = rows_for_keys(candidates, missing_keys(parents, existing, key), key)
    return existing.unionByName(todo.select(existing.columns))


def fk_orphans(children: DataFrame, parents: DataFrame, key: str = "user_id") -> DataFrame:
    """Child rows whose key has no parent (REFERENCES violations)."""
    return children.join(parents.select(key), key, "left_anti")


def cascade_delete(children: DataFrame, surviving_parents: DataFrame, key: str = "user_id") -> DataFrame:
    """ON DELETE CASCADE: children that keep a parent."""
    return children.join(surviving_parents.select(key), key, "left_semi")


def check_violations(df: DataFrame, column: str = "risk_tier", domain: list[str] | None = None) -> DataFrame:
    """Rows breaking CHECK (column IN domain); null passes, as in SQL."""
    dom = domain or S.RISK_TIERS
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*dom))


def precision_violations(df: DataFrame, specs: dict[str, tuple[int, int]], key: str = "user_id") -> DataFrame:
    """(key, column, value) for values that do not fit NUMERIC(p, s)."""
    parts = []
    for c, (p, s) in specs.items():
        bad = F.expr(f"try_cast(round(`{c}`, {s}) as decimal({p},{s}))").isNull() & F.col(c).isNotNull()
        parts.append(df.where(bad).select(F.col(key), F.lit(c).alias("column"),
                                          F.col(c).cast("double").alias("value")))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out
