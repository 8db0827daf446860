"""Column expressions shared by operators.  All are built-in Spark
functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import schemas as S


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: str | Column, den: str | Column, default: float | None = 0.0) -> Column:
    """num / den as double; ``default`` where den is 0 or null (ANSI-safe)."""
    n, d = col(num).cast("double"), col(den).cast("double")
    out = F.when((d.isNull()) | (d == 0), F.lit(default).cast("double")).otherwise(n / d)
    return out


def smoothed_ratio(num: str | Column, den: str | Column) -> Column:
    """num / (den + 1): the engineered-ratio form; den >= 0 so never divides by zero."""
    return col(num).cast("double") / (col(den).cast("double") + F.lit(1.0))


def coerce_numeric(c: str, dtype: T.DataType) -> Column:
    """to_numeric(errors='coerce').fillna(0): unparsable, NaN and null become 0.

    Numeric inputs keep their type (decimals stay exact); strings are parsed
    to double.  NaN must be handled apart from null: coalesce leaves NaN.
    """
    if isinstance(dtype, (T.StringType,)):
        parsed = F.expr(f"try_cast(trim(`{c}`) as double)")
        return F.coalesce(F.nanvl(parsed, F.lit(0.0)), F.lit(0.0)).alias(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).cast(dtype).alias(c)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
    return F.coalesce(F.col(c), F.lit(0).cast(dtype)).alias(c)


def clip_upper(c: str | Column, cap: Column) -> Column:
    """pandas clip(upper=cap): nulls stay null (least(null, cap) would give cap)."""
    v = col(c)
    return F.when(v.isNull(), v).otherwise(F.least(v, cap))


def qcut_from_rank(rank: str | Column, n: str | Column, q: int = 5) -> Column:
    """qcut(rank, q) labels 1..q for ranks 1..n in integer arithmetic.

    Equals pandas' equal-frequency bins on rank (edges at 1 + k(n-1)/q,
    right-closed), which is *not* ntile(q): ceil(q(r-1)/(n-1)), at least 1.
    """
    r, m = col(rank).cast("long"), col(n).cast("long")
    raw = F.floor((F.lit(q) * (r - 1) + (m - 2)) / F.greatest(m - 1, F.lit(1)))
    return F.when(m <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), raw)).cast("int")


def risk_tier(p: str | Column) -> Column:
    """High / Medium / Low on the unrounded probability; NaN and null are Low
    (every comparison with NaN is false in the reference)."""
    v = col(p)
    ok = v.isNotNull() & ~F.isnan(v)
    return (F.when(ok & (v >= S.HIGH_THRESHOLD), F.lit("High"))
            .when(ok & (v >= S.MEDIUM_THRESHOLD), F.lit("Medium"))
            .otherwise(F.lit("Low")))


def age_bucket(age: str | Column) -> Column:
    a = col(age)
    return (F.when(a.isNull(), F.lit(None).cast("string"))
            .when(a < 25, F.lit("18-24"))
            .when(a < 35, F.lit("25-34"))
            .when(a < 45, F.lit("35-44"))
            .when(a < 55, F.lit("45-54"))
            .otherwise(F.lit("55+")))


def mapping(c: str | Column, pairs: list[tuple[str, str]]) -> Column:
    """Small fixed lookup as a CASE chain (no join needed)."""
    v = col(c)
    out = None
    for k, val in pairs:
        out = F.when(v == k, F.lit(val)) if out is None else out.when(v == k, F.lit(val))
    return out.otherwise(F.lit(None).cast("string"))


def base_score(opm: str | Column, one_time: str | Column, monetary: str | Column,
               return_rate: str | Column) -> Column:
    c = S.BASE_SCORE_COEF
    z = (F.lit(c["intercept"])
         + F.lit(c["orders_per_month"]) * col(opm).cast("double")
         + F.lit(c["one_time_buyer"]) * col(one_time).cast("double")
         + F.lit(c["rfm_monetary_score"]) * col(monetary).cast("double")
         + F.lit(c["return_rate"]) * col(return_rate).cast("double"))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def pearson(a: str | Column, b: str | Column) -> Column:
    """Pearson r as covariance form; null (not an ANSI error) for constants."""
    x, y = col(a).cast("double"), col(b).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def to_double(c: str | Column) -> Column:
    return col(c).cast("double")


def round_double(c: str | Column, scale: int) -> Column:
    """Round half-up then present as double (both engines print the same)."""
    return F.round(col(c), scale).cast("double")


def js_fixed(c: str | Column, digits: int) -> Column:
    """Number.toFixed(d): fixed decimals, no grouping."""
    return F.format_string(f"%.{digits}f", col(c).cast("double"))


def js_grouped_int(c: str | Column) -> Column:
    """toLocaleString('en-US', {maximumFractionDigits: 0}): grouped integer."""
    return F.format_number(F.round(col(c).cast("double"), 0), 0)


def with_row_values(df, one_row):
    """Attach the columns of a one-row table (a global aggregate) to every
    row of ``df`` as typed literals.  Exactly one row is fetched to the
    driver, so the size is fixed by the column list; the plan then carries
    constants instead of a cross join or a per-use scalar subquery."""
    row = one_row.first()
    return df.select("*", *[F.lit(None if row is None else row[f.name]).cast(f.dataType).alias(f.name)
                            for f in one_row.schema.fields])
