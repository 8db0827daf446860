"""Cleaning and profiling: numeric coercion, exact quantiles, winsorising,
null profile, describe, table shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import schemas as S
from riskloom.functions import exprs as X
from riskloom.operators import selection
from riskloom.session import materialize


def clean_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Coerce the numeric base columns: unparsable / NaN / null -> 0."""
    wanted = set(columns or S.NUMERIC_BASE_COLUMNS)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select([X.coerce_numeric(c, types[c]) if c in wanted else F.col(c) for c in df.columns])


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles of several columns by selection:
    (column, prob, value).  No sort and no shuffle of rows, whatever the number
    of distinct values."""
    found = selection.quantiles(df, columns, probs)
    rows = [(c, float(p), found[c, float(p)]) for c in columns for p in probs]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def winsorize(df: DataFrame, columns: list[str] | None = None, q: float = S.CAP_QUANTILE) -> DataFrame:
    """clip(upper=quantile(q)) per column.  The caps are one row of k
    scalars (size fixed by the column list, not by the data): found once
    and inlined as literals, so later jobs do not re-run the quantile plan.
    ``df`` is read a few times: hand over a written table.  Decimal columns are
    clipped at the cap rounded to their own scale, so they stay exact."""
    cols = columns or S.CAP_COLUMNS
    vals = selection.quantiles(df, cols, [q])
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in cols:
            t = types[c]
            cap = F.lit(vals[c, float(q)]).cast("double")
            if isinstance(t, T.DecimalType):
                out.append(X.clip_upper(c, cap.cast(t)).alias(c))
            else:
                out.append(X.clip_upper(F.col(c).cast("double"), cap).alias(c))
        else:
            out.append(F.col(c))
    return df.select(out)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, null_count) for columns with at least one null, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stack = F.expr("stack({n}, {args}) as (column, null_count)".format(
        n=len(df.columns), args=", ".join(f"'{c}', `{c}`" for c in df.columns)))
    return counts.select(stack).where(F.col("null_count") > 0)


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """pandas describe() per numeric column, rounded to 2: count, mean, std,
    min, 25%, 50%, 75%, max (nulls and NaN skipped, as pandas does).

    The wanted columns are written once, one row a row; the moments are one
    aggregate over them and the quartiles of all columns come from the same few
    counting passes, so nothing is sorted or unpivoted."""
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
               T.DoubleType, T.DecimalType, T.BooleanType)
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, numeric)]
    held = materialize(df.select([F.col(c).cast("double").alias(c) for c in cols]), "describe")
    measures = [("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)]
    moments = held.agg(*[f(selection.number(c)).alias(f"{m}{i}") for i, c in enumerate(cols) for m, f in measures]).first()
    probs = [0.25, 0.5, 0.75]
    known = [selection.Spread(moments[f"count{i}"], moments[f"min{i}"], moments[f"max{i}"]) for i in range(len(cols))]
    found = selection.quantiles(held, cols, probs, known)
    rows = [(c, float(moments[f"count{i}"]), *(moments[f"{m}{i}"] for m in ("mean", "std", "min")), *(found[c, p] for p in probs), moments[f"max{i}"])
            for i, c in enumerate(cols)]
    out = df.sparkSession.createDataFrame(
        rows, "column string, count double, mean double, std double, min double, p25 double, p50 double, p75 double, max double")
    return out.select("column", "count", *[X.round_double(c, 2).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def table_profile(df: DataFrame) -> DataFrame:
    """Shape and types: one row per column with its position and Spark type,
    plus the exact row count (one aggregate job)."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    spark = df.sparkSession
    cols = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string")
    return X.with_row_values(cols, n).withColumn("n_columns", F.lit(len(df.columns)))
