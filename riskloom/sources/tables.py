"""Sources and sinks: the raw warehouse tables, feature / scored tables in
CSV or parquet, and overwrite-safe writes."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Declared schemas of the warehouse tables.  Reading with a declared schema
# skips Spark's footer-inference job (one per scan, over every file of the
# table on a cluster) and pins the column types the plans rely on.
RAW_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


@dataclass
class RawTables:
    """Lazy handles to the warehouse tables of one data directory.

    Each property is a plain parquet scan; Catalyst prunes columns and pushes
    filters into it, so nothing here reads more than a query needs.
    """

    spark: SparkSession
    root: str
    orders_lag_days: int | None = None
    derived: dict = field(default_factory=dict)  # shared intermediate tables, by name
    scans: dict = field(default_factory=dict)  # one scan handle per table name

    def snapshot(self, lag_days: int) -> "RawTables":
        """The same tables as of ``lag_days`` before the latest order: orders
        after the cut are invisible, so every derived feature is as it was
        then (an earlier load of the served tables).  Intermediate tables that
        do not depend on the cut (event totals) are shared, as are those made for it."""
        return RawTables(self.spark, self.root, lag_days, self.derived, self.scans)

    def shared(self, name: str, build):
        """A registered intermediate table, or ``build()`` when none is."""
        return self.derived[name] if name in self.derived else build()

    def table(self, name: str) -> DataFrame:
        if name not in self.scans:
            reader = self.spark.read
            if name in RAW_SCHEMAS:
                reader = reader.schema(RAW_SCHEMAS[name])
            self.scans[name] = reader.parquet(f"{self.root.rstrip('/')}/{name}.parquet")
        return self.scans[name]

    @property
    def customer(self) -> DataFrame:
        return self.table("customer")

    @property
    def orders(self) -> DataFrame:
        return self.table("orders").where(self.visible()) if self.orders_lag_days else self.table("orders")

    def visible(self) -> F.Column:
        """Whether an order lies before the cut."""
        return F.col("o_orderdate") <= self._orders_cut() if self.orders_lag_days else F.lit(True)

    def _orders_cut(self) -> F.Column:
        """Latest order time minus the lag, as a literal: computed once (one
        value comes back), so the filter reaches the parquet reader and skips
        row groups by their statistics, and no plan re-runs the max."""
        key = ("orders_cut", int(self.orders_lag_days))
        if key not in self.scans:
            latest = self.table("orders").agg(F.max("o_orderdate").cast("string").alias("m")).first()["m"]
            self.scans[key] = None if latest is None else str(
                datetime.fromisoformat(latest) - timedelta(days=int(self.orders_lag_days)))
        return F.lit(self.scans[key]).cast("timestamp_ntz")

    @property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @property
    def part(self) -> DataFrame:
        return self.table("part")

    @property
    def nation(self) -> DataFrame:
        return self.table("nation")

    @property
    def region(self) -> DataFrame:
        return self.table("region")

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def conversations(self) -> DataFrame:
        return self.table("conversations")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Scan a feature or scored table.  CSV is read with an explicit schema
    (no inference pass); a header row is expected."""
    if fmt == "csv":
        reader = spark.read.option("header", True)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.csv(path)
    df = spark.read.parquet(path)
    if schema is not None:
        df = df.select([F.col(f.name).cast(f.dataType).alias(f.name)
                        for f in schema.fields if f.name in df.columns])
    return df


def _parsed(c: str, dtype: T.DataType) -> tuple[F.Column, F.Column]:
    """A text cell as ``dtype``, and why it is not (null when it is, or when the
    cell is empty)."""
    text = F.trim(F.col(f"`{c}`"))
    if isinstance(dtype, T.StringType):
        return F.col(f"`{c}`"), F.lit(None).cast("string")
    value = F.expr(f"try_cast(trim(`{c}`) as {dtype.simpleString()})")
    as_number = F.expr(f"try_cast(trim(`{c}`) as double)")
    if isinstance(dtype, T.BooleanType):
        cause = F.lit("not a boolean")
    elif isinstance(dtype, T.NumericType):
        whole = isinstance(dtype, T.IntegralType)
        fraction = as_number % F.lit(1.0)
        if whole:  # 5.0 is whole; Spark would cut 12.5 to 12
            value = F.when(fraction == 0, F.expr(f"try_cast(try_cast(trim(`{c}`) as decimal(38,9)) as {dtype.simpleString()})"))
        bad = F.when(fraction != 0, F.lit("not whole")) if whole else F.lit(None).cast("string")
        cause = F.when(as_number.isNull() | F.isnan(as_number), F.lit("not a number"))
        cause = F.when(cause.isNotNull(), cause).when(bad.isNotNull(), bad).otherwise(F.lit("out of range"))
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
    else:
        cause = F.lit(f"not a {dtype.simpleString()}")
    return value, F.when(value.isNull() & text.isNotNull() & (text != ""), cause)


def scan_with_rejects(spark: SparkSession, path: str, schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a CSV with a header that may hold bad cells.

    Every cell is read as text (nothing is inferred, no row is lost) and cast on
    its own: a bad cell is null in ``rows`` and one row (key as written, column,
    value, cause) in ``rejects``; empty cells are null and no reject.  A record
    with too few or too many cells keeps what it has, and is one reject with the
    whole record as its value.  Both are projections of one scan."""
    corrupt = "_record"
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(corrupt, T.StringType())])
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).schema(as_text).csv(path)
    cells = {f.name: _parsed(f.name, f.dataType) for f in schema.fields}
    rows = raw.select(*[v.alias(c) for c, (v, _) in cells.items()])
    each = [F.when(cause.isNotNull(), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value"), cause.alias("cause")))
            for c, (_, cause) in cells.items()]
    each.append(F.when(F.col(corrupt).isNotNull(), F.struct(F.lit("").alias("column"), F.col(corrupt).alias("value"), F.lit("wrong number of cells").alias("cause"))))
    rejects = raw.select(F.col(f"`{key}`").alias("key"), F.explode(F.array(*each)).alias("r")).where("r IS NOT NULL").select("key", "r.*")
    return rows, rejects


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, sort_within: list[str] | None = None) -> None:
    """Write a table.  Never point ``path`` at a table the plan still reads:
    overwrite deletes the input before the job runs."""
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def optional_columns(df: DataFrame, wanted: list[tuple[str, object]]) -> DataFrame:
    """Project wanted columns, filling absent ones with a literal default
    (the ``if col in df.columns`` probes of the reference)."""
    cols = []
    for name, default in wanted:
        if name in df.columns:
            cols.append(F.col(name))
        else:
            cols.append(F.lit(default).alias(name))
    return df.select(cols)
