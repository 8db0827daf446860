"""Raw tables -> one behavioural feature row per customer, with the churn label.

Every fact table is aggregated to one row per customer (or per order first)
*before* it meets the customer table, so no join fans out: lines never join
orders row by row, events never join orders.  All partial aggregates are
map-side combined, so a customer or order holding a large share of rows
costs one pre-aggregated row per task, not a hot reducer.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import schemas as S
from riskloom.functions import exprs as X
from riskloom.sources.tables import RawTables


def reference_date(t: RawTables) -> F.Column:
    """The date of the latest (visible) order, as a literal.

    Computed once per table set (one value comes back to the driver) and
    folded into the plan as a constant: a scalar subquery would be executed
    once per use, and the feature formulas use the date five times."""
    key = ("ref_date", t.orders_lag_days or 0)
    if key not in t.scans:
        row = t.orders.agg(F.to_date(F.max("o_orderdate")).cast("string").alias("d")).first()
        t.scans[key] = row["d"]
    return F.lit(t.scans[key]).cast("date")


def _line_revenue_units() -> F.Column:
    """price * (1 - discount) in exact integer units of 1e-4: both are cast to
    DECIMAL first (cents, percent), then multiplied as 64-bit integers, which
    keeps the per-order sum exact and fast (no wide-decimal arithmetic)."""
    cents = (F.col("l_extendedprice").cast("decimal(12,2)") * 100).cast("long")
    pct = (F.col("l_discount").cast("decimal(4,2)") * 100).cast("long")
    return cents * (F.lit(100) - pct)


def order_category_lines(t: RawTables) -> DataFrame:
    """Per (order, category): line revenue (1e-4 units), lines and returned lines.

    One pass over the line table: lines meet their part (Spark broadcasts it
    only when its measured size is under the threshold) and are added up per
    (order, category) with map-side partial sums.  A line without a part, or
    whose part has no type, counts for its order but has no category."""
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return (t.lineitem.select("l_orderkey", "l_partkey", _line_revenue_units().alias("units"), "l_returnflag")
            .join(parts, "l_partkey", "left")
            .groupBy("l_orderkey", "p_type")
            .agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("lines"),
                 F.count_if(F.col("l_returnflag") == S.RETURN_FLAG).alias("returned")))


def share_order_facts(t: RawTables, lags: list[int]) -> RawTables:
    """For plans that derive features of several snapshots (``lags`` in days; 0 is
    the current run): the order statistics of all of them from one pass over the
    fact tables, and the event statistics, which no cut of the orders changes, are
    written once to the checkpoint folder."""
    from riskloom.session import materialize
    snaps = {lag: t.snapshot(lag) if lag else t for lag in lags}
    t.derived["event_stats"] = materialize(customer_event_stats(t), "event-stats")
    held = materialize(_order_stats(t, {lag: s.visible() for lag, s in snaps.items()}), "order-stats")
    for lag in lags:
        t.derived["order_stats", lag] = held.where(F.col(f"rows_{lag}") > 0).select("user_id", *[F.col(f"{c}_{lag}").alias(c) for c in ORDER_STATS])
    return t


ORDER_STATS = ["total_orders", "cancelled_orders", "returned_lines", "returned_orders", "orders_with_lines", "first_order_ts",
               "last_complete_ts", "line_revenue", "distinct_categories", "top_category", "lines"]


def order_facts(t: RawTables, visible: dict[int, F.Column]) -> DataFrame:
    """One row per (order, category), and one for an order without lines: customer,
    status, date and line totals, and for every snapshot (name: which orders it
    sees) whether it sees the row (``seen``), whether the row is the one of its
    order where the order's own measures count (``first``), and the order's
    returned lines.  The last two come from windows over the order key, by which the
    join has placed and sorted the rows; an order's rows are bounded by the category
    domain."""
    o = t.table("orders").where(reduce(or_, visible.values())).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"),
                                 "o_orderstatus", "o_orderdate", *[F.coalesce(v, F.lit(False)).alias(f"seen_{k}") for k, v in visible.items()])
    out = o.join(order_category_lines(t), "l_orderkey", "left")
    # the join's own order serves every window: nothing is sorted again
    own = Window.partitionBy("l_orderkey")
    so_far = own.orderBy("l_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = {f"place_{k}": F.sum(F.col(f"seen_{k}").cast("int")).over(so_far) for k in visible}
    returned = {f"order_returned_{k}": F.sum(F.when(F.col(f"seen_{k}"), F.col("returned"))).over(own) for k in visible}
    out = out.withColumns(places).withColumns(returned)
    return out.withColumns({f"first_{k}": F.col(f"seen_{k}") & (F.col(f"place_{k}") == 1) for k in visible})


def customer_order_stats(t: RawTables) -> DataFrame:
    """Per customer, from its order facts: completed / cancelled counts, first
    order of any status, last completed order, revenue and return counts over
    the lines of completed orders, distinct categories of these, and the
    category with most lines (ties alphabetical)."""
    lag = t.orders_lag_days or 0
    return t.shared(("order_stats", lag), lambda: _order_stats(t, {lag: t.visible()}).where(F.col(f"rows_{lag}") > 0).select(
        "user_id", *[F.col(f"{c}_{lag}").alias(c) for c in ORDER_STATS]))


def _order_stats(t: RawTables, visible: dict[int, F.Column]) -> DataFrame:
    """``customer_order_stats`` of every snapshot, side by side, and the rows each sees.

    One linear plan, summed per (customer, category) and then per customer: it
    reads ``orders`` and ``lineitem`` once.  Orders that no snapshot sees are left
    out at the scan."""
    complete = F.col("o_orderstatus") == S.STATUS_COMPLETE
    category = F.when(complete, F.col("p_type"))  # of completed orders only

    def partial(k) -> list[F.Column]:
        seen = F.col(f"seen_{k}")
        once = complete & F.col(f"first_{k}")
        aggs = {"rows": F.count_if(seen),
                "total_orders": F.count_if(once),
                "cancelled_orders": F.count_if(F.col(f"first_{k}") & (F.col("o_orderstatus") == S.STATUS_CANCELLED)),
                "first_order_ts": F.min(F.when(seen, F.col("o_orderdate"))),
                "last_complete_ts": F.max(F.when(seen & complete, F.col("o_orderdate"))),
                "units": F.sum(F.when(seen & complete, F.col("units").cast("decimal(38,0)"))),
                "lines": F.sum(F.when(seen & complete, F.col("lines"))),
                "returned_lines": F.sum(F.when(seen & complete, F.col("returned"))),
                "returned_orders": F.count_if(once & (F.col(f"order_returned_{k}") > 0)),
                "orders_with_lines": F.count_if(once & F.col("lines").isNotNull())}
        return [c.alias(f"{name}_{k}") for name, c in aggs.items()]

    def total(k) -> list[F.Column]:
        counts = ["rows", "total_orders", "cancelled_orders", "returned_lines", "returned_orders", "orders_with_lines", "lines"]
        name = F.when(F.col(f"rows_{k}") > 0, F.col("p_type"))
        order_key = F.when(name.isNotNull(), F.struct((-F.col(f"lines_{k}")).alias("neg_lines"), name.alias("name")))
        return [*[F.sum(f"{c}_{k}").alias(f"{c}_{k}") for c in counts], F.min(f"first_order_ts_{k}").alias(f"first_order_ts_{k}"),
                F.max(f"last_complete_ts_{k}").alias(f"last_complete_ts_{k}"),
                (F.sum(f"units_{k}") / F.lit(10000)).cast("decimal(18,2)").alias(f"line_revenue_{k}"),
                F.count(name).alias(f"distinct_categories_{k}"), F.min_by(name, order_key).alias(f"top_category_{k}")]

    per = order_facts(t, visible).groupBy("user_id", category.alias("p_type")).agg(*[c for k in visible for c in partial(k)])
    return per.groupBy("user_id").agg(*[c for k in visible for c in total(k)])


def customer_event_stats(t: RawTables) -> DataFrame:
    """Per user: event counts and active days ("sessions"), via (user, day)
    partial counts so a very active user is pre-aggregated per task."""
    e = t.events
    per_day = (e.groupBy("user_id", F.to_date("ts").alias("day"))
               .agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(F.col("event_type") == S.CART_EVENT).alias("n_cart"),
                    F.count_if(F.col("event_type") == S.PURCHASE_EVENT).alias("n_purchase")))
    return (per_day.groupBy("user_id")
            .agg(F.sum("n").alias("total_events"),
                 F.sum("n_cart").alias("cart_events"),
                 F.sum("n_purchase").alias("purchase_events"),
                 F.count(F.lit(1)).alias("approx_sessions")))


def customer_dimensions(t: RawTables) -> DataFrame:
    """Customer attributes; nation ⋈ region is the fixed 25-row geography,
    broadcast by its proven size."""
    geo = (t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", F.col("n_name").alias("state"),
                   (F.col("r_name") == S.US_REGION).alias("is_us_customer")))
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    age = F.lit(S.AGE_BASE) + F.pmod(F.col("c_custkey"), F.lit(S.AGE_SPAN))
    return (c.join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(F.col("c_custkey").alias("user_id"),
                    X.age_bucket(age).alias("age_bucket"),
                    F.when(F.pmod(F.col("c_custkey"), F.lit(2)) == 0, F.lit("M")).otherwise(F.lit("F")).alias("gender"),
                    X.mapping("c_mktsegment", S.SEGMENT_TO_SOURCE).alias("traffic_source"),
                    F.lit(None).cast("string").alias("city"),
                    "state", "is_us_customer"))


def feature_base(t: RawTables) -> DataFrame:
    """The wide feature table (FEATURE_SCHEMA), one row per customer."""
    dims = customer_dimensions(t)
    o = customer_order_stats(t)
    ev = t.shared("event_stats", lambda: customer_event_stats(t))
    j = dims.join(o, "user_id", "left").join(ev, "user_id", "left")

    total_orders = F.coalesce(F.col("total_orders"), F.lit(0).cast("long"))
    revenue = F.coalesce(F.col("line_revenue"), F.lit(0).cast("decimal(18,2)"))
    ref_date = reference_date(t)
    tenure = F.datediff(ref_date, F.to_date("first_order_ts")).cast("double")
    days_since = F.datediff(ref_date, F.to_date("last_complete_ts"))
    zero = F.lit(0).cast("long")
    sessions = F.coalesce(F.col("approx_sessions"), zero)
    return j.select(
        "user_id", "age_bucket", "gender", "traffic_source", "city", "state",
        "top_category", "is_us_customer",
        total_orders.alias("total_orders"),
        revenue.alias("total_revenue"),
        X.safe_ratio(F.col("line_revenue"), F.col("orders_with_lines"), None).alias("avg_order_value"),
        X.safe_ratio(revenue, total_orders, 0.0).alias("revenue_per_order"),
        tenure.alias("customer_tenure_days"),
        (total_orders.cast("double") / F.greatest(tenure / F.lit(30.0), F.lit(1.0))).alias("orders_per_month"),
        X.safe_ratio(F.col("returned_lines"), F.col("lines"), 0.0).alias("return_rate"),
        F.coalesce(F.col("returned_orders"), zero).alias("returned_orders"),
        F.coalesce(F.col("cancelled_orders"), zero).alias("cancelled_orders"),
        F.coalesce(F.col("distinct_categories"), zero).alias("distinct_categories"),
        F.coalesce(F.col("total_events"), zero).alias("total_events"),
        F.coalesce(F.col("cart_events"), zero).alias("cart_events"),
        F.coalesce(F.col("purchase_events"), zero).alias("purchase_events"),
        sessions.alias("approx_sessions"),
        X.safe_ratio(F.col("cart_events"), F.col("purchase_events"), 0.0).alias("cart_to_purchase_ratio"),
        X.safe_ratio(revenue, sessions, 0.0).alias("revenue_per_session"),
        days_since.alias("days_since_last_order"),
        F.when(days_since.isNull() | (days_since > S.CHURN_WINDOW_DAYS), F.lit(1))
         .otherwise(F.lit(0)).alias("churned"),
    )


def is_buyer() -> F.Column:
    """At least one completed order."""
    return F.col("total_orders") >= S.BUYER_MIN_ORDERS


def buyers(features: DataFrame) -> DataFrame:
    """Scope to customers with at least one completed order (pushed below the
    joins by Catalyst where it can)."""
    return features.where(is_buyer())
