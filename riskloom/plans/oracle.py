"""Independent SQL definitions of the queries, for DuckDB over the same
parquet tables (views named after the tables).  They restate the semantics
in plain SQL -- window ranks, quantile_cont, full outer joins -- so a
mismatch points at a bug in either formulation."""

from __future__ import annotations

from riskloom import schemas as S


def _case_map(col: str, pairs: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in pairs)
    return f"CASE {whens} END"


def _qcut(r: str, n: str = "n_b") -> str:
    return (f"CAST(CASE WHEN {n} <= 1 THEN 1 ELSE greatest(1, (5 * ({r} - 1) + ({n} - 2)) // ({n} - 1)) END "
            f"AS INTEGER)")


def chain(p: str = "", lag_days: int | None = None) -> list[str]:
    """CTEs from raw tables to the served view; names prefixed with ``p``."""
    src = "orders" if not lag_days else (
        f"(SELECT * FROM orders WHERE o_orderdate <= (SELECT max(o_orderdate) FROM orders) "
        f"- INTERVAL {int(lag_days)} DAY)")
    c = S.BASE_SCORE_COEF
    z = (f"{c['intercept']!r}e0 + {c['orders_per_month']!r}e0 * orders_per_month "
         f"+ {c['one_time_buyer']!r}e0 * one_time_buyer + {c['rfm_monetary_score']!r}e0 * rfm_monetary_score "
         f"+ {c['return_rate']!r}e0 * return_rate").replace(".0e0", ".0e0")
    tops = S.BASE_TOP_FEATURES
    return [
        f"{p}ord AS (SELECT * FROM {src})",
        f"{p}ref AS (SELECT max(o_orderdate) AS ref_ts FROM {p}ord)",
        f"""{p}c_ord AS (SELECT o_custkey AS user_id,
              count(*) FILTER (WHERE o_orderstatus = 'F') AS total_orders,
              count(*) FILTER (WHERE o_orderstatus = 'P') AS cancelled_orders,
              min(o_orderdate) AS first_order_ts,
              max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS last_complete_ts
            FROM {p}ord GROUP BY o_custkey)""",
        f"{p}f_ord AS (SELECT o_orderkey, o_custkey AS user_id FROM {p}ord WHERE o_orderstatus = 'F')",
        f"""{p}o_line AS (SELECT l_orderkey,
              sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS order_revenue,
              count(*) AS order_lines,
              count(*) FILTER (WHERE l_returnflag = 'R') AS order_returned_lines
            FROM lineitem GROUP BY l_orderkey)""",
        f"""{p}c_line AS (SELECT f.user_id, CAST(sum(ol.order_revenue) AS DECIMAL(18,2)) AS line_revenue,
              sum(ol.order_lines) AS lines, sum(ol.order_returned_lines) AS returned_lines,
              count(*) FILTER (WHERE ol.order_returned_lines > 0) AS returned_orders,
              count(*) AS orders_with_lines
            FROM {p}o_line ol JOIN {p}f_ord f ON f.o_orderkey = ol.l_orderkey GROUP BY f.user_id)""",
        f"""{p}c_cat1 AS (SELECT f.user_id, pt.p_type, count(*) AS category_lines
            FROM lineitem l JOIN part pt ON pt.p_partkey = l.l_partkey AND pt.p_type IS NOT NULL
            JOIN {p}f_ord f ON f.o_orderkey = l.l_orderkey GROUP BY f.user_id, pt.p_type)""",
        f"""{p}c_cat AS (SELECT user_id, count(*) AS distinct_categories,
              first(p_type ORDER BY category_lines DESC, p_type ASC) AS top_category
            FROM {p}c_cat1 GROUP BY user_id)""",
        f"""{p}c_ev AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS total_events,
              CAST(sum(n_cart) AS BIGINT) AS cart_events, CAST(sum(n_purchase) AS BIGINT) AS purchase_events,
              count(*) AS approx_sessions
            FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n,
                    count(*) FILTER (WHERE event_type = '{S.CART_EVENT}') AS n_cart,
                    count(*) FILTER (WHERE event_type = '{S.PURCHASE_EVENT}') AS n_purchase
                  FROM events GROUP BY 1, 2) GROUP BY user_id)""",
        f"""{p}dims AS (SELECT c.c_custkey AS user_id,
              CASE WHEN a < 25 THEN '18-24' WHEN a < 35 THEN '25-34' WHEN a < 45 THEN '35-44'
                   WHEN a < 55 THEN '45-54' ELSE '55+' END AS age_bucket,
              CASE WHEN ((c.c_custkey % 2) + 2) % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
              {_case_map('c.c_mktsegment', S.SEGMENT_TO_SOURCE)} AS traffic_source,
              CAST(NULL AS VARCHAR) AS city, g.state, g.is_us_customer
            FROM (SELECT *, {S.AGE_BASE} + ((c_custkey % {S.AGE_SPAN}) + {S.AGE_SPAN}) % {S.AGE_SPAN} AS a
                  FROM customer) c
            LEFT JOIN (SELECT n_nationkey, n_name AS state, r_name = '{S.US_REGION}' AS is_us_customer
                       FROM nation JOIN region ON n_regionkey = r_regionkey) g
              ON c.c_nationkey = g.n_nationkey)""",
        f"""{p}j AS (SELECT d.*, cc.top_category, o.total_orders AS o_total, o.cancelled_orders AS o_cancel,
              o.first_order_ts, o.last_complete_ts, l.line_revenue, l.lines, l.returned_lines,
              l.returned_orders AS l_returned, l.orders_with_lines, cc.distinct_categories AS n_cat,
              e.total_events AS e_total, e.cart_events AS e_cart, e.purchase_events AS e_purchase,
              e.approx_sessions AS e_sessions,
              CAST(date_diff('day', CAST(o.first_order_ts AS DATE), CAST(r.ref_ts AS DATE)) AS DOUBLE) AS tenure,
              CAST(date_diff('day', CAST(o.last_complete_ts AS DATE), CAST(r.ref_ts AS DATE)) AS INTEGER) AS ds
            FROM {p}dims d LEFT JOIN {p}c_ord o USING (user_id) LEFT JOIN {p}c_line l USING (user_id)
            LEFT JOIN {p}c_cat cc USING (user_id) LEFT JOIN {p}c_ev e USING (user_id) CROSS JOIN {p}ref r)""",
        f"""{p}feat AS (SELECT user_id, age_bucket, gender, traffic_source, city, state, top_category, is_us_customer,
              coalesce(o_total, 0) AS total_orders,
              coalesce(line_revenue, CAST(0 AS DECIMAL(18,2))) AS total_revenue,
              CASE WHEN coalesce(orders_with_lines, 0) = 0 THEN NULL
                   ELSE CAST(line_revenue AS DOUBLE) / CAST(orders_with_lines AS DOUBLE) END AS avg_order_value,
              CASE WHEN coalesce(o_total, 0) = 0 THEN CAST(0 AS DOUBLE)
                   ELSE CAST(coalesce(line_revenue, 0) AS DOUBLE) / CAST(o_total AS DOUBLE) END AS revenue_per_order,
              tenure AS customer_tenure_days,
              CAST(coalesce(o_total, 0) AS DOUBLE) / greatest(coalesce(tenure / 30.0e0, 1.0e0), 1.0e0) AS orders_per_month,
              CASE WHEN coalesce(lines, 0) = 0 THEN CAST(0 AS DOUBLE)
                   ELSE CAST(returned_lines AS DOUBLE) / CAST(lines AS DOUBLE) END AS return_rate,
              coalesce(l_returned, 0) AS returned_orders,
              coalesce(o_cancel, 0) AS cancelled_orders,
              coalesce(n_cat, 0) AS distinct_categories,
              coalesce(e_total, 0) AS total_events,
              coalesce(e_cart, 0) AS cart_events,
              coalesce(e_purchase, 0) AS purchase_events,
              coalesce(e_sessions, 0) AS approx_sessions,
              CASE WHEN coalesce(e_purchase, 0) = 0 THEN CAST(0 AS DOUBLE)
                   ELSE CAST(e_cart AS DOUBLE) / CAST(e_purchase AS DOUBLE) END AS cart_to_purchase_ratio,
              CASE WHEN coalesce(e_sessions, 0) = 0 THEN CAST(0 AS DOUBLE)
                   ELSE CAST(coalesce(line_revenue, 0) AS DOUBLE) / CAST(e_sessions AS DOUBLE) END AS revenue_per_session,
              ds AS days_since_last_order,
              CASE WHEN ds IS NULL OR ds > {S.CHURN_WINDOW_DAYS} THEN 1 ELSE 0 END AS churned
            FROM {p}j)""",
        f"{p}buyers AS (SELECT * FROM {p}feat WHERE total_orders >= {S.BUYER_MIN_ORDERS})",
        f"""{p}cleaned AS (SELECT * REPLACE (coalesce(avg_order_value, CAST(0 AS DOUBLE)) AS avg_order_value)
            FROM {p}buyers)""",
        f"""{p}caps AS (SELECT
              CAST(quantile_cont(CAST(total_revenue AS DOUBLE), {S.CAP_QUANTILE}) AS DECIMAL(18,2)) AS rev_cap,
              quantile_cont(CAST(total_events AS DOUBLE), {S.CAP_QUANTILE}) AS ev_cap,
              quantile_cont(CAST(approx_sessions AS DOUBLE), {S.CAP_QUANTILE}) AS ses_cap,
              quantile_cont(customer_tenure_days, {S.CAP_QUANTILE}) AS ten_cap
            FROM {p}cleaned)""",
        f"""{p}capped AS (SELECT c.* REPLACE (
              least(c.total_revenue, k.rev_cap) AS total_revenue,
              least(CAST(c.total_events AS DOUBLE), k.ev_cap) AS total_events,
              least(CAST(c.approx_sessions AS DOUBLE), k.ses_cap) AS approx_sessions,
              least(c.customer_tenure_days, k.ten_cap) AS customer_tenure_days)
            FROM {p}cleaned c CROSS JOIN {p}caps k)""",
        f"""{p}ranked AS (SELECT *,
              row_number() OVER (ORDER BY total_orders, user_id) AS r_f,
              row_number() OVER (ORDER BY total_revenue, user_id) AS r_m,
              row_number() OVER (ORDER BY days_since_last_order DESC NULLS LAST, user_id) AS r_r,
              count(*) OVER () AS n_b
            FROM {p}capped)""",
        f"""{p}scored AS (SELECT * EXCLUDE (r_f, r_m, r_r, n_b),
              {_qcut('r_f')} AS rfm_frequency_score, {_qcut('r_m')} AS rfm_monetary_score,
              {_qcut('r_r')} AS rfm_recency_score
            FROM {p}ranked)""",
        f"""{p}eng AS (SELECT *, rfm_frequency_score + rfm_monetary_score + rfm_recency_score AS rfm_total,
              CAST(total_events AS DOUBLE) / (CAST(total_orders AS DOUBLE) + 1.0e0) AS events_per_order,
              coalesce(CAST(return_rate > {S.HIGH_RETURN_RATE}e0 AS INTEGER), 0) AS high_return_flag,
              coalesce(CAST(total_orders = 1 AS INTEGER), 0) AS one_time_buyer,
              CAST(cancelled_orders AS DOUBLE) / (CAST(total_orders AS DOUBLE) + 1.0e0) AS cancel_rate,
              CAST(total_revenue AS DOUBLE) / (customer_tenure_days + 1.0e0) AS revenue_per_day
            FROM {p}scored)""",
        f"""{p}based AS (SELECT *, 1.0e0 / (1.0e0 + exp(-({z}))) AS p_raw FROM {p}eng)""",
        f"""{p}tiered AS (SELECT *,
              CASE WHEN p_raw IS NOT NULL AND NOT isnan(p_raw) AND p_raw >= {S.HIGH_THRESHOLD}e0 THEN 'High'
                   WHEN p_raw IS NOT NULL AND NOT isnan(p_raw) AND p_raw >= {S.MEDIUM_THRESHOLD}e0 THEN 'Medium'
                   ELSE 'Low' END AS risk_tier,
              CAST(round(CAST(CAST(p_raw AS VARCHAR) AS DECIMAL(38,18)), 4) AS DOUBLE) AS churn_probability
            FROM {p}based)""",
        f"""{p}pred AS (SELECT user_id, churn_probability, risk_tier, churned AS actual_churned, total_orders,
              CAST(total_revenue AS DOUBLE) AS total_revenue, orders_per_month, customer_tenure_days, return_rate,
              one_time_buyer, rfm_frequency_score, rfm_monetary_score, age_bucket, gender, traffic_source,
              '{tops[0]}' AS top_feature_1, '{tops[1]}' AS top_feature_2, '{tops[2]}' AS top_feature_3
            FROM {p}tiered)""",
        f"""{p}cust AS (SELECT user_id, age_bucket, gender, traffic_source,
              CAST(total_orders AS INTEGER) AS total_orders,
              CAST(CAST(round(CAST(CAST(CAST(total_revenue AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS DECIMAL(10,2)) AS total_revenue,
              CAST((2 * CAST(total_revenue * 100 AS BIGINT) + greatest(total_orders, 1))
                   // (2 * greatest(total_orders, 1)) / 100.0e0 AS DECIMAL(10,2)) AS avg_order_value,
              CAST(CAST(round(CAST(CAST(orders_per_month AS VARCHAR) AS DECIMAL(38,18)), 3) AS DOUBLE) AS DECIMAL(8,3)) AS orders_per_month,
              CAST(trunc(customer_tenure_days) AS INTEGER) AS customer_tenure_days,
              CAST(CAST(round(CAST(CAST(return_rate AS VARCHAR) AS DECIMAL(38,18)), 3) AS DOUBLE) AS DECIMAL(5,3)) AS return_rate,
              CAST(one_time_buyer AS BOOLEAN) AS one_time_buyer,
              CAST(rfm_frequency_score AS SMALLINT) AS rfm_frequency_score,
              CAST(rfm_monetary_score AS SMALLINT) AS rfm_monetary_score
            FROM {p}tiered)""",
        f"""{p}scores AS (SELECT user_id, CAST(CAST(round(CAST(CAST(churn_probability AS VARCHAR) AS DECIMAL(38,18)), 4) AS DOUBLE) AS DECIMAL(6,4)) AS churn_probability,
              risk_tier, CAST(actual_churned AS BOOLEAN) AS actual_churned,
              top_feature_1, top_feature_2, top_feature_3
            FROM {p}pred)""",
        f"""{p}view AS (SELECT c.user_id, c.age_bucket, c.gender, c.traffic_source, c.total_orders, c.total_revenue,
              c.avg_order_value, c.orders_per_month, c.customer_tenure_days, c.return_rate, c.one_time_buyer,
              c.rfm_frequency_score, c.rfm_monetary_score, s.churn_probability, s.risk_tier, s.actual_churned,
              s.top_feature_1, s.top_feature_2, s.top_feature_3
            FROM {p}cust c JOIN {p}scores s ON c.user_id = s.user_id)""",
        f"""{p}seg AS (SELECT risk_tier, age_bucket, gender, traffic_source, count(*) AS user_count,
              CAST(CAST(round(CAST(CAST(avg(churn_probability) AS VARCHAR) AS DECIMAL(38,18)), 3) AS DOUBLE) AS DOUBLE) AS avg_churn_prob,
              CAST(CAST(round(CAST(CAST(sum(total_revenue) AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS DOUBLE) AS total_revenue_at_risk,
              CAST(CAST(round(CAST(CAST(avg(total_orders) AS VARCHAR) AS DECIMAL(38,18)), 1) AS DOUBLE) AS DOUBLE) AS avg_orders,
              CAST(CAST(round(CAST(CAST(avg(orders_per_month) AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS DOUBLE) AS avg_orders_per_month,
              CAST(CAST(round(CAST(CAST(avg(return_rate) AS VARCHAR) AS DECIMAL(38,18)), 3) AS DOUBLE) AS DOUBLE) AS avg_return_rate,
              CAST(sum(CASE WHEN one_time_buyer THEN 1 ELSE 0 END) AS BIGINT) AS one_time_buyers
            FROM {p}view GROUP BY risk_tier, age_bucket, gender, traffic_source)""",
    ]


def with_chain(body: str, snapshot: bool = False) -> str:
    ctes = chain("")
    if snapshot:
        ctes = chain("s_", 365) + ctes
    return "WITH " + ",\n".join(ctes) + "\n" + body


FEATURE_COLUMNS = [f.name for f in S.FEATURE_SCHEMA.fields]
_FEAT_SELECT = ", ".join(
    "CAST(total_revenue AS DOUBLE) AS total_revenue" if c == "total_revenue" else c for c in FEATURE_COLUMNS)


def _dbl(cols: list[str], decimal_cols: set[str]) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in decimal_cols else c for c in cols)


CUST_COLS = ["user_id", "age_bucket", "gender", "traffic_source", "total_orders", "total_revenue",
             "avg_order_value", "orders_per_month", "customer_tenure_days", "return_rate", "one_time_buyer",
             "rfm_frequency_score", "rfm_monetary_score"]
CUST_DEC = {"total_revenue", "avg_order_value", "orders_per_month", "return_rate"}
SCORE_COLS = ["user_id", "churn_probability", "risk_tier", "actual_churned",
              "top_feature_1", "top_feature_2", "top_feature_3"]
VIEW_COLS = CUST_COLS + SCORE_COLS[1:]
SEG_COLS = ("risk_tier, age_bucket, gender, traffic_source, user_count, avg_churn_prob, total_revenue_at_risk, "
            "avg_orders, avg_orders_per_month, avg_return_rate, one_time_buyers")
SEG_ORDER = ("total_revenue_at_risk DESC NULLS FIRST, risk_tier NULLS FIRST, age_bucket NULLS FIRST, "
             "gender NULLS FIRST, traffic_source NULLS FIRST")


def _r(x: str, d: int = 2) -> str:
    """Half-up rounding of the shortest decimal form of a double (what
    Spark's round does), not of its binary value."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), {d}) AS DOUBLE)"


def _describe_sql() -> str:
    parts = []
    num = [f.name for f in S.FEATURE_SCHEMA.fields
           if f.dataType.typeName() in ("long", "integer", "double", "decimal")]
    for c in num:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count({x}) AS DOUBLE) AS count, {_r(f'avg({x})')} AS mean, "
            f"{_r(f'stddev_samp({x})')} AS std, {_r(f'min({x})')} AS min, "
            f"{_r(f'quantile_cont({x}, 0.25)')} AS p25, {_r(f'quantile_cont({x}, 0.5)')} AS p50, "
            f"{_r(f'quantile_cont({x}, 0.75)')} AS p75, {_r(f'max({x})')} AS max FROM feat")
    return with_chain("\nUNION ALL\n".join(parts))


def _null_profile_sql() -> str:
    parts = [f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM capped"
             for c in FEATURE_COLUMNS]
    return with_chain("SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE null_count > 0")


def _class_comparison_sql() -> str:
    parts = []
    for c in S.CLASS_COMPARE_COLUMNS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS metric, CAST(round(CAST(CAST(avg(CASE WHEN churned = 0 THEN {x} END) AS VARCHAR) AS DECIMAL(38,18)), 3) AS DOUBLE) AS retained_avg, "
                     f"CAST(round(CAST(CAST(avg(CASE WHEN churned = 1 THEN {x} END) AS VARCHAR) AS DECIMAL(38,18)), 3) AS DOUBLE) AS churned_avg FROM cleaned")
    return with_chain("SELECT *, CAST(round(CAST(CAST(CASE WHEN churned_avg = 0 THEN NULL ELSE retained_avg / churned_avg END AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) "
                      "AS ratio FROM (" + "\nUNION ALL\n".join(parts) + ")")


def _pearson(a: str, b: str) -> str:
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _corr_matrix_sql() -> str:
    cols = S.CORR_MATRIX_COLUMNS
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(round(CAST(CAST({_pearson(a, b)} AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE) AS corr FROM cleaned"
             for i, a in enumerate(cols) for b in cols[i + 1:]]
    return with_chain("\nUNION ALL\n".join(parts))


MODEL_FEATURES = ["age_bucket", "gender", "traffic_source", "total_orders", "total_revenue", "avg_order_value",
                  "revenue_per_order", "customer_tenure_days", "orders_per_month", "return_rate", "returned_orders",
                  "cancelled_orders", "distinct_categories", "cart_events", "rfm_frequency_score",
                  "rfm_monetary_score", "events_per_order", "high_return_flag", "one_time_buyer", "cancel_rate",
                  "revenue_per_day"]
ENCODED = ["age_bucket", "gender", "traffic_source"]


def _encoded_cte() -> str:
    codes = ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS INTEGER) AS {c}_code" for c in ENCODED)
    return f"enc AS (SELECT *, {codes} FROM eng)"


def _leak_sql() -> str:
    feats = [f"{c}_code" if c in ENCODED else c for c in MODEL_FEATURES]
    parts = [f"SELECT '{name}' AS feature, abs({_pearson(f, 'churned')}) AS abs_corr FROM enc"
             for name, f in zip(MODEL_FEATURES, feats)]
    return ("WITH " + ",\n".join(chain("") + [_encoded_cte()]) + "\n"
            + "SELECT feature, CAST(round(CAST(CAST(abs_corr AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE) AS abs_corr, abs_corr > " + f"{S.LEAK_CORRELATION_THRESHOLD}e0"
            + " AS flagged FROM (" + "\nUNION ALL\n".join(parts) + ") ORDER BY abs_corr DESC NULLS LAST, feature "
            + f"LIMIT {S.LEAK_TOP_N}")


def _hist_sql(col: str, clip: float, bins: int) -> str:
    return with_chain(f"""
      , x AS (SELECT churned, least(CAST({col} AS DOUBLE), {clip!r}e0) AS x FROM eng WHERE {col} IS NOT NULL),
      b AS (SELECT churned, min(x) AS lo0, max(x) AS hi0 FROM x GROUP BY churned),
      bb AS (SELECT churned, CASE WHEN hi0 > lo0 THEN lo0 ELSE lo0 - 0.5e0 END AS lo,
                     CASE WHEN hi0 > lo0 THEN hi0 ELSE hi0 + 0.5e0 END AS hi FROM b)
      SELECT churned, CAST(least(floor((x - lo) * {bins} / (hi - lo)), {bins - 1}) AS INTEGER) AS bin,
             count(*) AS count, any_value(lo) + any_value(hi - lo) * bin / {bins} AS bin_start,
             any_value(lo) + any_value(hi - lo) * (bin + 1) / {bins} AS bin_end
      FROM x JOIN bb USING (churned) GROUP BY 1, 2""".replace("\n      , x AS", ", x AS"))


def _with_extra(extra: list[str], body: str, snapshot: bool = False) -> str:
    ctes = (chain("s_", 365) if snapshot else []) + chain("") + extra
    return "WITH " + ",\n".join(ctes) + "\n" + body


_HASH = "((((user_id + 42) % 2147483648 + 2147483648) % 2147483648) * 2654435761) % 4294967296"
_SPLIT = (f"CASE WHEN row_number() OVER (PARTITION BY churned ORDER BY {_HASH}, user_id) "
          f"<= floor({S.SPLIT_TEST_SHARE} * count(*) OVER (PARTITION BY churned) + 0.5) THEN 'test' ELSE 'train' END")
_TEST = [f"spl AS (SELECT *, {_SPLIT} AS split FROM based)",
         """each AS (
           SELECT user_id, churned AS label, 'formula' AS model, p_raw AS score FROM spl WHERE split = 'test' UNION ALL
           SELECT user_id, churned, 'frequency', 1.0e0 - CAST(rfm_frequency_score AS DOUBLE) / 5.0e0 FROM spl WHERE split = 'test' UNION ALL
           SELECT user_id, churned, 'revenue', 1.0e0 - CAST(rfm_monetary_score AS DOUBLE) / 5.0e0 FROM spl WHERE split = 'test')""",
         "tst AS (SELECT *, CAST(score >= 0.5e0 AS INTEGER) AS prediction FROM each)"]


def _report_sql() -> str:
    return _with_extra(_TEST + [
        """c AS (SELECT model, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
                 count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                 count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
                 count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM tst GROUP BY model)""",
        """m AS (SELECT *,
                 coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS p1,
                 coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS r1,
                 coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0) AS p0,
                 coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0) AS r0,
                 tp + fn AS s1, tn + fp AS s0 FROM c)""",
        """f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1,
                 coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, s0 + s1 AS n FROM m)"""],
        """SELECT model, '0' AS class, CAST(round(CAST(CAST(p0 AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE) AS precision, CAST(round(CAST(CAST(r0 AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE) AS recall, CAST(round(CAST(CAST(f0 AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE) AS f1, s0 AS support FROM f
           UNION ALL SELECT model, '1', CAST(round(CAST(CAST(p1 AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE), CAST(round(CAST(CAST(r1 AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE), CAST(round(CAST(CAST(f1 AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE), s1 FROM f
           UNION ALL SELECT model, 'accuracy', NULL, NULL, CAST(round(CAST(CAST(coalesce(CAST(tp + tn AS DOUBLE) / nullif(n, 0), 0) AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE), n FROM f
           UNION ALL SELECT model, 'macro avg', CAST(round(CAST(CAST((p0 + p1) / 2 AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE), CAST(round(CAST(CAST((r0 + r1) / 2 AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE), CAST(round(CAST(CAST((f0 + f1) / 2 AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE), n FROM f
           UNION ALL SELECT model, 'weighted avg', CAST(round(CAST(CAST(coalesce((p0 * s0 + p1 * s1) / nullif(CAST(n AS DOUBLE), 0), 0) AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE),
                  CAST(round(CAST(CAST(coalesce((r0 * s0 + r1 * s1) / nullif(CAST(n AS DOUBLE), 0), 0) AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE),
                  CAST(round(CAST(CAST(coalesce((f0 * s0 + f1 * s1) / nullif(CAST(n AS DOUBLE), 0), 0) AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE), n FROM f""")


def _questions_cte() -> str:
    return ("q AS (SELECT conv_id, turn, lower(text) AS lq FROM conversations "
            "WHERE role = 'user')")


def _question_filters_sql() -> str:
    src_cases = [f"CASE WHEN regexp_matches(lq, '{pat}') THEN '{name}' END" for pat, name in S.SOURCE_PATTERNS]
    n_src = " + ".join(f"CASE WHEN regexp_matches(lq, '{pat}') THEN 1 ELSE 0 END" for pat, _ in S.SOURCE_PATTERNS)
    age = "CASE " + " ".join(f"WHEN regexp_matches(lq, '{pat}') THEN '{name}'" for pat, name in S.AGE_PATTERNS) + " END"
    return ("WITH " + _questions_cte() + f"""
      SELECT conv_id, turn, concat_ws(',', {', '.join(src_cases)}) AS mentioned_sources,
             regexp_matches(lq, '{S.COMPARISON_PATTERN}') AS is_comparison,
             CASE WHEN ({n_src}) = 1 AND NOT regexp_matches(lq, '{S.COMPARISON_PATTERN}')
                  THEN coalesce({', '.join(src_cases)}) END AS source_filter,
             {age} AS age_filter,
             regexp_matches(lq, '{S.CUSTOMER_PATTERN}') AS wants_customers
      FROM q""")


def _segment_line_sql() -> str:
    return with_chain(f"""
      SELECT risk_tier, age_bucket, gender, traffic_source,
        concat_ws(' | ', risk_tier, age_bucket, gender, traffic_source, CAST(user_count AS VARCHAR),
          printf('%.1f', avg_churn_prob * 100) || '%',
          '$' || format('{{:,}}', CAST(CAST(round(CAST(CAST(coalesce(total_revenue_at_risk, 0) AS VARCHAR) AS DECIMAL(38,18)), 0) AS DOUBLE) AS BIGINT)),
          printf('%.2f', coalesce(avg_orders_per_month, 0)),
          printf('%.1f', avg_return_rate * 100) || '%',
          CAST(one_time_buyers AS VARCHAR)) AS line
      FROM (SELECT * FROM seg ORDER BY {SEG_ORDER} LIMIT {S.TOP_SEGMENTS_LIMIT})""")


def _fixed(x: str, d: int) -> str:
    """Java %.{d}f: half-up on the shortest decimal form, then fixed digits."""
    return f"printf('%.{d}f', {_r(x, d)})"


def _context_sql() -> str:
    src_cases = [f"CASE WHEN regexp_matches(lq, '{pat}') THEN '{name}' END" for pat, name in S.SOURCE_PATTERNS]
    n_src = " + ".join(f"CASE WHEN regexp_matches(lq, '{pat}') THEN 1 ELSE 0 END" for pat, _ in S.SOURCE_PATTERNS)
    age = "CASE " + " ".join(f"WHEN regexp_matches(lq, '{pat}') THEN '{name}'" for pat, name in S.AGE_PATTERNS) + " END"
    nl = "chr(10)"
    line = (f"concat_ws(' | ', risk_tier, age_bucket, gender, traffic_source, CAST(user_count AS VARCHAR), "
            f"{_fixed('avg_churn_prob * 100', 1)} || '%', "
            f"'$' || format('{{:,}}', CAST(round(coalesce(total_revenue_at_risk, 0), 0) AS BIGINT)), "
            f"{_fixed('coalesce(avg_orders_per_month, 0)', 2)}, {_fixed('avg_return_rate * 100', 1)} || '%', "
            f"CAST(one_time_buyers AS VARCHAR))")
    extra = [
        _questions_cte(),
        f"""qf AS (SELECT conv_id, turn,
              CASE WHEN ({n_src}) = 1 AND NOT regexp_matches(lq, '{S.COMPARISON_PATTERN}')
                   THEN coalesce({', '.join(src_cases)}) END AS source_filter,
              {age} AS age_filter, regexp_matches(lq, '{S.CUSTOMER_PATTERN}') AS wants FROM q)""",
        f"segl AS (SELECT *, {line} AS line FROM seg)",
        f"""m AS (SELECT qf.conv_id, qf.turn, segl.line, row_number() OVER (PARTITION BY qf.conv_id, qf.turn
                     ORDER BY {SEG_ORDER}) AS rn
              FROM qf JOIN segl ON (qf.source_filter IS NULL OR segl.traffic_source ILIKE qf.source_filter)
                               AND (qf.age_filter IS NULL OR qf.age_filter = segl.age_bucket))""",
        f"""st AS (SELECT conv_id, turn, '## Segment Summary' || {nl} || '{S.SEGMENT_LINE_HEADER}' || {nl}
                     || '{'-' * S.SEGMENT_LINE_DIVIDER_WIDTH}' || {nl} || string_agg(line, {nl} ORDER BY rn) AS segment_text
              FROM m WHERE rn <= {S.TOP_SEGMENTS_LIMIT} GROUP BY conv_id, turn)""",
        """kpi AS (SELECT h + mm + l AS total, h, mm, l,
                     CASE WHEN h + mm + l > 0 THEN h * 100.0e0 / (h + mm + l) ELSE 0.0e0 END AS pct,
                     CAST(round(CAST(CAST(rev AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS rev
              FROM (SELECT CAST(coalesce(sum(CASE WHEN risk_tier = 'High' THEN user_count END), 0) AS BIGINT) AS h,
                           CAST(coalesce(sum(CASE WHEN risk_tier = 'Medium' THEN user_count END), 0) AS BIGINT) AS mm,
                           CAST(coalesce(sum(CASE WHEN risk_tier = 'Low' THEN user_count END), 0) AS BIGINT) AS l,
                           coalesce(sum(CASE WHEN risk_tier = 'High' THEN coalesce(total_revenue_at_risk, 0) END), 0)
                             AS rev FROM seg))""",
        f"""ov AS (SELECT concat_ws({nl}, '## Overview Stats', '- Total customers: ' || format('{{:,}}', total),
                     '- High risk: ' || format('{{:,}}', h) || ' (' || {_fixed('pct', 1)} || '%)',
                     '- Medium risk: ' || format('{{:,}}', mm), '- Low risk: ' || format('{{:,}}', l),
                     '- Revenue at risk (High tier): $' || {_fixed('rev / 1000000.0e0', 2)} || 'M') AS overview_text
              FROM kpi)""",
        f"""top5 AS (SELECT * FROM view WHERE risk_tier = 'High'
              ORDER BY total_revenue DESC NULLS FIRST, user_id LIMIT {S.TOP_AT_RISK_LIMIT})""",
        f"""ct AS (SELECT '## Top At-Risk Customers (by revenue)' || {nl} || string_agg(
                     '- User ' || CAST(user_id AS VARCHAR) || ': $'
                     || regexp_replace(format('{{:,.3f}}', CAST(coalesce(total_revenue, 0) AS DOUBLE)), '[.]?0+$', '') || ' revenue, '
                     || {_fixed('CAST(churn_probability AS DOUBLE) * 100', 1)} || '% churn prob, '
                     || age_bucket || ' ' || gender || ', ' || traffic_source || ', top drivers: '
                     || top_feature_1 || ', ' || top_feature_2 || ', ' || top_feature_3,
                     {nl} ORDER BY total_revenue DESC, user_id) AS customer_text FROM top5)""",
    ]
    body = (f"SELECT qf.conv_id, qf.turn, concat_ws({nl} || {nl}, ov.overview_text, "
            f"coalesce(st.segment_text, 'No segment data available.'), "
            f"CASE WHEN qf.wants THEN ct.customer_text END) AS context "
            f"FROM qf LEFT JOIN st USING (conv_id, turn) CROSS JOIN ov CROSS JOIN ct")
    return _with_extra(extra, body)


def _merge_sql(old: str, new: str, cols: list[str], dec: set[str]) -> str:
    sel = ["coalesce(n.user_id, o.user_id) AS user_id"]
    for c in cols[1:]:
        e = f"CASE WHEN n.user_id IS NOT NULL THEN n.{c} ELSE o.{c} END"
        sel.append(f"CAST({e} AS DOUBLE) AS {c}" if c in dec else f"{e} AS {c}")
    sel.append("CASE WHEN o.user_id IS NOT NULL THEN 'existing' ELSE 'incoming' END AS loaded_first")
    return with_chain(f"SELECT {', '.join(sel)} FROM {old} o FULL OUTER JOIN {new} n ON o.user_id = n.user_id",
                      snapshot=True)


# the feature table as the planted CSV gives it back, bad cells as 0
_RAW = """raw AS (SELECT * REPLACE (
              CASE WHEN user_id % 41 <> 0 THEN is_us_customer END AS is_us_customer,
              CASE WHEN user_id % 47 = 0 THEN 123456789.5e0 WHEN user_id % 17 = 0 OR user_id % 31 = 0 THEN 0.0e0
                   ELSE CAST(total_revenue AS DOUBLE) END AS total_revenue,
              CASE WHEN user_id % 19 = 0 OR user_id % 29 = 0 THEN 0 ELSE total_orders END AS total_orders,
              CASE WHEN user_id % 23 = 0 OR user_id % 37 = 0 THEN 0.0e0 ELSE orders_per_month END AS orders_per_month,
              CASE WHEN user_id % 43 = 0 THEN 0 ELSE approx_sessions END AS approx_sessions) FROM feat)"""


def _stored_sql(table: str, columns: str, stamp: str, id_order: str) -> str:
    """The table after loads as of 365, 180 and 0 days before the latest order:
    last payload, date of the first load, ids in ``id_order``."""
    ctes = chain("s_", 365) + chain("m_", 180) + chain("") + [
        "loads AS (" + " UNION ALL ".join(f"SELECT {k} AS k, CAST((SELECT ref_ts FROM {p}ref) AS DATE) AS day, * FROM {p}{table}"
                                         for k, p in enumerate(["s_", "m_", ""])) + ")",
        "firsts AS (SELECT user_id, min(k) AS k, min(day) AS day FROM loads GROUP BY user_id)",
        f"ids AS (SELECT user_id, day AS {stamp}, row_number() OVER (ORDER BY {id_order}) AS id FROM firsts)",
        "lasts AS (SELECT * FROM loads QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1)"]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {columns}, {stamp}, id FROM lasts JOIN ids USING (user_id)"


def oracle_sql() -> dict[str, str]:
    score_sel = _dbl(SCORE_COLS, {"churn_probability"})
    pred_cols = ", ".join(S.PREDICTION_COLUMNS)
    age_dom = " UNION ALL ".join(f"SELECT {i} AS position, '{a}' AS age_bucket" for i, a in enumerate(S.AGE_BUCKETS))
    heat = ", ".join(f"CAST(CAST(round(CAST(CAST(avg(CASE WHEN age_bucket = '{a}' THEN churn_probability END) AS VARCHAR) AS DECIMAL(38,18)), 3) AS DOUBLE) AS DOUBLE) AS \"{a}\""
                     for a in S.AGE_BUCKETS)
    q = {
        "feature_base": with_chain(f"SELECT {_FEAT_SELECT} FROM feat"),
        "scan_features": with_chain(f"SELECT {_FEAT_SELECT} FROM feat"),
        "churn_label": with_chain("SELECT user_id, days_since_last_order, churned FROM feat"),
        "buyers": with_chain(f"SELECT {_FEAT_SELECT} FROM buyers"),
        "clean_numeric": with_chain(f"SELECT {_FEAT_SELECT} FROM cleaned"),
        "winsorize": with_chain("SELECT user_id, CAST(total_revenue AS DOUBLE) AS total_revenue, total_events, "
                                "approx_sessions, customer_tenure_days FROM capped"),
        "null_profile": _null_profile_sql(),
        "describe": _describe_sql(),
        "table_profile": with_chain(
            "SELECT position, name AS \"column\", dtype, (SELECT count(*) FROM feat) AS n_rows, "
            f"{len(FEATURE_COLUMNS)} AS n_columns FROM (VALUES "
            + ", ".join(f"({i}, '{f.name}', '{f.dataType.simpleString()}')" for i, f in enumerate(S.FEATURE_SCHEMA.fields))
            + ") t(position, name, dtype)"),
        "csv_rejects": with_chain(" UNION ALL ".join([
            "SELECT user_id, 'total_revenue' AS \"column\", CASE WHEN user_id % 31 = 0 THEN '99999999999999999999' ELSE 'n/a' END AS value, "
            "CASE WHEN user_id % 31 = 0 THEN 'out of range' ELSE 'not a number' END AS cause FROM feat "
            "WHERE (user_id % 17 = 0 OR user_id % 31 = 0) AND user_id % 47 <> 0",
            "SELECT user_id, 'total_orders', CASE WHEN user_id % 29 = 0 THEN '-' ELSE '12.5' END, "
            "CASE WHEN user_id % 29 = 0 THEN 'not a number' ELSE 'not whole' END FROM feat WHERE user_id % 19 = 0 OR user_id % 29 = 0",
            "SELECT user_id, 'orders_per_month', 'NaN', 'not a number' FROM feat WHERE user_id % 23 = 0 AND user_id % 37 <> 0",
            "SELECT user_id, 'is_us_customer', 'maybe', 'not a boolean' FROM feat WHERE user_id % 41 = 0",
            "SELECT user_id, 'approx_sessions', '1e3x', 'not a number' FROM feat WHERE user_id % 43 = 0"])),
        "csv_coerced": _with_extra([_RAW], "SELECT user_id, is_us_customer, total_revenue, total_orders, orders_per_month, approx_sessions FROM raw"),
        "global_rank": with_chain("SELECT user_id, total_orders, row_number() OVER (ORDER BY total_orders, user_id) "
                                  "AS rank, count(*) OVER () AS n_rows FROM cleaned"),
        "rfm_scores": with_chain("SELECT user_id, rfm_frequency_score, rfm_monetary_score, rfm_recency_score FROM eng"),
        "rfm_total": with_chain("SELECT user_id, days_since_last_order, rfm_recency_score, rfm_total FROM eng"),
        "engineered_features": with_chain("SELECT user_id, events_per_order, high_return_flag, one_time_buyer, "
                                          "cancel_rate, revenue_per_day FROM eng"),
        "model_features": with_chain("SELECT " + ", ".join(
            "CAST(total_revenue AS DOUBLE) AS total_revenue" if c == "total_revenue" else c
            for c in MODEL_FEATURES) + " FROM eng"),
        "label_encode": _with_extra([_encoded_cte()], "SELECT user_id, " + ", ".join(
            f"{c}_code AS {c}" for c in ENCODED) + " FROM enc"),
        "adaptive_projection": with_chain("SELECT user_id, " + ", ".join(
            "CAST(total_revenue AS DOUBLE) AS total_revenue" if c == "total_revenue" else c
            for c in S.CLASS_COMPARE_COLUMNS) + ", CAST(0 AS DOUBLE) AS events_per_order FROM cleaned"),
        "predictions": with_chain(f"SELECT {pred_cols} FROM pred"),
        "roundtrip_scores": with_chain(f"SELECT {pred_cols} FROM pred"),
        "risk_tiers": with_chain("SELECT user_id, churn_probability, risk_tier FROM pred"),
        "churn_rate": with_chain(
            "SELECT a.*, b.* FROM (SELECT count(*) AS customers, avg(churned) AS churn_rate, "
            "count(*) FILTER (WHERE is_us_customer) AS us_customers, avg(CAST(is_us_customer AS INTEGER)) AS us_share "
            "FROM feat) a CROSS JOIN (SELECT count(*) AS buyers, avg(churned) AS buyer_churn_rate FROM buyers) b"),
        "churn_by_age": with_chain(
            f", dom AS ({age_dom}), r AS (SELECT age_bucket, avg(churned) AS churn_rate, count(*) AS customers "
            "FROM eng WHERE age_bucket IS NOT NULL GROUP BY age_bucket) "
            "SELECT d.position, d.age_bucket, r.churn_rate, coalesce(r.customers, 0) AS customers "
            "FROM dom d LEFT JOIN r USING (age_bucket)").replace("\n, dom", ", dom"),
        "churn_by_gender": with_chain("SELECT gender, avg(churned) AS churn_rate, count(*) AS customers FROM eng "
                                      "WHERE gender IS NOT NULL GROUP BY gender"),
        "churn_by_source": with_chain("SELECT traffic_source, avg(churned) AS churn_rate, count(*) AS customers "
                                      "FROM eng WHERE traffic_source IS NOT NULL GROUP BY traffic_source"),
        "churn_by_one_time": with_chain("SELECT one_time_buyer, avg(churned) AS churn_rate, count(*) AS customers "
                                        "FROM eng GROUP BY one_time_buyer"),
        "churn_by_freq": with_chain("SELECT rfm_frequency_score, avg(churned) AS churn_rate, count(*) AS customers "
                                    "FROM eng GROUP BY rfm_frequency_score"),
        "churn_by_rpd": _with_extra(
            ["e AS (SELECT quantile_cont(revenue_per_day, [0.2, 0.4, 0.6, 0.8]) AS q FROM eng)",
             "lab AS (SELECT CASE WHEN revenue_per_day IS NULL THEN NULL WHEN revenue_per_day <= q[1] THEN 'Q1' "
             "WHEN revenue_per_day <= q[2] THEN 'Q2' WHEN revenue_per_day <= q[3] THEN 'Q3' "
             "WHEN revenue_per_day <= q[4] THEN 'Q4' ELSE 'Q5' END AS rev_per_day_bucket, churned "
             "FROM eng CROSS JOIN e)"],
            "SELECT rev_per_day_bucket, avg(churned) AS churn_rate, count(*) AS customers FROM lab "
            "WHERE rev_per_day_bucket IS NOT NULL GROUP BY 1"),
        "churn_by_state": with_chain(
            "SELECT state, avg(churned) AS churn_rate, count(*) AS customers FROM eng "
            f"WHERE is_us_customer AND state IS NOT NULL GROUP BY state HAVING count(*) >= {S.STATE_MIN_CUSTOMERS} "
            f"ORDER BY churn_rate DESC, state LIMIT {S.STATE_TOP_N}"),
        "one_time_analysis": with_chain(
            "SELECT *, CAST(one_time_buyers AS DOUBLE) / nullif(buyers, 0) AS one_time_share, "
            "CAST(one_time_churned AS DOUBLE) / nullif(one_time_buyers, 0) AS one_time_churn_share FROM "
            "(SELECT count(*) AS buyers, count(*) FILTER (WHERE total_orders = 1) AS one_time_buyers, "
            "count(*) FILTER (WHERE total_orders = 1 AND churned = 1) AS one_time_churned FROM eng)"),
        "class_comparison": _class_comparison_sql(),
        "corr_matrix": _corr_matrix_sql(),
        "leak_detector": _leak_sql(),
        "hist_orders_month": _hist_sql("orders_per_month", S.HIST_ORDERS_MONTH_CLIP, S.HIST_ORDERS_MONTH_BINS),
        "hist_revenue": _hist_sql("total_revenue", S.HIST_REVENUE_CLIP, S.HIST_REVENUE_BINS),
        "clipped_means": with_chain(
            f"SELECT churned, CAST(round(CAST(CAST(avg(least(orders_per_month, {S.HIST_ORDERS_MONTH_CLIP!r}e0)) AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE) "
            f"AS orders_per_month_clipped, CAST(round(CAST(CAST(avg(least(CAST(total_revenue AS DOUBLE), "
            f"{S.HIST_REVENUE_CLIP!r}e0)) AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE) AS total_revenue_clipped FROM eng GROUP BY churned"),
        "stratified_split": _with_extra(_TEST[:1], "SELECT user_id, churned, split FROM spl"),
        "split_sizes": _with_extra(_TEST[:1], "SELECT split, count(*) AS rows, avg(churned) AS churn_share "
                                              "FROM spl GROUP BY split"),
        "class_balance": _with_extra(_TEST[:1], """
            SELECT negatives, positives, CAST(negatives AS DOUBLE) / nullif(positives, 0) AS pos_weight,
                   CAST(n AS DOUBLE) / nullif(negatives * 2, 0) AS weight_0,
                   CAST(n AS DOUBLE) / nullif(positives * 2, 0) AS weight_1
            FROM (SELECT count(*) FILTER (WHERE churned = 0) AS negatives,
                         count(*) FILTER (WHERE churned = 1) AS positives, count(*) AS n
                  FROM spl WHERE split = 'train')"""),
        "classification_report": _report_sql(),
        "roc_auc": _with_extra(_TEST + [
            "rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score, user_id) AS r FROM tst)",
            "g AS (SELECT model, score, (min(r) + max(r)) / 2.0e0 AS mid_rank, count(*) FILTER (WHERE label = 1) AS pos, "
            "count(*) FILTER (WHERE label = 0) AS neg FROM rk GROUP BY model, score)",
            "t AS (SELECT model, sum(mid_rank * pos) AS rank_sum, CAST(sum(pos) AS BIGINT) AS p, "
            "CAST(sum(neg) AS BIGINT) AS n FROM g GROUP BY model)"],
            "SELECT model, p AS positives, n AS negatives, (rank_sum - p * (p + 1) / 2.0e0) / nullif(CAST(p * n AS DOUBLE), 0) "
            "AS roc_auc FROM t"),
        "roc_curve": _with_extra(_TEST + [
            "g AS (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg "
            "FROM tst GROUP BY model, score)",
            "t AS (SELECT model, sum(pos) AS tp, sum(neg) AS tn FROM g GROUP BY model)"],
            "SELECT model, CAST(score AS DOUBLE) AS threshold, "
            "CAST(sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / tn AS fpr, "
            "CAST(sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / tp AS tpr "
            "FROM g JOIN t USING (model) UNION ALL SELECT model, CAST(NULL AS DOUBLE), 0.0e0, 0.0e0 FROM t"),
        "customers_table": with_chain(f"SELECT {_dbl(CUST_COLS, CUST_DEC)} FROM cust"),
        "risk_scores_table": with_chain(f"SELECT {score_sel} FROM scores"),
        "customer_risk": with_chain(f"SELECT {_dbl(VIEW_COLS, CUST_DEC | {'churn_probability'})} FROM view"),
        "segment_summary": with_chain(f"SELECT {SEG_COLS} FROM seg"),
        "tier_summary": with_chain(
            "SELECT risk_tier, count(*) AS users, CAST(CAST(round(CAST(CAST(avg(churn_probability) AS VARCHAR) AS DECIMAL(38,18)), 3) AS DOUBLE) AS DOUBLE) AS avg_score, "
            "CAST(CAST(round(CAST(CAST(sum(total_revenue) AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS DOUBLE) AS revenue_at_risk FROM view GROUP BY risk_tier "
            "ORDER BY avg_score DESC, risk_tier"),
        "tier_distribution": with_chain(
            "SELECT risk_tier, users, CAST(round(CAST(CAST(users * 100.0e0 / sum(users) OVER () AS VARCHAR) AS DECIMAL(38,18)), 1) AS DOUBLE) AS share_pct, "
            "CAST(CAST(round(CAST(CAST(avg_p * 100 AS VARCHAR) AS DECIMAL(38,18)), 1) AS DOUBLE) AS DOUBLE) AS avg_score_pct FROM (SELECT risk_tier, count(*) AS users, "
            "avg(churn_probability) AS avg_p FROM view GROUP BY risk_tier)"),
        "tier_counts": with_chain("SELECT risk_tier, count(*) AS count FROM pred GROUP BY risk_tier "
                                  "ORDER BY count DESC, risk_tier"),
        "verify_tiers": with_chain(
            "SELECT risk_tier, count(churn_probability) AS count, "
            "CAST(CAST(round(CAST(CAST(avg(churn_probability) AS VARCHAR) AS DECIMAL(38,18)), 3) AS DOUBLE) AS DOUBLE) AS avg_score, "
            "(SELECT count(*) FROM scores) AS total_rows FROM scores GROUP BY risk_tier"),
        "overview_stats": with_chain("""
            SELECT h + m + l AS total_customers, h AS high_risk_count,
                   CASE WHEN h + m + l > 0 THEN h * 100.0e0 / (h + m + l) ELSE 0.0e0 END AS high_risk_pct,
                   m AS medium_risk_count, l AS low_risk_count, CAST(round(CAST(CAST(rev AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS revenue_at_risk
            FROM (SELECT CAST(coalesce(sum(CASE WHEN risk_tier = 'High' THEN user_count END), 0) AS BIGINT) AS h,
                         CAST(coalesce(sum(CASE WHEN risk_tier = 'Medium' THEN user_count END), 0) AS BIGINT) AS m,
                         CAST(coalesce(sum(CASE WHEN risk_tier = 'Low' THEN user_count END), 0) AS BIGINT) AS l,
                         coalesce(sum(CASE WHEN risk_tier = 'High' THEN coalesce(total_revenue_at_risk, 0) END), 0)
                           AS rev
                  FROM seg)"""),
        "top_segments": with_chain(f"SELECT {SEG_COLS} FROM seg ORDER BY {SEG_ORDER} LIMIT {S.TOP_SEGMENTS_LIMIT}"),
        "segments_by_source": with_chain(
            f"SELECT {SEG_COLS} FROM seg WHERE traffic_source ILIKE 'facebook' ORDER BY {SEG_ORDER} "
            f"LIMIT {S.TOP_SEGMENTS_LIMIT}"),
        "segments_filtered": with_chain(
            f"SELECT {SEG_COLS} FROM seg WHERE traffic_source ILIKE 'EMAIL' AND age_bucket = '25-34' "
            f"ORDER BY {SEG_ORDER} LIMIT {S.TOP_SEGMENTS_LIMIT}"),
        "top_at_risk": with_chain(
            "SELECT user_id, CAST(churn_probability AS DOUBLE) AS churn_probability, risk_tier, "
            "CAST(total_revenue AS DOUBLE) AS total_revenue, age_bucket, gender, traffic_source, total_orders, "
            "top_feature_1, top_feature_2, top_feature_3 FROM view WHERE risk_tier = 'High' "
            f"ORDER BY total_revenue DESC NULLS FIRST, user_id LIMIT {S.TOP_AT_RISK_LIMIT}"),
        "segment_heatmap": with_chain(f"SELECT traffic_source, {heat} FROM view GROUP BY traffic_source"),
        "distinct_sources": with_chain("SELECT DISTINCT traffic_source FROM seg"),
        "question_filters": _question_filters_sql(),
        "segment_lines": _segment_line_sql(),
        "context_block": _context_sql(),
        "recent_turns": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER "
                        f"(PARTITION BY conv_id ORDER BY turn DESC, role, text) AS rn FROM conversations) WHERE rn <= {S.RECENT_TURNS}",
        "upsert_customers": _merge_sql("s_cust", "cust", CUST_COLS, CUST_DEC),
        "upsert_scores": _merge_sql("s_scores", "scores", SCORE_COLS, {"churn_probability"}),
        "stored_customers": _stored_sql("cust", _dbl(CUST_COLS, CUST_DEC), "created_at", "k, user_id"),
        "stored_scores": _stored_sql("scores", score_sel, "scored_at", "user_id"),
        "incremental_segments": with_chain(f"SELECT {SEG_COLS} FROM seg"),
        "missing_scores": with_chain("SELECT DISTINCT user_id FROM cust WHERE user_id NOT IN "
                                     "(SELECT user_id FROM s_scores)", snapshot=True),
        "backfill_rows": with_chain(f"SELECT {score_sel} FROM scores WHERE user_id IN (SELECT user_id FROM cust "
                                    "EXCEPT SELECT user_id FROM s_scores)", snapshot=True),
        "backfill_merge": with_chain(
            f"SELECT {score_sel} FROM s_scores UNION ALL SELECT {score_sel} FROM scores WHERE user_id IN "
            "(SELECT user_id FROM cust EXCEPT SELECT user_id FROM s_scores)", snapshot=True),
        "fk_orphans": with_chain(f"SELECT {score_sel} FROM scores WHERE user_id NOT IN (SELECT user_id FROM s_cust)",
                                 snapshot=True),
        "cascade_delete": with_chain(f"SELECT {score_sel} FROM scores WHERE user_id IN (SELECT user_id FROM s_cust)",
                                     snapshot=True),
        "duplicate_keys": with_chain(
            "SELECT user_id, count(*) AS n_rows FROM (SELECT user_id FROM s_scores UNION ALL "
            "SELECT user_id FROM scores) GROUP BY user_id HAVING count(*) > 1", snapshot=True),
        "check_violations": with_chain(
            f"SELECT {score_sel.replace('risk_tier', 'lower(risk_tier) AS risk_tier')} FROM scores WHERE user_id % 13 = 0 AND user_id % 17 <> 0"),
        "precision_violations": _with_extra([_RAW], " UNION ALL ".join(
            f"SELECT user_id, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM raw "
            f"WHERE total_orders >= 1 AND {c} IS NOT NULL AND TRY_CAST(round({c}, {s}) AS DECIMAL({p},{s})) IS NULL"
            for c, (p, s) in S.CUSTOMER_DECIMALS.items())),
    }
    q["incremental_tiers"], q["incremental_overview"] = q["tier_summary"], q["overview_stats"]
    feats_enc = [f"{c}_code" if c in ENCODED else c for c in MODEL_FEATURES]
    stats = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{i}, stddev_pop(CAST({f} AS DOUBLE)) AS s_{i}"
                      for i, f in enumerate(feats_enc))
    zs = ", ".join(f"CAST(round(CAST(CAST(coalesce((CAST({f} AS DOUBLE) - m_{i}) / nullif(s_{i}, 0), 0) AS VARCHAR) AS DECIMAL(38,18)), 6) AS DOUBLE) AS {c}"
                   for i, (c, f) in enumerate(zip(MODEL_FEATURES, feats_enc)))
    q["scaled_features"] = _with_extra(
        [_encoded_cte(), f"sp AS (SELECT *, {_SPLIT} AS split FROM enc)",
         f"st AS (SELECT {stats} FROM sp WHERE split = 'train')"],
        f"SELECT user_id, split, {zs} FROM sp CROSS JOIN st")
    return q
