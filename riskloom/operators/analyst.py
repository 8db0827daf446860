"""Analyst queries over the served view: segment / tier roll-ups, KPIs,
top-k, heatmap, question parsing and the text context built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import schemas as S
from riskloom.functions import exprs as X

SEGMENT_KEYS = ["risk_tier", "age_bucket", "gender", "traffic_source"]


def segment_summary(view: DataFrame) -> DataFrame:
    """4-key segment roll-up with 7 measures (null keys form their own group)."""
    return (view.groupBy(*SEGMENT_KEYS)
            .agg(F.count(F.lit(1)).alias("user_count"),
                 X.round_double(F.avg("churn_probability"), 3).alias("avg_churn_prob"),
                 X.round_double(F.sum("total_revenue"), 2).alias("total_revenue_at_risk"),
                 X.round_double(F.avg("total_orders"), 1).alias("avg_orders"),
                 X.round_double(F.avg("orders_per_month"), 2).alias("avg_orders_per_month"),
                 X.round_double(F.avg("return_rate"), 3).alias("avg_return_rate"),
                 F.sum(F.when(F.col("one_time_buyer"), 1).otherwise(0)).alias("one_time_buyers")))


def tier_summary(view: DataFrame) -> DataFrame:
    """Users, average score and revenue per tier, by average score desc."""
    return (view.groupBy("risk_tier")
            .agg(F.count(F.lit(1)).alias("users"),
                 X.round_double(F.avg("churn_probability"), 3).alias("avg_score"),
                 X.round_double(F.sum("total_revenue"), 2).alias("revenue_at_risk"))
            .orderBy(F.col("avg_score").desc(), F.col("risk_tier")))


def tier_distribution(view: DataFrame) -> DataFrame:
    """Dashboard tier view: count, share of all scored, average score in %."""
    total = F.sum("users").over(Window.partitionBy())  # over <= 3 tier rows
    t = view.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("users"),
                                      F.avg("churn_probability").alias("avg_p"))
    return t.select("risk_tier", "users",
                    X.round_double(F.col("users") * 100.0 / total, 1).alias("share_pct"),
                    X.round_double(F.col("avg_p") * 100, 1).alias("avg_score_pct"))


def tier_counts(predictions: DataFrame) -> DataFrame:
    """value_counts of risk_tier, descending."""
    return (predictions.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("risk_tier")))


def verify_tiers(scores: DataFrame) -> DataFrame:
    """Load check: non-null scores and mean per tier, plus the exact table count.
    One pass: the table count is the sum of the per-tier row counts, taken
    over the few tier rows (the tier domain plus a null group)."""
    per = scores.groupBy("risk_tier").agg(
        F.count("churn_probability").alias("count"),
        X.round_double(F.avg("churn_probability"), 3).alias("avg_score"),
        F.count(F.lit(1)).alias("_rows"))
    return (per.withColumn("total_rows", F.sum("_rows").over(Window.partitionBy()))
            .drop("_rows"))


def overview_stats(segments: DataFrame) -> DataFrame:
    """KPIs rolled up from the segment summary (not from raw rows): counts
    per tier, High share in %, High-tier revenue.  Unknown tiers are ignored;
    an empty input gives zeros, never an error."""
    tier = F.col("risk_tier")
    cnt = F.coalesce(F.col("user_count"), F.lit(0))
    k = segments.agg(
        F.coalesce(F.sum(F.when(tier == "High", cnt)), F.lit(0)).alias("high_risk_count"),
        F.coalesce(F.sum(F.when(tier == "Medium", cnt)), F.lit(0)).alias("medium_risk_count"),
        F.coalesce(F.sum(F.when(tier == "Low", cnt)), F.lit(0)).alias("low_risk_count"),
        F.coalesce(F.sum(F.when(tier == "High", F.coalesce(F.col("total_revenue_at_risk"), F.lit(0.0)))),
                   F.lit(0.0)).alias("revenue_at_risk"))
    total = F.col("high_risk_count") + F.col("medium_risk_count") + F.col("low_risk_count")
    return k.select(
        total.cast("long").alias("total_customers"),
        F.col("high_risk_count").cast("long").alias("high_risk_count"),
        F.when(total > 0, F.col("high_risk_count") * 100.0 / total).otherwise(F.lit(0.0)).alias("high_risk_pct"),
        F.col("medium_risk_count").cast("long").alias("medium_risk_count"),
        F.col("low_risk_count").cast("long").alias("low_risk_count"),
        F.round(F.col("revenue_at_risk"), 2).cast("double").alias("revenue_at_risk"))


def _segment_order():
    return [F.col("total_revenue_at_risk").desc_nulls_first()] + [F.col(c).asc_nulls_first() for c in SEGMENT_KEYS]


def filter_segments(segments: DataFrame, traffic_source: str | None = None,
                    age_bucket: str | None = None) -> DataFrame:
    """Optional filters, AND-ed, applied before the limit: source by ilike
    (case-insensitive, % and _ act as wildcards), age by equality."""
    out = segments
    if traffic_source:
        out = out.where(F.col("traffic_source").ilike(traffic_source))
    if age_bucket:
        out = out.where(F.col("age_bucket") == age_bucket)
    return out


def top_segments(segments: DataFrame, traffic_source: str | None = None,
                 age_bucket: str | None = None, limit: int = S.TOP_SEGMENTS_LIMIT) -> DataFrame:
    """Top segments by revenue at risk (descending puts nulls first, as the
    served database does; ties broken on the segment keys)."""
    return filter_segments(segments, traffic_source, age_bucket).orderBy(*_segment_order()).limit(limit)


def top_at_risk(view: DataFrame, limit: int = S.TOP_AT_RISK_LIMIT) -> DataFrame:
    """High-tier customers with the most revenue (TakeOrderedAndProject)."""
    return (view.where(F.col("risk_tier") == "High")
            .select("user_id", "churn_probability", "risk_tier", "total_revenue", "age_bucket",
                    "gender", "traffic_source", "total_orders", "top_feature_1", "top_feature_2",
                    "top_feature_3")
            .orderBy(F.col("total_revenue").desc_nulls_first(), F.col("user_id"))
            .limit(limit))


def segment_heatmap(view: DataFrame) -> DataFrame:
    """traffic_source x age_bucket average churn score (explicit pivot values,
    so no extra distinct job)."""
    return (view.groupBy("traffic_source").pivot("age_bucket", S.AGE_BUCKETS)
            .agg(X.round_double(F.avg("churn_probability"), 3)))


def distinct_sources(segments: DataFrame) -> DataFrame:
    return segments.select("traffic_source").distinct()


# ---------------------------------------------------------------------------
# questions -> filters -> context text
# ---------------------------------------------------------------------------
def question_filters(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """Per question: lower-cased text, mentioned sources, comparison flag, the
    single source filter (only if exactly one source and no comparison), the
    first matching age bucket, and whether customers are asked for."""
    q = F.lower(F.col(text_col))
    mentioned = F.filter(F.array(*[F.when(q.rlike(pat), F.lit(name)) for pat, name in S.SOURCE_PATTERNS]),
                         lambda x: x.isNotNull())
    age = None
    for pat, name in S.AGE_PATTERNS:
        age = F.when(q.rlike(pat), F.lit(name)) if age is None else age.when(q.rlike(pat), F.lit(name))
    return (questions
            .withColumn("mentioned_sources", mentioned)
            .withColumn("is_comparison", q.rlike(S.COMPARISON_PATTERN))
            .withColumn("source_filter", F.when((F.size("mentioned_sources") == 1) & ~F.col("is_comparison"),
                                                F.col("mentioned_sources").getItem(0)))
            .withColumn("age_filter", age.otherwise(F.lit(None).cast("string")))
            .withColumn("wants_customers", q.rlike(S.CUSTOMER_PATTERN)))


def segment_line(segments: DataFrame) -> F.Column:
    """One ' | '-joined text row per segment, formatted like the chat context."""
    def pct(c):
        return F.concat(X.js_fixed(F.col(c) * 100, 1), F.lit("%"))
    fields = [
        F.col("risk_tier"), F.col("age_bucket"), F.col("gender"), F.col("traffic_source"),
        F.col("user_count").cast("string"), pct("avg_churn_prob"),
        F.concat(F.lit("$"), X.js_grouped_int(F.coalesce(F.col("total_revenue_at_risk"), F.lit(0.0)))),
        X.js_fixed(F.coalesce(F.col("avg_orders_per_month"), F.lit(0.0)), 2),
        pct("avg_return_rate"), F.col("one_time_buyers").cast("string")]
    return F.concat_ws(" | ", *[F.coalesce(f, F.lit("")) for f in fields])  # a null field stays, empty


def overview_text(kpi: DataFrame) -> DataFrame:
    """The overview block as one text column."""
    return kpi.select(F.concat_ws(
        "\n", F.lit("## Overview Stats"),
        F.concat(F.lit("- Total customers: "), F.format_number("total_customers", 0)),
        F.concat(F.lit("- High risk: "), F.format_number("high_risk_count", 0), F.lit(" ("),
                 X.js_fixed("high_risk_pct", 1), F.lit("%)")),
        F.concat(F.lit("- Medium risk: "), F.format_number("medium_risk_count", 0)),
        F.concat(F.lit("- Low risk: "), F.format_number("low_risk_count", 0)),
        F.concat(F.lit("- Revenue at risk (High tier): $"),
                 X.js_fixed(F.col("revenue_at_risk") / 1000000.0, 2), F.lit("M")),
    ).alias("overview_text"))


def grouped_number(value: F.Column) -> F.Column:
    """Thousands separators and at most three decimals, none for a whole number."""
    return F.regexp_replace(F.format_number(value, 3), r"\.?0+$", "")


def customer_line() -> F.Column:
    """One line per customer; a null field is printed as ``null``."""
    def shown(c):
        return F.coalesce(F.col(c), F.lit("null"))
    return F.concat(
        F.lit("- User "), F.col("user_id").cast("string"), F.lit(": $"),
        grouped_number(F.coalesce(F.col("total_revenue").cast("double"), F.lit(0.0))), F.lit(" revenue, "),
        X.js_fixed(F.coalesce(F.col("churn_probability"), F.lit(0)) * 100, 1), F.lit("% churn prob, "),
        shown("age_bucket"), F.lit(" "), shown("gender"), F.lit(", "), shown("traffic_source"),
        F.lit(", top drivers: "), shown("top_feature_1"), F.lit(", "), shown("top_feature_2"),
        F.lit(", "), shown("top_feature_3"))


def context_blocks(questions: DataFrame, segments: DataFrame, view: DataFrame,
                   keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Per question, the data context text: overview, the question's top
    segments (its own filters, limit 20) and, when asked for, the top
    at-risk customers; empty blocks are skipped, blocks joined by a blank line.

    Questions only differ by their (source, age) filter pair, whose values
    come from fixed lists, so the segment block is built once per distinct
    pair (a table bounded by that domain, broadcast) and attached to each
    question by a null-safe equi-join -- no question x segment pairs.
    """
    qf = question_filters(questions)
    seg = segments.withColumn("line", segment_line(segments))
    combos = qf.select("source_filter", "age_filter").distinct()
    # a segment answers four filter pairs: its own source or any, its own age or any
    nothing = F.lit(None).cast("string")
    answers = F.array(*[F.struct(s.alias("s"), a.alias("a")) for s in (nothing, F.lower("traffic_source"))
                        for a in (nothing, F.col("age_bucket"))])
    spread = seg.withColumn("_p", F.explode(F.array_distinct(answers)))
    m = combos.join(spread, F.lower("source_filter").eqNullSafe(F.col("_p.s")) & F.col("age_filter").eqNullSafe(F.col("_p.a"))).drop("_p")
    w = Window.partitionBy("source_filter", "age_filter").orderBy(*_segment_order())
    top = m.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= S.TOP_SEGMENTS_LIMIT)
    seg_text = (top.groupBy("source_filter", "age_filter")
                .agg(F.array_sort(F.collect_list(F.struct("rn", "line"))).alias("ls"))  # <= 20 lines
                .select(F.col("source_filter").alias("sf"), F.col("age_filter").alias("af"),
                        F.concat_ws("\n", F.lit("## Segment Summary"), F.lit(S.SEGMENT_LINE_HEADER),
                                    F.lit("-" * S.SEGMENT_LINE_DIVIDER_WIDTH),
                                    F.array_join(F.transform("ls", lambda s: s["line"]), "\n"))
                        .alias("segment_text")))
    cust = top_at_risk(view)
    cust_text = (cust.select(F.struct(F.col("total_revenue").cast("double").alias("r"),
                                      (-F.col("user_id")).alias("u"), customer_line().alias("line")).alias("s"))
                 .agg(F.sort_array(F.collect_list("s"), asc=False).alias("ls"))  # <= 5 lines
                 .select(F.when(F.size("ls") > 0, F.concat(F.lit("## Top At-Risk Customers (by revenue)\n"),
                                  F.array_join(F.transform("ls", lambda s: s["line"]), "\n"))).alias("customer_text")))
    overview = overview_text(overview_stats(segments))
    joined = qf.select(*keys, "source_filter", "age_filter", "wants_customers").join(
        seg_text,
        F.col("source_filter").eqNullSafe(F.col("sf")) & F.col("age_filter").eqNullSafe(F.col("af")), "left")
    out = X.with_row_values(X.with_row_values(joined, overview), cust_text)
    no_seg = F.lit("No segment data available.")
    return out.select(
        *keys,
        F.concat_ws("\n\n", F.col("overview_text"), F.coalesce(F.col("segment_text"), no_seg),
                    F.when(F.col("wants_customers"), F.col("customer_text"))).alias("context"))


def recent_turns(conversations: DataFrame, n: int = S.RECENT_TURNS) -> DataFrame:
    """Last n messages of every conversation (all of them when shorter);
    messages of one turn by role, then text.
    row_number <= n is planned as a window group limit, so each task keeps
    only its n latest rows per conversation before the shuffle."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), "role", "text")
    return (conversations.withColumn("rn", F.row_number().over(w))
            .where(F.col("rn") <= n).drop("rn"))
