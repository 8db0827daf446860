"""Named queries: each takes (spark, data_dir) and returns a DataFrame built
from the raw tables of that directory.  Decimal measures are presented as
double at the output edge only (the tables themselves keep DECIMAL)."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import schemas as S
from riskloom.operators import analyst, clean, eda, engineer, evaluate, features, rollup, store
from riskloom.plans import scoring
from riskloom.session import materialize, scratch_path
from riskloom.sources.keyed_store import KeyedTable
from riskloom.sources.tables import RawTables, read_table, scan_with_rejects, write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SNAPSHOT_LAG_DAYS = 365  # the "existing" served tables are one year older


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def decimals_as_double(df: DataFrame) -> DataFrame:
    return df.select([F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                      else F.col(f.name) for f in df.schema.fields])


def _t(spark: SparkSession, d: str) -> RawTables:
    return scoring.tables(spark, d)


# ----------------------------------------------------------------- features
@query("feature_base")
def q_feature_base(spark, d):
    return decimals_as_double(features.feature_base(_t(spark, d)))


@query("churn_label")
def q_churn_label(spark, d):
    return features.feature_base(_t(spark, d)).select("user_id", "days_since_last_order", "churned")


@query("buyers")
def q_buyers(spark, d):
    return decimals_as_double(features.buyers(features.feature_base(_t(spark, d))))


@query("scan_features")
def q_scan_features(spark, d):
    """Write the feature table as CSV (header) and scan it back with the
    declared schema: no inference pass."""
    path = scratch_path(spark, "features-csv")
    write_table(features.feature_base(_t(spark, d)), path, fmt="csv")
    return decimals_as_double(read_table(spark, path, S.FEATURE_SCHEMA, fmt="csv"))


def _raw_csv(spark, d):
    """The feature table as a raw CSV export with bad cells: by user_id some
    numbers are text, fractions in a whole column, too large, or missing."""
    fb = features.feature_base(_t(spark, d))
    def bad(c, *cases):
        text = F.col(c).cast("string")
        for n, v in cases:
            text = F.when(F.pmod(F.col("user_id"), F.lit(n)) == 0, F.lit(v)).otherwise(text)
        return text.alias(c)
    planted = {"total_revenue": [(17, "n/a"), (31, "99999999999999999999"), (47, "123456789.50")], "total_orders": [(19, "12.5"), (29, " - ")],
               "orders_per_month": [(23, "NaN"), (37, "")], "is_us_customer": [(41, "maybe")], "approx_sessions": [(43, "1e3x")]}
    path = scratch_path(spark, "raw-csv")
    write_table(fb.select([bad(c, *planted[c]) if c in planted else F.col(c) for c in fb.columns]), path, fmt="csv")
    return scan_with_rejects(spark, path, S.FEATURE_SCHEMA, "user_id")


@query("csv_rejects")
def q_csv_rejects(spark, d):
    """Every bad cell of a raw CSV: its row's key, column, text and cause."""
    _, rejects = _raw_csv(spark, d)
    return rejects.select(F.col("key").cast("long").alias("user_id"), "column", F.trim("value").alias("value"), "cause")


@query("csv_coerced")
def q_csv_coerced(spark, d):
    """The same raw CSV cleaned: bad and missing numbers count as 0."""
    rows, _ = _raw_csv(spark, d)
    cleaned = decimals_as_double(clean.clean_numeric(rows))
    return cleaned.select("user_id", "is_us_customer", "total_revenue", "total_orders", "orders_per_month", "approx_sessions")


@query("clean_numeric")
def q_clean_numeric(spark, d):
    return decimals_as_double(scoring.cleaned_buyers(_t(spark, d), materialize=False))


@query("winsorize")
def q_winsorize(spark, d):
    capped = clean.winsorize(scoring.cleaned_buyers(_t(spark, d)))
    return decimals_as_double(capped.select("user_id", *S.CAP_COLUMNS))


@query("null_profile")
def q_null_profile(spark, d):
    return clean.null_profile(clean.winsorize(scoring.cleaned_buyers(_t(spark, d))))


@query("describe")
def q_describe(spark, d):
    fb = features.feature_base(_t(spark, d))
    cols = [f.name for f in fb.schema.fields
            if isinstance(f.dataType, (T.LongType, T.IntegerType, T.DoubleType, T.DecimalType))]
    return clean.describe(fb, cols)


@query("table_profile")
def q_table_profile(spark, d):
    """Shape and column types: one row per column."""
    return clean.table_profile(features.feature_base(_t(spark, d)))


# ------------------------------------------------------------ ranks, scores
@query("global_rank")
def q_global_rank(spark, d):
    from riskloom.operators.rank import global_rank
    return global_rank(scoring.cleaned_buyers(_t(spark, d)), "user_id", "total_orders")


def _prepared(spark, d, with_recency=True):
    return scoring.prepared_buyers(_t(spark, d), with_recency=with_recency)


@query("rfm_scores")
def q_rfm_scores(spark, d):
    return _prepared(spark, d).select("user_id", "rfm_frequency_score", "rfm_monetary_score", "rfm_recency_score")


@query("rfm_total")
def q_rfm_total(spark, d):
    return _prepared(spark, d).select("user_id", "days_since_last_order", "rfm_recency_score", "rfm_total")


@query("engineered_features")
def q_engineered(spark, d):
    return _prepared(spark, d, False).select("user_id", "events_per_order", "high_return_flag",
                                             "one_time_buyer", "cancel_rate", "revenue_per_day")


@query("model_features")
def q_model_features(spark, d):
    return decimals_as_double(engineer.model_features(_prepared(spark, d)))


@query("label_encode")
def q_label_encode(spark, d):
    p = _prepared(spark, d, False)
    cols = engineer.string_columns(engineer.model_features(p))
    return engineer.label_encode(p.select("user_id", *cols), cols, suffix="")


@query("adaptive_projection")
def q_adaptive(spark, d):
    wanted = [("user_id", None)] + [(c, 0.0) for c in S.CLASS_COMPARE_COLUMNS] + [("events_per_order", 0.0)]
    return decimals_as_double(engineer.adaptive_projection(scoring.cleaned_buyers(_t(spark, d), False), wanted))


@query("predictions")
def q_predictions(spark, d):
    return scoring.predictions(_t(spark, d))


@query("risk_tiers")
def q_risk_tiers(spark, d):
    return scoring.predictions(_t(spark, d)).select("user_id", "churn_probability", "risk_tier")


# ---------------------------------------------------------------------- EDA
@query("churn_rate")
def q_churn_rate(spark, d):
    fb = features.feature_base(_t(spark, d))
    return eda.churn_rate(fb, features.is_buyer())


@query("churn_by_age")
def q_churn_by_age(spark, d):
    return eda.churn_by_domain(scoring.cleaned_buyers(_t(spark, d), False), "age_bucket", S.AGE_BUCKETS)


@query("churn_by_gender")
def q_churn_by_gender(spark, d):
    return eda.churn_by(scoring.cleaned_buyers(_t(spark, d), False), "gender")


@query("churn_by_source")
def q_churn_by_source(spark, d):
    return eda.churn_by(scoring.cleaned_buyers(_t(spark, d), False), "traffic_source").orderBy("churn_rate", "traffic_source")


@query("churn_by_one_time")
def q_churn_by_one_time(spark, d):
    return eda.churn_by(_prepared(spark, d, False), "one_time_buyer")


@query("churn_by_freq")
def q_churn_by_freq(spark, d):
    return eda.churn_by(_prepared(spark, d, False), "rfm_frequency_score")


@query("churn_by_rpd")
def q_churn_by_rpd(spark, d):
    return eda.churn_by_rpd(_prepared(spark, d, False))


@query("churn_by_state")
def q_churn_by_state(spark, d):
    return eda.churn_by_state(scoring.cleaned_buyers(_t(spark, d), False))


@query("one_time_analysis")
def q_one_time(spark, d):
    return eda.one_time_analysis(_prepared(spark, d, False))


@query("class_comparison")
def q_class_comparison(spark, d):
    return eda.class_comparison(scoring.cleaned_buyers(_t(spark, d), False))


@query("corr_matrix")
def q_corr_matrix(spark, d):
    return eda.corr_matrix(scoring.cleaned_buyers(_t(spark, d), False))


@query("leak_detector")
def q_leak_detector(spark, d):
    p = _prepared(spark, d)
    feats = S.model_feature_columns(p.columns)
    enc = engineer.label_encode(p.select(*feats, "churned"), engineer.string_columns(p, feats))
    return eda.leak_detector(enc, feats)


@query("hist_orders_month")
def q_hist_opm(spark, d):
    return eda.histogram(_prepared(spark, d, False), "orders_per_month", S.HIST_ORDERS_MONTH_CLIP,
                         S.HIST_ORDERS_MONTH_BINS)


@query("hist_revenue")
def q_hist_revenue(spark, d):
    return eda.histogram(_prepared(spark, d, False), "total_revenue", S.HIST_REVENUE_CLIP, S.HIST_REVENUE_BINS)


@query("clipped_means")
def q_clipped_means(spark, d):
    return eda.clipped_means(_prepared(spark, d, False))


# --------------------------------------------------------------- evaluation
def _split(spark, d):
    return evaluate.stratified_split(scoring.with_base_score(_prepared(spark, d, False)))


def _test_scored(spark, d):
    """user_id, label, model, score and prediction of the hold-out rows under
    three fixed scorers: the score formula, order frequency alone, revenue alone."""
    s = _split(spark, d).where(F.col("split") == "test")
    fixed = [("formula", scoring.base_probability_column()),
             ("frequency", F.lit(1.0) - F.col("rfm_frequency_score").cast("double") / F.lit(5.0)),
             ("revenue", F.lit(1.0) - F.col("rfm_monetary_score").cast("double") / F.lit(5.0))]
    each = F.array(*[F.struct(F.lit(name).alias("model"), p.alias("score")) for name, p in fixed])
    rows = s.select("user_id", F.col("churned").alias("label"), F.explode(each).alias("m"))
    return rows.select("user_id", "label", "m.model", "m.score", (F.col("m.score") >= 0.5).cast("int").alias("prediction"))


@query("stratified_split")
def q_split(spark, d):
    return _split(spark, d).select("user_id", "churned", "split")


@query("split_sizes")
def q_split_sizes(spark, d):
    return evaluate.split_sizes(_split(spark, d))


@query("class_balance")
def q_class_balance(spark, d):
    return evaluate.class_balance(_split(spark, d).where(F.col("split") == "train"))


@query("classification_report")
def q_classification_report(spark, d):
    return evaluate.classification_report(_test_scored(spark, d), by=["model"])


@query("roc_auc")
def q_roc_auc(spark, d):
    return evaluate.roc_auc(_test_scored(spark, d), by=["model"])


@query("roc_curve")
def q_roc_curve(spark, d):
    return evaluate.roc_curve(_test_scored(spark, d), by="model")


# ------------------------------------------------------------ served tables
def served(t: RawTables):
    """(customers, risk_scores) payload tables of one scoring run."""
    # both tables are projections of the scored rows: these are written once
    scored = materialize(scoring.with_base_score(scoring.prepared_buyers(t, with_recency=False)), "scored")
    customers = store.customers_table(scored, with_created_at=False)
    scores = store.risk_scores_table(scoring.predictions_from(scored), with_defaults=False)
    return customers, scores


def served_view(t: RawTables) -> DataFrame:
    c, s = served(t)
    return store.customer_risk(c, s)


def _segments(spark, d):
    return analyst.segment_summary(served_view(_t(spark, d)))


@query("customers_table")
def q_customers_table(spark, d):
    return decimals_as_double(served(_t(spark, d))[0])


@query("risk_scores_table")
def q_risk_scores_table(spark, d):
    return decimals_as_double(served(_t(spark, d))[1])


@query("customer_risk")
def q_customer_risk(spark, d):
    return decimals_as_double(served_view(_t(spark, d)))


@query("segment_summary")
def q_segment_summary(spark, d):
    return _segments(spark, d)


@query("tier_summary")
def q_tier_summary(spark, d):
    return analyst.tier_summary(served_view(_t(spark, d)))


@query("tier_distribution")
def q_tier_distribution(spark, d):
    return analyst.tier_distribution(served_view(_t(spark, d)))


@query("tier_counts")
def q_tier_counts(spark, d):
    return analyst.tier_counts(scoring.predictions(_t(spark, d)))


@query("verify_tiers")
def q_verify_tiers(spark, d):
    return decimals_as_double(analyst.verify_tiers(served(_t(spark, d))[1]))


@query("overview_stats")
def q_overview(spark, d):
    return analyst.overview_stats(_segments(spark, d))


@query("top_segments")
def q_top_segments(spark, d):
    return analyst.top_segments(_segments(spark, d))


@query("segments_by_source")
def q_segments_by_source(spark, d):
    return analyst.top_segments(_segments(spark, d), traffic_source="facebook")


@query("segments_filtered")
def q_segments_filtered(spark, d):
    return analyst.top_segments(_segments(spark, d), traffic_source="EMAIL", age_bucket="25-34")


@query("top_at_risk")
def q_top_at_risk(spark, d):
    return decimals_as_double(analyst.top_at_risk(served_view(_t(spark, d))))


@query("segment_heatmap")
def q_heatmap(spark, d):
    return analyst.segment_heatmap(served_view(_t(spark, d)))


@query("distinct_sources")
def q_distinct_sources(spark, d):
    return analyst.distinct_sources(_segments(spark, d))


def _questions(spark, d):
    """Analyst questions = the user turns of the conversations table."""
    c = _t(spark, d).conversations
    return c.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"))


@query("question_filters")
def q_question_filters(spark, d):
    qf = analyst.question_filters(_questions(spark, d))
    return qf.select("conv_id", "turn", F.array_join("mentioned_sources", ",").alias("mentioned_sources"),
                     "is_comparison", "source_filter", "age_filter", "wants_customers")


@query("segment_lines")
def q_segment_lines(spark, d):
    top = analyst.top_segments(_segments(spark, d))
    return top.select("risk_tier", "age_bucket", "gender", "traffic_source",
                      analyst.segment_line(top).alias("line"))


@query("context_block")
def q_context_block(spark, d):
    t = _t(spark, d)
    view = served_view(t)
    return analyst.context_blocks(_questions(spark, d), analyst.segment_summary(view), decimals_as_double(view))


@query("recent_turns")
def q_recent_turns(spark, d):
    return analyst.recent_turns(_t(spark, d).conversations)


# -------------------------------------------------- merge, backfill, checks
def _existing_and_incoming(spark, d):
    """Served tables of the one-year-older run (existing) and of the current
    run (incoming).  The two runs share one pass over the fact tables and are
    otherwise independent, so they are built from two threads: their jobs
    (writes, sorts, count collects) run side by side on the cluster instead
    of one after the other.  Thread-local job properties are inherited."""
    t = features.share_order_facts(_t(spark, d), [SNAPSHOT_LAG_DAYS, 0])
    build = inheritable_thread_target(spark)(served)
    with ThreadPoolExecutor(max_workers=2) as pool:
        existing = pool.submit(build, t.snapshot(SNAPSHOT_LAG_DAYS))
        incoming = pool.submit(build, t)
        return existing.result(), incoming.result()


@query("upsert_customers")
def q_upsert_customers(spark, d):
    (old_c, _), (new_c, _) = _existing_and_incoming(spark, d)
    old_c = old_c.withColumn("loaded_first", F.lit("existing"))
    merged = store.merge(old_c, new_c, "user_id", S.CUSTOMER_PAYLOAD,
                         defaults={"loaded_first": F.lit("incoming")})
    return decimals_as_double(merged)


@query("upsert_scores")
def q_upsert_scores(spark, d):
    (_, old_s), (_, new_s) = _existing_and_incoming(spark, d)
    old_s = old_s.withColumn("loaded_first", F.lit("existing"))
    merged = store.merge(old_s, new_s, "user_id", S.SCORE_PAYLOAD, defaults={"loaded_first": F.lit("incoming")})
    return decimals_as_double(merged)


LOADS = [365, 180, 0]  # the stored tables are loaded as of these days before the latest order


def _loads(spark, d):
    """(reference date, customers, risk scores) of each load, oldest first.  The
    pass over the fact tables is shared; the runs are independent and built side by side."""
    t = features.share_order_facts(_t(spark, d), LOADS)
    build = inheritable_thread_target(spark)(served)
    snaps = [t.snapshot(lag) if lag else t for lag in LOADS]
    with ThreadPoolExecutor(max_workers=len(snaps)) as pool:
        runs = [pool.submit(build, s) for s in snaps]
        return [(features.reference_date(s), *r.result()) for s, r in zip(snaps, runs)]


@query("stored_customers")
def q_stored_customers(spark, d):
    """A stored table after three merges, read back: surrogate ids and the time
    of first insertion stay, the payload is the last load's."""
    table = KeyedTable(spark, scratch_path(spark, "stored-customers"), "user_id", identity="id")
    for day, customers, _ in _loads(spark, d):
        table.merge(customers, S.CUSTOMER_PAYLOAD, {"created_at": day})
    return decimals_as_double(table.read())


@query("stored_scores")
def q_stored_scores(spark, d):
    """Three loads merged as ordered batches in one step: the last batch of a
    user wins, the first one gives the time of insertion."""
    table = KeyedTable(spark, scratch_path(spark, "stored-scores"), "user_id", identity="id")
    batches = [s.withColumn("batch", F.lit(i)).withColumn("day", day) for i, (day, _, s) in enumerate(_loads(spark, d))]
    table.merge_batches(reduce(DataFrame.unionByName, batches), "batch", S.SCORE_PAYLOAD, {"scored_at": F.col("day")})
    return decimals_as_double(table.read())


def _held_segments(spark, d):
    """(segment sums, the view's schema) after three merges of the served view,
    kept current from each merge's changes; the table itself is never read."""
    table = KeyedTable(spark, scratch_path(spark, "stored-view"), "user_id")
    held = None
    for _, customers, scores in _loads(spark, d):
        view = store.customer_risk(customers, scores)
        done = table.merge(view, view.columns)
        held = materialize(rollup.segment_changes(held, done.changes), "segment-sums")
    return held, view.schema


@query("incremental_segments")
def q_incremental_segments(spark, d):
    return rollup.segment_summary(*_held_segments(spark, d))


@query("incremental_tiers")
def q_incremental_tiers(spark, d):
    """The tier roll-up, from the same held sums."""
    return rollup.tier_summary(*_held_segments(spark, d))


@query("incremental_overview")
def q_incremental_overview(spark, d):
    """The KPIs, from the same held sums."""
    return analyst.overview_stats(rollup.segment_summary(*_held_segments(spark, d)))


@query("missing_scores")
def q_missing_scores(spark, d):
    (_, old_s), (new_c, _) = _existing_and_incoming(spark, d)
    return store.missing_keys(new_c, old_s)


@query("backfill_rows")
def q_backfill_rows(spark, d):
    (_, old_s), (new_c, new_s) = _existing_and_incoming(spark, d)
    return decimals_as_double(store.rows_for_keys(new_s, store.missing_keys(new_c, old_s)))


@query("backfill_merge")
def q_backfill_merge(spark, d):
    (_, old_s), (new_c, new_s) = _existing_and_incoming(spark, d)
    return decimals_as_double(store.backfill(old_s, new_s, new_c))


@query("fk_orphans")
def q_fk_orphans(spark, d):
    (old_c, _), (_, new_s) = _existing_and_incoming(spark, d)
    return decimals_as_double(store.fk_orphans(new_s, old_c))


@query("cascade_delete")
def q_cascade_delete(spark, d):
    (old_c, _), (_, new_s) = _existing_and_incoming(spark, d)
    return decimals_as_double(store.cascade_delete(new_s, old_c))


@query("duplicate_keys")
def q_duplicate_keys(spark, d):
    (_, old_s), (_, new_s) = _existing_and_incoming(spark, d)
    return store.duplicate_keys(old_s.unionByName(new_s))


@query("check_violations")
def q_check_violations(spark, d):
    """A raw export of the scores, before any repair: some tiers are not of the
    domain, some are missing (which CHECK lets pass)."""
    _, scores = served(_t(spark, d))
    tier = F.when(F.pmod(F.col("user_id"), F.lit(17)) == 0, F.lit("")).when(F.pmod(F.col("user_id"), F.lit(13)) == 0, F.lower("risk_tier"))
    path = scratch_path(spark, "raw-scores")
    write_table(scores.withColumn("risk_tier", F.coalesce(tier, F.col("risk_tier"))), path, fmt="csv")
    rows, _ = scan_with_rejects(spark, path, scores.schema, "user_id")
    return decimals_as_double(store.check_violations(rows))


@query("precision_violations")
def q_precision_violations(spark, d):
    """Buyers of the raw CSV whose numbers do not fit the store's precisions."""
    rows, _ = _raw_csv(spark, d)
    return store.precision_violations(features.buyers(clean.clean_numeric(rows)), S.CUSTOMER_DECIMALS)


@query("roundtrip_scores")
def q_roundtrip(spark, d):
    path = scratch_path(spark, "predictions")
    write_table(scoring.predictions(_t(spark, d)), path, partition_by=["risk_tier"])
    return read_table(spark, path, S.PREDICTION_SCHEMA).select(S.PREDICTION_COLUMNS)


# --------------------------------------------------------------------- models
_TRAINED: dict = {}


def _trained(spark, d, settings=None):
    """(trained models, prepared buyers) of one data directory.  Training is
    the dearest step, and all keys below describe the same models: they are
    fitted once per application, directory and settings."""
    from riskloom.operators import score
    at = (spark.sparkContext.applicationId, d, repr(settings))
    if at not in _TRAINED:
        prepared = materialize(_prepared(spark, d), "prepared-buyers")
        _TRAINED[at] = score.train_models(prepared, settings), prepared
    return _TRAINED[at]


@query("scaled_features")
def q_scaled_features(spark, d):
    from riskloom.operators import score
    return score.scaled_features(_prepared(spark, d))


@query("model_comparison")
def q_model_comparison(spark, d):
    from riskloom.operators import score
    return score.model_comparison(_trained(spark, d)[0])


@query("model_reports")
def q_model_reports(spark, d):
    """Classification report of each trained model on the hold-out split."""
    from riskloom.operators import score
    return evaluate.classification_report(score.held_out(_trained(spark, d)[0]), by=["model"])


@query("model_curves")
def q_model_curves(spark, d):
    """ROC curve of each trained model on the hold-out split."""
    from riskloom.operators import score
    return evaluate.roc_curve(score.held_out(_trained(spark, d)[0]), by="model")


@query("feature_drivers")
def q_feature_drivers(spark, d):
    from riskloom.operators import score
    return score.feature_importances(_trained(spark, d)[0])


@query("ml_scores")
def q_ml_scores(spark, d):
    from riskloom.operators import score
    return score.score_all(*_trained(spark, d))
