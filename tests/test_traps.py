"""Hand-computed cases for the semantic traps on tiny frames."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions import exprs as X
from riskloom.operators import analyst, clean, eda, evaluate, store
from riskloom.operators.rank import distributed_rank, quintile_score


@pytest.mark.parametrize("n", [1, 2, 5, 7, 8, 12, 37])
def test_qcut_of_rank_matches_pandas_not_ntile(spark, n):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(n)], "user_id long, v double")
    got = {r.user_id: r.q for r in quintile_score(df, "user_id", "v", "q").collect()}
    pdf = pd.DataFrame({"user_id": range(n), "v": [float(i % 3) for i in range(n)]})
    pdf = pdf.sort_values(["v", "user_id"]).reset_index(drop=True)
    if n == 1:
        expected = {0: 1}
    else:
        labels = pd.qcut(pd.Series(range(1, n + 1), dtype=float), 5, labels=[1, 2, 3, 4, 5]).astype(int)
        expected = dict(zip(pdf.user_id, labels))
    assert got == expected


def test_qcut_n7_groups():
    # {1,2},{3},{4},{5},{6,7} -- ntile would give {1,2},{3,4},{5},{6},{7}
    r = [1, 2, 3, 4, 5, 6, 7]
    expect = [1, 1, 2, 3, 4, 5, 5]
    got = [max(1, math.ceil(5 * (x - 1) / 6)) for x in r]
    assert got == expect


def test_distributed_rank_is_a_permutation_with_hot_value(spark):
    rows = [(i, 1.0 if i % 3 else float(i)) for i in range(3000)]  # a third share one value
    df = spark.createDataFrame(rows, "user_id long, v double")
    out = distributed_rank(df, [F.col("v"), F.col("user_id")], "rank", "n_rows", num_partitions=7).toPandas()
    exp = pd.DataFrame(rows, columns=["user_id", "v"]).sort_values(["v", "user_id"])
    exp["rank"] = range(1, len(exp) + 1)
    m = out.merge(exp, on="user_id", suffixes=("", "_e"))
    assert (m["rank"] == m["rank_e"]).all()
    assert set(out["n_rows"]) == {3000}


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=501), rng.integers(0, 9, size=501).astype(float)
    df = spark.createDataFrame([(i, float(a[i]), float(b[i])) for i in range(501)], "user_id long, a double, b double")
    q = clean.exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.99]).toPandas()
    for col, arr in (("a", a), ("b", b)):
        for p in (0.25, 0.5, 0.99):
            got = q[(q.column == col) & (q.prob == p)].value.iloc[0]
            assert got == pytest.approx(float(np.quantile(arr, p)), rel=1e-12, abs=1e-12)


def test_risk_tier_thresholds_and_nan(spark):
    vals = [0.69996, 0.7, 0.4, 0.39999, 0.0, 1.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    out = df.select(X.risk_tier("p").alias("t"), F.round("p", 4).alias("r")).collect()
    assert [r.t for r in out] == ["Medium", "High", "Medium", "Low", "Low", "High", "Low", "Low"]
    assert out[0].r == 0.7  # rounded to 0.7000 yet Medium (tier uses the unrounded value)


def test_coerce_numeric_strings(spark):
    from pyspark.sql import types as T
    vals = ["12", " 12 ", "1e3", "x", "", "nan", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.s for r in df.select(X.coerce_numeric("s", T.StringType())).collect()]
    assert got == [12.0, 12.0, 1000.0, 0.0, 0.0, 0.0, 0.0]


def test_clip_keeps_null_and_pearson_constant_is_null(spark):
    df = spark.createDataFrame([(None, 1.0, 5.0), (7.0, 1.0, 6.0), (2.0, 1.0, 7.0)], "a double, c double, y double")
    clipped = [r.x for r in df.select(X.clip_upper("a", F.lit(3.0)).alias("x")).collect()]
    assert clipped == [None, 3.0, 2.0]
    r = df.agg(X.pearson("c", "y").alias("r")).first().r
    assert r is None


def test_merge_writes_null_keeps_created_and_rejects_duplicates(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "user_id long, v string, created_at string")
    new = spark.createDataFrame([(2, None), (3, "c")], "user_id long, v string")
    m = {r.user_id: (r.v, r.created_at) for r in
         store.merge(old, new, "user_id", ["user_id", "v"], {"created_at": F.lit("now")}).collect()}
    assert m == {1: ("a", "t0"), 2: (None, "t0"), 3: ("c", "now")}
    again = store.merge(store.merge(old, new, "user_id", ["user_id", "v"]), new, "user_id", ["user_id", "v"])
    assert again.count() == 3  # idempotent key set
    dup = spark.createDataFrame([(3, "c"), (3, "d")], "user_id long, v string")
    with pytest.raises(store.DuplicateKeyError):
        store.merge(old, dup, "user_id", ["user_id", "v"])


def test_anti_and_semi_partition_the_keys(spark):
    parents = spark.range(0, 50).withColumnRenamed("id", "user_id")
    children = spark.range(0, 50, 3).withColumnRenamed("id", "user_id")
    miss = store.missing_keys(parents, children)
    kept = store.cascade_delete(parents, children)
    assert miss.count() + kept.count() == 50
    assert miss.join(kept, "user_id").count() == 0


def test_auc_with_ties_and_symmetry(spark):
    df = spark.createDataFrame([(i, l, s) for i, (l, s) in enumerate(zip([0, 1, 1, 0, 1], [.2, .2, .8, .8, .9]))],
                               "user_id long, label int, score double")
    auc = evaluate.roc_auc(df).first().roc_auc
    assert auc == pytest.approx(4 / 6)
    inv = evaluate.roc_auc(df.withColumn("score", 1 - F.col("score"))).first().roc_auc
    assert auc + inv == pytest.approx(1.0)
    curve = {r.threshold: (r.fpr, r.tpr) for r in evaluate.roc_curve(df).collect()}
    assert curve[0.9] == (0.0, 1 / 3) and curve[0.2] == (1.0, 1.0)
    assert curve[None] == (0.0, 0.0)  # the start: nothing called positive


def test_classification_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    rep = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1 == 0.0
    assert rep["0"].support == 2 and rep["accuracy"].f1 == pytest.approx(2 / 3, abs=1e-6)


def test_question_filters_fixture(spark):
    qs = ["email vs facebook 18-24", "EMAIL 1824", "who is on top", "whole picture 55+",
          "organic and youtube", "adwords 35 44"]
    df = spark.createDataFrame(list(enumerate(qs)), "question_id long, question string")
    out = {r.question_id: r for r in analyst.question_filters(df).collect()}
    assert out[0].source_filter is None and out[0].is_comparison and out[0].age_filter == "18-24"
    assert out[1].source_filter == "Email" and out[1].age_filter == "18-24"
    assert out[2].wants_customers and out[3].wants_customers  # 'who' inside 'whole'
    assert out[3].age_filter == "55+"
    assert out[4].source_filter is None and list(out[4].mentioned_sources) == ["Organic", "YouTube"]
    assert out[5].source_filter == "Adwords" and out[5].age_filter == "35-44"


def test_recent_turns_short_conversation_keeps_all(spark):
    rows = [(1, t, "user", f"m{t}") for t in range(3)] + [(2, t, "user", f"m{t}") for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = analyst.recent_turns(df).groupBy("conv_id").agg(F.min("turn").alias("lo"), F.count("*").alias("n"))
    assert {(r.conv_id, r.lo, r.n) for r in got.collect()} == {(1, 0, 3), (2, 3, 6)}


def test_histogram_last_bin_closed_and_constant_class(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (0, 2.0), (1, 3.0), (1, 3.0)], "churned int, x double")
    h = {(r.churned, r.bin): r["count"] for r in eda.histogram(df, "x", 5.0, 2).collect()}
    assert h == {(0, 0): 1, (0, 1): 2, (1, 1): 2}


def test_reindex_domain_and_null_groups(spark):
    df = spark.createDataFrame([("18-24", None, 1), ("0-17", "M", 0), ("18-24", "F", 0)],
                               "age_bucket string, gender string, churned int")
    ages = eda.churn_by_domain(df, "age_bucket", ["18-24", "25-34"]).orderBy("position").collect()
    assert [(r.age_bucket, r.churn_rate) for r in ages] == [("18-24", 0.5), ("25-34", None)]
    assert {r.gender for r in eda.churn_by(df, "gender").collect()} == {"M", "F"}


def test_check_and_precision_violations(spark):
    df = spark.createDataFrame([(1, "Critical", 123456789.0), (2, None, 1.0), (3, "High", 2.5)],
                               "user_id long, risk_tier string, total_revenue double")
    assert [r.user_id for r in store.check_violations(df).collect()] == [1]
    bad = store.precision_violations(df, {"total_revenue": (10, 2)}).collect()
    assert [r.user_id for r in bad] == [1]
    dups = store.duplicate_keys(df.unionByName(df.limit(1))).collect()
    assert [r.user_id for r in dups] == [1]


def test_rank_columns_one_sort_matches_per_column_ranks(spark):
    from riskloom.operators.rank import quantile_values, rank_columns
    rng = np.random.default_rng(7)
    n = 900
    a = np.where(rng.random(n) < 0.34, 2.0, rng.integers(0, 50, n).astype(float))  # hot value
    b = rng.normal(size=n)
    pdf = pd.DataFrame({"user_id": np.arange(n), "a": a, "b": b})
    pdf.loc[5, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    r = rank_columns(df, "user_id", [("a_up", "a", False), ("b_down", "b", True)], num_partitions=6)
    got = r.toPandas()
    up = pdf.sort_values(["a", "user_id"]).assign(rank=np.arange(1, n + 1))
    g_up = got[got.name == "a_up"].merge(up, on="user_id")
    assert len(g_up) == n and (g_up["rank_x"] == g_up["rank_y"]).all()
    down = pdf.dropna().assign(nb=lambda d: -d.b).sort_values(["nb", "user_id"])
    down["rank"] = np.arange(1, len(down) + 1)
    g_down = got[got.name == "b_down"].set_index("user_id")["rank"]
    assert (g_down.loc[down.user_id].values == down["rank"].values).all()
    assert set(got[got.name == "b_down"]["n"]) == {n - 1}
    q = quantile_values(r, ["a_up", "b_down"], [0.5, 0.99])
    assert q[("a_up", 0.5)] == pytest.approx(float(np.quantile(a, 0.5)))
    assert q[("b_down", 0.99)] == pytest.approx(float(np.quantile(pdf.b.dropna(), 0.99)))


def test_distributed_cumsum_with_ties(spark):
    df = spark.createDataFrame([(float(i // 3), 1, i % 2) for i in range(300)], "s double, pos int, neg int")
    g = df.groupBy("s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    out = evaluate.distributed_cumsum(g, [F.col("s").desc()], ["pos", "neg"]).toPandas().sort_values("s")
    exp = g.toPandas().sort_values("s", ascending=False)
    exp["cum_pos"] = exp["pos"].cumsum()
    m = out.merge(exp, on="s")
    assert (m["cum_pos_x"] == m["cum_pos_y"]).all()


def test_label_encode_null_heavy_column(spark):
    from riskloom.operators import engineer
    df = spark.createDataFrame([(i, f"v{i % 7}" if i % 11 == 0 else None, "x") for i in range(500)], "id long, s string, t string")
    codes = {r.id: (r.s, r.t) for r in engineer.label_encode(df, ["s", "t"]).collect()}
    assert len(codes) == 500
    assert all(codes[i] == (0 if i % 11 else 1 + i % 7, 0) for i in codes)  # 'nan' sorts before 'v0'..'v6'


def test_auc_products_beyond_64_bits(spark):
    from riskloom.operators.evaluate import auc_of_totals
    p = n = 4_000_000_000
    top = 2 * (p * n + p * (p + 1) // 2)  # every positive above every negative
    row = spark.range(1).select(auc_of_totals(F.lit(str(top)).cast("decimal(38,0)"), F.lit(p), F.lit(n)).alias("auc")).first()
    assert row.auc == 1.0


@pytest.mark.parametrize("size", [37, 1000])
def test_split_is_exact_per_class(spark, size):
    from riskloom.operators.evaluate import stratified_split
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(size)], "user_id long, churned int")
    got = {(r.churned, r.split): r["count"] for r in stratified_split(df).groupBy("churned", "split").count().collect()}
    for y in (0, 1):
        n = sum(int(i % 5 == 0) == y for i in range(size))
        assert got[y, "test"] == int(0.2 * n + 0.5) and got[y, "train"] == n - got[y, "test"]


def test_customer_and_segment_lines_keep_null_fields(spark):
    from riskloom.operators import analyst
    cols = ("user_id long, total_revenue double, churn_probability double, age_bucket string, gender string, traffic_source string, "
            "top_feature_1 string, top_feature_2 string, top_feature_3 string")
    rows = [(1, 1000.0, 0.9, None, "M", "Email", "a", "b", "c"), (2, 1234.5, 0.8, "55+", "F", "Email", "a", "b", "c")]
    lines = [r[0] for r in spark.createDataFrame(rows, cols).orderBy("user_id").select(analyst.customer_line()).collect()]
    assert lines[0] == "- User 1: $1,000 revenue, 90.0% churn prob, null M, Email, top drivers: a, b, c"
    assert lines[1].startswith("- User 2: $1,234.5 revenue")
    seg = spark.createDataFrame([("High", None, "M", "Email", 3, 0.5, 10.0, 1.0, 0.1, 1)],
                                "risk_tier string, age_bucket string, gender string, traffic_source string, user_count long, "
                                "avg_churn_prob double, total_revenue_at_risk double, avg_orders_per_month double, avg_return_rate double, "
                                "one_time_buyers long")
    assert seg.select(analyst.segment_line(seg)).first()[0].startswith("High |  | M | Email | 3 | ")


def test_describe_matches_pandas_and_skips_nulls(spark):
    rows = [(1, 3.0, None, 10), (2, None, None, 20), (3, 7.4, None, 30), (4, 1.25, None, 40), (5, 2.0, None, 50)]
    df = spark.createDataFrame(rows, "user_id long, a double, b double, c long")
    got = {r["column"]: r.asDict() for r in clean.describe(df, ["a", "b", "c"]).collect()}
    pdf = pd.DataFrame(rows, columns=["user_id", "a", "b", "c"]).astype({"b": float})
    for c in ["a", "c"]:
        d = pdf[c].describe()
        exp = {"count": d["count"], "mean": d["mean"], "std": d["std"], "min": d["min"],
               "p25": d["25%"], "p50": d["50%"], "p75": d["75%"], "max": d["max"]}
        for k, v in exp.items():
            assert got[c][k] == pytest.approx(round(v, 2)), (c, k)
    assert got["b"]["count"] == 0 and got["b"]["mean"] is None


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_merge_is_idempotent_on_random_tables(spark, seed):
    """merge(merge(old, new), new) == merge(old, new), row for row, with nulls
    in both tables and keys on either side only."""
    rng = np.random.default_rng(seed)
    old_keys = rng.choice(60, 30, replace=False)
    new_keys = rng.choice(60, 30, replace=False)
    val = lambda: None if rng.random() < 0.2 else float(rng.integers(0, 9))
    old = spark.createDataFrame([(int(k), val(), "t0") for k in old_keys],
                                "user_id long, v double, created_at string")
    new = spark.createDataFrame([(int(k), val()) for k in new_keys], "user_id long, v double")
    once = store.merge(old, new, "user_id", ["user_id", "v"], {"created_at": F.lit("t1")})
    twice = store.merge(once, new, "user_id", ["user_id", "v"], {"created_at": F.lit("t2")})
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert once.count() == len(set(old_keys) | set(new_keys))
