"""Order statistics by counting against sorted arrays."""
import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.operators import evaluate, selection
from riskloom.plans import catalog, scoring
from conftest import SF_SMALL

WIDE = [1e308, -1e308, 1e-320, -1e-320, 0.0, -0.0, 1.0, 1.0 + 2**-52, 1e15, 1e-15, 3.5, -2.25]


def column(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "k long, v double")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.sampled_from(WIDE), st.floats(-1e6, 1e6), st.integers(-5, 5).map(float)), min_size=1, max_size=60), st.integers(2, 9))
def test_every_rank_of_any_doubles(spark, values, buckets):
    df = column(spark, [*values, None, float("nan")])
    ranks = list(range(0, len(values) + 3))
    got = selection.at_ranks(df, [selection.number("v")], [ranks], buckets=buckets)[0]
    order = sorted(values)
    assert sorted(got) == list(range(1, len(values) + 1))
    for r, f in got.items():
        assert f.value == order[r - 1]
        assert f.before == sum(v < f.value for v in values) and f.equal == values.count(f.value)


def test_ranks_of_long_keys_are_exact(spark):
    keys = [2**62 + i for i in (5, 3, 9, 1)] + [-(2**62), 0, 7]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = selection.at_ranks(df, [F.col("k")], [list(range(1, 8))], buckets=4)[0]
    assert [got[r].value for r in range(1, 8)] == sorted(keys)


def test_quantiles_of_several_columns(spark):
    rng = np.random.default_rng(0)
    a, b = rng.lognormal(0, 4, 3000), rng.integers(0, 3, 3000).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, c double")
    got = selection.quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 0.99, 1.0])
    for name, values in (("a", a), ("b", b)):
        for p in (0.0, 0.25, 0.5, 0.99, 1.0):
            assert got[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12)
    assert got["c", 0.5] is None


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 23, 400])
@pytest.mark.parametrize("descending", [False, True])
def test_quintiles_equal_qcut_of_rank(spark, n, descending):
    rng = np.random.default_rng(n)
    values = rng.integers(0, max(2, n // 3), n)  # many ties, broken by key
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(values)] + [(n, None), (n + 1, float("nan"))], "k long, v double")
    got = {r.k: r.q for r in selection.quintile_scores(df, "k", [("q", "v", descending)]).collect()}
    order = pd.DataFrame({"k": range(n), "v": -values if descending else values}).sort_values(["v", "k"]).k.tolist()
    if n == 1:
        want = {order[0]: 1}
    else:
        want = dict(zip(order, pd.qcut(pd.Series(range(1, n + 1)), 5, labels=[1, 2, 3, 4, 5]).astype(int)))
    assert got == {**want, n: None, n + 1: None}


def test_split_takes_the_first_share_of_every_class(spark):
    rows = [(i, i % 3 if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "user_id long, churned int")
    got = {r.user_id: r.split for r in evaluate.stratified_split(df).collect()}
    place = {r.user_id: r.h for r in df.select("user_id", evaluate.split_hash("user_id").alias("h")).collect()}
    for c in (0, 1, 2, None):
        own = sorted((u for u, k in rows if k == c), key=lambda u: (place[u], u))
        n = int(0.2 * len(own) + 0.5)
        assert [got[u] for u in own] == ["test"] * n + ["train"] * (len(own) - n)
    assert evaluate.stratified_split(df.limit(0)).count() == 0


@pytest.mark.parametrize("key", ["describe", "rfm_scores", "winsorize", "stratified_split"])
def test_no_sort_in_the_plans(spark, key):
    plan = catalog.QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort [" not in plan and "Join" not in plan


def test_scores_equal_the_rank_formula(spark):
    p = scoring.prepared_buyers(scoring.tables(spark, SF_SMALL)).toPandas()
    for name, col, sign in (("rfm_frequency_score", "total_orders", 1), ("rfm_recency_score", "days_since_last_order", -1)):
        order = p.assign(v=sign * p[col].astype(float)).sort_values(["v", "user_id"]).reset_index()
        m = len(order)
        want = [max(1, -(-5 * r // (m - 1))) for r in range(m)]
        assert order[name].tolist() == want
