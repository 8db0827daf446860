"""Plan shape: pruning, pushdown and no unbounded single-task operators."""
import math

import pandas as pd
import pytest

from conftest import SF_SMALL
from riskloom.operators import features
from riskloom.plans import catalog, scoring


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_prunes_and_pushes_down(spark):
    plan = _plan(features.feature_base(scoring.tables(spark, SF_SMALL)))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # lineitem scans read only the referenced columns
    for line in plan.splitlines():
        if "lineitem.parquet" in line:
            schema = line.split("ReadSchema: ")[1]
            assert "l_shipdate" not in schema and "l_comment" not in schema and "l_tax" not in schema
    older = _plan(features.feature_base(scoring.tables(spark, SF_SMALL).snapshot(365)))
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThanOrEqual(o_orderdate" in older


def test_feature_plan_reads_each_fact_table_once(spark):
    plan = _plan(features.feature_base(scoring.tables(spark, SF_SMALL)))
    for name in ("lineitem", "orders", "events", "customer"):
        assert sum("FileScan" in line and f"{name}.parquet" in line for line in plan.splitlines()) == 1, name


@pytest.mark.parametrize("key", ["predictions", "segment_summary", "top_at_risk", "upsert_scores"])
def test_scored_plans_have_no_cartesian_or_nested_loop(spark, key):
    plan = _plan(catalog.QUERIES[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_top_k_is_take_ordered(spark):
    plan = _plan(catalog.QUERIES["top_at_risk"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan


def test_qcut_formula_equals_pandas_for_many_n():
    for n in range(2, 400):
        r = pd.Series(range(1, n + 1), dtype=float)
        expect = pd.qcut(r, 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
        got = [max(1, (5 * (x - 1) + (n - 2)) // (n - 1)) for x in range(1, n + 1)]
        assert got == expect, n
        assert max(got) == 5 and min(got) == 1
        sizes = pd.Series(got).value_counts()
        assert sizes.max() - sizes.min() <= math.ceil(n / 5)


def test_library_has_no_cross_joins():
    """One-row aggregates are attached as literals (exprs.with_row_values),
    never by a cross join."""
    import pathlib
    root = pathlib.Path(__file__).resolve().parents[1] / "riskloom"
    offenders = [str(p) for p in root.rglob("*.py") if "crossJoin(" in p.read_text()]
    assert offenders == []
