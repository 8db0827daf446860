"""The learners against plain NumPy versions, and the whole model path with
small settings (the reference's 200 trees / 300 rounds are the defaults)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskloom.operators import boost, newton, score
from riskloom.plans import catalog

TRAIN = "key long, y double, w double, x array<double>"


def training_data(seed, n, missing=0.1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 6, n).astype(float), rng.exponential(size=n), np.ones(n), rng.normal(size=n)], 1)
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - (x[:, 1] == 3) * 2 + x[:, 2])))
    y = (rng.random(n) < p).astype(float)
    x[rng.random((n, 5)) < missing] = np.nan
    return np.arange(n) * 7 + 3, y, np.where(y == 1, 0.7, 1.0), x


def frame(spark, key, y, w, x):
    cell = lambda v: None if np.isnan(v) else float(v)
    rows = [(int(k), float(a), float(b), [cell(v) for v in r]) for k, a, b, r in zip(key, y, w, x)]
    return spark.createDataFrame(rows, TRAIN).repartition(5)


def plain_boost(key, y, w, x, edges, s):
    """Depth-first in one process, no histograms: sums over masks for every cut."""
    b = boost.binned(x, edges)
    margin, trees = np.zeros(len(y)), []
    for number in range(s.rounds):
        g, h = boost.gradients(margin, y, w)
        g, h = g / boost.FIXED, h / boost.FIXED
        sample = boost.sampled_rows(key, number, s)
        columns = boost.sampled_columns(x.shape[1], number, s)
        nodes = [(np.ones(len(y), bool), 0.0)]
        frontier = [0]
        rules = {}
        for _ in range(s.depth):
            following = []
            for node in frontier:
                mask = nodes[node][0]
                m = mask & sample
                G, H, best = g[m].sum(), h[m].sum(), (boost.LEAST_GAIN, None)
                for f in columns:
                    for cut in range(1, boost.BINS):
                        for missing_left in (False, True):
                            left = m & np.where(b[:, f] == 0, missing_left, b[:, f] <= cut)
                            gl, hl = g[left].sum(), h[left].sum()
                            if hl < s.min_child or H - hl < s.min_child:
                                continue
                            gain = gl**2 / (hl + s.l2) + (G - gl)**2 / (H - hl + s.l2) - G**2 / (H + s.l2)
                            if gain > best[0]:
                                best = (gain, (f, cut, missing_left, gl, hl))
                if best[1] is None:
                    continue
                f, cut, missing_left, gl, hl = best[1]
                side = np.where(b[:, f] == 0, missing_left, b[:, f] <= cut)
                rules[node] = (f, cut, missing_left, best[0])
                nodes.append((mask & side, -s.rate * gl / (hl + s.l2)))
                nodes.append((mask & ~side, -s.rate * (G - gl) / (H - hl + s.l2)))
                following += [len(nodes) - 2, len(nodes) - 1]
            frontier = following
        leaves = [(m, v) for i, (m, v) in enumerate(nodes) if i not in rules]
        add = np.zeros(len(y))
        for m, v in leaves:
            add[m] = v
        margin = margin + add
        trees.append(rules)
    return trees, margin


def test_boosted_trees_equal_a_plain_version_split_for_split(spark, monkeypatch):
    monkeypatch.setattr(boost, "BINS", 12)  # fewer cuts for the plain version to try
    key, y, w, x = training_data(4, 300)
    s = boost.BoostSettings(rounds=7, depth=3, refresh=3)
    model = boost.fit(frame(spark, key, y, w, x), 5, s)
    trees, margin = plain_boost(key, y, w, x, model.edges, s)
    for got, want in zip(model.trees, trees):
        splits = {i: (f, got.cut[i], got.missing_left[i]) for i, f in enumerate(got.feature) if f >= 0}
        assert splits == {i: r[:3] for i, r in want.items()}
        assert [got.gain[i] for i in splits] == pytest.approx([want[i][3] for i in splits])
    assert len(model.trees) == s.rounds and any(len(t) > 3 for t in trees)
    assert model.margin(x) == pytest.approx(margin, abs=1e-12)
    shares = model.importances()
    assert sum(shares) == pytest.approx(1.0) and shares[3] < shares[0]


def test_boosting_does_not_depend_on_the_partitioning(spark, monkeypatch):
    key, y, w, x = training_data(9, 400)
    s = boost.BoostSettings(rounds=4, depth=3)
    d = frame(spark, key, y, w, x)
    one = boost.fit(d.coalesce(1), 5, s).trees
    monkeypatch.setattr(boost, "ROWS_A_TASK", 30)
    monkeypatch.setattr(boost, "FEW_TASKS", 2)  # the tables are added by Spark
    assert boost.fit(d.repartition(13), 5, s).trees == one


def test_a_level_is_one_job_over_several_tasks_and_margins_need_no_job(spark, monkeypatch):
    key, y, w, x = training_data(5, 400)
    d = frame(spark, key, y, w, x)
    monkeypatch.setattr(boost, "LEAST_ROWS", 200)
    levels = []
    real = boost.level_sums
    monkeypatch.setattr(boost, "level_sums", lambda state, *rest: (levels.append(state), real(state, *rest))[1])
    s = boost.BoostSettings(rounds=5, depth=2, refresh=2)
    sc = spark.sparkContext
    sc.setJobGroup("boost-levels", "")
    trees = boost.fit(d, 5, s).trees
    jobs = len(sc.statusTracker().getJobIdsForGroup("boost-levels"))
    sc.setJobGroup("", "")
    assert {state.getNumPartitions() for state in levels} == {2}  # was 1 for any table under 50,000 rows
    assert len(levels) <= s.rounds * s.depth and jobs <= len(levels) + 2 * (s.rounds // s.refresh) + 10
    assert boost.fit(d, 5, boost.BoostSettings(rounds=5, depth=2, refresh=1)).trees == trees


def test_boosting_on_one_class_and_on_missing_values_only(spark):
    key, y, w, x = training_data(2, 60)
    one = boost.fit(frame(spark, key, np.zeros(60), w, x), 5, boost.BoostSettings(rounds=2))
    assert (one.probability(x) <= 0.5).all()
    blank = boost.fit(frame(spark, key, y, w, np.full((60, 5), np.nan)), 5, boost.BoostSettings(rounds=2))
    assert all(t.feature == [-1] for t in blank.trees) and (blank.probability(x) == 0.5).all()
    assert blank.importances() == [0.0] * 5


def test_logistic_regression_equals_plain_newton(spark):
    key, y, w, x = training_data(1, 500, missing=0.05)
    model = newton.fit(frame(spark, key, y, w, x), 5)
    assert model.gradient < 1e-8
    mean, std = np.nanmean(x, 0), np.nanstd(x, 0)
    z = np.nan_to_num(np.divide(x - mean, std, out=np.zeros_like(x), where=std > 0), nan=0.0)
    z, free = np.c_[np.ones(len(x)), z], np.r_[0.0, np.ones(5)]
    b = np.zeros(6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        g = z.T @ (w * (p - y)) + free * b
        b -= np.linalg.lstsq(z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(free), g, rcond=None)[0]
    assert model.weights == pytest.approx(b, abs=1e-8)
    assert model.weights[4] == 0.0  # a constant feature has no say


def test_logistic_regression_on_separable_and_single_class_rows(spark):
    key, y, w, x = training_data(3, 200, missing=0)
    apart = newton.fit(frame(spark, key, (x[:, 0] > 0).astype(float), np.full(200, 50.0), x), 5, l2=1e-3)
    assert apart.gradient < 1e-6 and ((apart.probability(x) > 0.5) == (x[:, 0] > 0)).all()
    alone = newton.fit(frame(spark, key, np.zeros(200), w, x), 5, max_steps=30)
    assert (alone.probability(x) < 0.01).all()


SMALL = score.ModelSettings(lr_max_iter=20, rf_trees=5, rf_depth=3, boost=boost.BoostSettings(rounds=3, depth=2))


@pytest.fixture(scope="module")
def trained(spark):
    return catalog._trained(spark, SF_SMALL, SMALL)


def test_small_models_train_compare_and_score(trained):
    tm, prepared = trained
    comp = score.model_comparison(tm).collect()
    assert sorted(r["model"] for r in comp) == sorted(SMALL.models)
    assert sum(r["is_winner"] for r in comp) == 1
    assert all(r["roc_auc"] is None or 0.0 <= r["roc_auc"] <= 1.0 for r in comp)
    imp = score.feature_importances(tm).collect()
    assert 0 < len(imp) <= 15 and all(r["importance"] >= 0 for r in imp)
    scored = score.score_all(tm, prepared)
    assert scored.count() == prepared.count()
    bad = scored.where(~F.col("risk_tier").isin("High", "Medium", "Low")
                       | (F.col("churn_probability") < 0) | (F.col("churn_probability") > 1))
    assert bad.count() == 0
    assert scored.select("model").distinct().count() == 1


def test_reports_and_curves_per_trained_model(trained):
    from riskloom.operators import evaluate
    tm, _ = trained
    rows = score.held_out(tm).toPandas()
    report = evaluate.classification_report(score.held_out(tm), by=["model"]).toPandas()
    curve = evaluate.roc_curve(score.held_out(tm), by="model").toPandas()
    aucs = {r["model"]: r["roc_auc"] for r in score.model_comparison(tm).collect()}
    assert set(report["model"]) == set(curve["model"]) == set(SMALL.models) == set(rows["model"])
    for name, own in rows.groupby("model"):
        right = (own.label == own.prediction).mean()
        assert report[(report.model == name) & (report["class"] == "accuracy")].f1.iloc[0] == pytest.approx(right, abs=1e-6)
        pos, neg = own[own.label == 1].score.values, own[own.label == 0].score.values
        wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        assert aucs[name] == pytest.approx(wins / (len(pos) * len(neg)))
        for _, point in curve[(curve.model == name) & curve.threshold.notna()].iterrows():
            assert point.tpr == pytest.approx((pos >= point.threshold).mean()) and point.fpr == pytest.approx((neg >= point.threshold).mean())
        assert len(curve[curve.model == name]) == own.score.nunique() + 1


def test_models_are_fitted_once(spark, trained):
    assert catalog._trained(spark, SF_SMALL, SMALL) is trained
