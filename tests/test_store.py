"""Stored keyed tables, roll-ups from changes, and raw scans with rejects."""
import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import analyst, rollup
from riskloom.operators.store import DuplicateKeyError
from riskloom.session import scratch_path
from riskloom.sources import tables
from riskloom.sources.keyed_store import ConcurrentMergeError, KeyedTable

DAYS = [datetime.date(2024, 1, d) for d in (1, 2, 3)]


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "user_id long, a string, b long")


def table(spark, **more):
    return KeyedTable(spark, scratch_path(spark, "keyed"), "user_id", identity="id", **more)


def load(t, spark, pairs, day):
    return t.merge(rows(spark, pairs), ["a", "b"], {"created": F.lit(day)})


def held(t):
    return {r.user_id: (r.a, r.b, r.created, r.id) for r in t.read().collect()}


def test_merges_keep_ids_and_insert_times(spark):
    t = table(spark)
    first = load(t, spark, [(30, "x", 1), (10, "y", 2)], DAYS[0])
    second = load(t, spark, [(20, "new", 3), (10, None, None), (5, "new", 4)], DAYS[1])
    assert (first.inserted, first.updated, second.inserted, second.updated) == (2, 0, 2, 1)
    assert held(t) == {10: (None, None, DAYS[0], 1), 30: ("x", 1, DAYS[0], 2), 5: ("new", 4, DAYS[1], 3), 20: ("new", 3, DAYS[1], 4)}
    load(t, spark, [], DAYS[2])
    load(t, spark, [(1, "z", 9)], DAYS[2])
    assert held(t)[1] == ("z", 9, DAYS[2], 5) and len(held(t)) == 5


def test_a_merge_rewrites_only_touched_buckets(spark):
    t = table(spark, buckets=8)
    load(t, spark, [(i, "a", i) for i in range(200)], DAYS[0])
    before = t.version()["buckets"]
    load(t, spark, [(7, "b", 0)], DAYS[1])
    after = t.version()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert t.read().count() == 200 and held(t)[7][:2] == ("b", 0)
    t.vacuum()
    assert held(t)[7][:2] == ("b", 0) and t.read().count() == 200


def test_a_merge_that_dies_leaves_the_old_table(spark, monkeypatch):
    t = table(spark)
    load(t, spark, [(1, "old", 1), (2, "old", 2)], DAYS[0])
    before = held(t)

    def dies(*_):
        raise RuntimeError("killed before the version was published")

    monkeypatch.setattr(t, "_publish", dies)
    with pytest.raises(RuntimeError, match="killed"):
        load(t, spark, [(1, "new", 1), (3, "new", 3)], DAYS[1])
    fresh = KeyedTable(spark, t.root, "user_id", identity="id")
    assert held(fresh) == before
    load(fresh, spark, [(1, "new", 1), (3, "new", 3)], DAYS[1])  # and the merge can be run again
    assert held(fresh)[3] == ("new", 3, DAYS[1], 3)
    fresh.vacuum()
    assert len(os.listdir(f"{t.root.replace('file:', '')}/data")) <= 2


def test_a_second_writer_of_one_version_fails(spark):
    t = table(spark)
    load(t, spark, [(1, "x", 1)], DAYS[0])
    v = t.version()
    with pytest.raises(ConcurrentMergeError):
        t._publish(v)
    assert held(t) == {1: ("x", 1, DAYS[0], 1)}


@pytest.mark.parametrize("bad", [[(1, "a", 1), (1, "b", 2)], [(None, "a", 1)]])
def test_null_and_repeated_keys_raise(spark, bad):
    t = table(spark)
    with pytest.raises(DuplicateKeyError):
        load(t, spark, bad, DAYS[0])
    with pytest.raises(ValueError, match="holds no table"):
        t.read()


def test_batches_equal_merging_one_by_one(spark):
    loads = [[(3, "a", 1), (1, "a", 1)], [(1, "b", None), (2, "b", 2)], [(2, None, 3), (9, "c", 4)]]
    one = table(spark)
    for pairs, day in zip(loads, DAYS):
        load(one, spark, pairs, day)
    many = table(spark)
    batches = [(n, day, *row) for n, (pairs, day) in enumerate(zip(loads, DAYS)) for row in pairs]
    df = spark.createDataFrame(batches, "batch int, day date, user_id long, a string, b long")
    done = many.merge_batches(df, "batch", ["a", "b"], {"created": F.col("day")})
    assert done.inserted == 4
    assert {k: v[:3] for k, v in held(many).items()} == {k: v[:3] for k, v in held(one).items()}
    assert sorted(v[3] for v in held(many).values()) == [1, 2, 3, 4]
    twice = spark.createDataFrame([(1, DAYS[0], 8, "a", 1), (1, DAYS[0], 8, "b", 1)], df.schema)
    with pytest.raises(DuplicateKeyError):
        many.merge_batches(twice, "batch", ["a", "b"], {"created": F.col("day")})


def test_replace_is_one_step(spark):
    t = table(spark)
    load(t, spark, [(1, "x", 1), (2, "x", 2)], DAYS[0])
    old = t.read()
    t.replace(rows(spark, [(9, "n", 1), (4, "n", 2)]).withColumn("created", F.lit(DAYS[1])))
    assert held(t) == {4: ("n", 2, DAYS[1], 1), 9: ("n", 1, DAYS[1], 2)}
    assert old.count() == 2  # a reader of the version before is not disturbed


VIEW = ("user_id long, risk_tier string, age_bucket string, gender string, traffic_source string, churn_probability decimal(6,4), "
        "total_revenue decimal(10,2), total_orders int, orders_per_month decimal(8,3), return_rate decimal(5,3), one_time_buyer boolean")


def view_rows(spark, seed, users):
    import random
    from decimal import Decimal
    rng = random.Random(seed)
    out = []
    for u in users:
        maybe = lambda v: None if rng.random() < 0.15 else v
        out.append((u, rng.choice(["High", "Low", None]), rng.choice(["18-24", "55+"]), rng.choice("MF"), maybe("Email"),
                    maybe(Decimal(rng.randrange(10000)) / 10000), maybe(Decimal(rng.randrange(10**6)) / 100), maybe(rng.randrange(9)),
                    maybe(Decimal(rng.randrange(5000)) / 1000), maybe(Decimal(rng.randrange(1000)) / 1000), maybe(rng.random() < 0.5)))
    return spark.createDataFrame(out, VIEW)


def test_segments_from_changes_equal_the_full_roll_up(spark):
    t = KeyedTable(spark, scratch_path(spark, "view"), "user_id")
    sums = None
    for seed, users in ((1, range(0, 80)), (2, range(40, 120)), (3, [5, 41, 119, 300])):
        new = view_rows(spark, seed, users)
        done = t.merge(new, new.columns)
        sums = rollup.segment_changes(sums, done.changes)
        got = rollup.segment_summary(sums, t.read().schema).collect()
        want = analyst.segment_summary(t.read()).select(got[0].__fields__).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_bad_cells_are_rejected_one_by_one(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("user_id,n,x,d,flag,name\n1,5,1.5,2.25,true,a\n2,5.0, 7 ,n/a,maybe,\n3,5.5,NaN,123456.0,,\"q,r\"\n4,1e30,,,false,b\n5,1\n6,1,2,3,true,c,extra\n")
    schema = T.StructType.fromDDL("user_id long, n long, x double, d decimal(5,2), flag boolean, name string")
    good, rejects = tables.scan_with_rejects(spark, f"file://{tmp_path}/raw.csv", schema, "user_id")
    got = {r.user_id: tuple(r)[1:] for r in good.collect()}
    assert got[1][:2] == (5, 1.5) and got[1][3:] == (True, "a") and float(got[1][2]) == 2.25
    assert got[2] == (5, 7.0, None, None, None) and got[3] == (None, None, None, None, "q,r")
    assert got[4] == (None, None, None, False, "b") and got[5][0] == 1 and set(got) == {1, 2, 3, 4, 5, 6}
    bad = sorted((r.key, r["column"], r.cause) for r in rejects.collect())
    assert bad == sorted([("2", "d", "not a number"), ("2", "flag", "not a boolean"), ("3", "n", "not whole"), ("3", "x", "not a number"),
                          ("3", "d", "out of range"), ("4", "n", "out of range"), ("5", "", "wrong number of cells"), ("6", "", "wrong number of cells")])


def test_snapshots_share_one_pass_over_the_facts(spark, tmp_path):
    """Order statistics of all loads at once equal those of each load alone, also
    for repeated orders and orders without lines; the facts are read before."""
    from datetime import datetime
    from pyspark.sql import functions as F
    from riskloom.operators import features
    from riskloom.sources.tables import RAW_SCHEMAS, RawTables
    day = lambda m, d: datetime(2020, m, d)
    orders = [(1, 7, "F", 1.0, day(1, 5), "x"), (2, 7, "F", 1.0, day(6, 5), "x"), (3, 8, "P", 1.0, day(9, 1), "x"), (3, 8, "P", 1.0, day(9, 1), "x"),
              (4, 9, "F", 1.0, day(12, 31), "x"), (5, 7, "F", 1.0, None, "x"), (6, 9, "F", 1.0, day(2, 1), "x")]
    lines = [(o, p, 1, n, 1.0, 10.0 * n, 0.1, 0.0, f, "O", day(1, 1)) for o, p, n, f in
             [(1, 1, 1, "R"), (1, 2, 2, "N"), (2, 2, 1, "N"), (3, 1, 1, "R"), (4, 2, 1, "R"), (5, 1, 3, "N")]]
    rows = {"orders": orders, "lineitem": lines, "part": [(1, "a", "b", "T1", 1, 1.0), (2, "a", "b", "T2", 1, 1.0)],
            "events": [(1, day(1, 1), 7, "purchase", 1.0, "")]}
    for name, own in rows.items():
        spark.createDataFrame(own, RAW_SCHEMAS[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    lags = [200, 30, 0]
    def stats(t):
        return sorted(map(tuple, features.customer_order_stats(t).select("user_id", *features.ORDER_STATS).collect()))
    alone = {lag: stats(RawTables(spark, str(tmp_path)).snapshot(lag)) for lag in lags}
    t = features.share_order_facts(RawTables(spark, str(tmp_path)), lags)
    for lag in lags:
        assert stats(t.snapshot(lag)) == alone[lag]
        read = " ".join(features.customer_order_stats(t.snapshot(lag)).inputFiles())
        assert "lineitem" not in read and "orders.parquet" not in read
    assert {lag: [(r[0], r[1]) for r in alone[lag]] for lag in lags} == {200: [(7, 2), (9, 1)], 30: [(7, 2), (8, 0), (9, 1)], 0: [(7, 3), (8, 0), (9, 2)]}
    assert "events.parquet" not in " ".join(t.derived["event_stats"].inputFiles())
