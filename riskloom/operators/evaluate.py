"""Hold-out split and evaluation: class balance, classification report,
exact ROC-AUC with ties, ROC curve points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import schemas as S
from riskloom.functions import exprs as X
from riskloom.operators import selection
from riskloom.operators.rank import distributed_rank
from riskloom.session import materialize

_M31 = 2147483648          # 2^31
_M32 = 4294967296          # 2^32
_GOLDEN = 2654435761       # Knuth's multiplicative constant


def split_hash(key: str, seed: int = S.RANDOM_SEED) -> F.Column:
    """A reproducible uniform value in [0, 2^32) per key: Knuth
    multiplicative hashing in 64-bit integer arithmetic (no overflow), so any
    SQL engine computes the same split."""
    k = F.pmod(F.col(key) + F.lit(seed), F.lit(_M31))
    return F.pmod(k * F.lit(_GOLDEN), F.lit(_M32))


def stratified_split(df: DataFrame, key: str = "user_id", test_share: float = S.SPLIT_TEST_SHARE,
                     seed: int = S.RANDOM_SEED, label: str = "churned") -> DataFrame:
    """Adds ``split`` = 'test' / 'train': of every class exactly the first
    round(test_share * size) rows in (hash, key) order are test rows.

    The last test row of a class is found by counting passes over (label, key),
    written once; every row is then compared with its class's place (one literal
    pair a class), so nothing is sorted and nothing is joined back."""
    slim = materialize(df.select(key, label), "split")
    sizes = slim.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
    place = split_hash(key, seed).cast("double")
    member = [F.col(label).eqNullSafe(F.lit(r[label])) for r in sizes]
    last = [math.floor(test_share * r["n"] + 0.5) for r in sizes]
    found = selection.places(slim, [(F.when(m, place), [n] if n else []) for m, n in zip(member, last)], key)
    test = F.lit(False)
    for m, n, own in zip(member, last, found):
        if n:
            value, at = own[n]
            test = test | (m & ((place < F.lit(value)) | ((place == F.lit(value)) & (F.col(key) <= F.lit(at)))))
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def split_sizes(split: DataFrame, label: str = "churned") -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.avg(label).alias("churn_share"))


def class_balance(train: DataFrame, label: str = "churned") -> DataFrame:
    """Negatives, positives, neg/pos ratio and balanced class weights n/(2 n_c)."""
    a = train.agg(F.count_if(F.col(label) == 0).alias("negatives"),
                  F.count_if(F.col(label) == 1).alias("positives"),
                  F.count(F.lit(1)).alias("rows"))
    return a.select("negatives", "positives",
                    F.try_divide(F.col("negatives").cast("double"), F.col("positives")).alias("pos_weight"),
                    F.try_divide(F.col("rows").cast("double"), F.col("negatives") * 2).alias("weight_0"),
                    F.try_divide(F.col("rows").cast("double"), F.col("positives") * 2).alias("weight_1"))


def with_class_weight(df: DataFrame, balance: DataFrame, label: str = "churned") -> DataFrame:
    b = balance.select("weight_0", "weight_1")
    return (X.with_row_values(df, b)
            .withColumn("weight", F.when(F.col(label) == 1, F.col("weight_1")).otherwise(F.col("weight_0")))
            .drop("weight_0", "weight_1"))


def classification_report(scored: DataFrame, label: str = "label", pred: str = "prediction",
                          by: list[str] | None = None) -> DataFrame:
    """precision / recall / f1 / support per class, accuracy, macro and
    weighted averages, from the 2x2 confusion counts (zero division -> 0);
    one report for each value of ``by`` (e.g. the model), in one aggregate."""
    by = by or []
    c = scored.groupBy(*by).agg(
        F.count_if((F.col(label) == 1) & (F.col(pred) == 1)).alias("tp"),
        F.count_if((F.col(label) == 0) & (F.col(pred) == 1)).alias("fp"),
        F.count_if((F.col(label) == 1) & (F.col(pred) == 0)).alias("fn"),
        F.count_if((F.col(label) == 0) & (F.col(pred) == 0)).alias("tn"))

    def prf(tp, fp, fn):
        p = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0))
        r = F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))
        f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
        return p, r, f

    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    acc = F.coalesce(F.try_divide((tp + tn).cast("double"), n), F.lit(0.0))
    w = lambda a, b: F.coalesce(F.try_divide(a * s0 + b * s1, n.cast("double")), F.lit(0.0))
    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        s.cast("long").alias("support"))

    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", w(p0, p1), w(r0, r1), w(f0, f1), n),
    )
    out = c.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    return out.select(*by, "class", *[F.round(F.col(k), 6).alias(k) for k in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def _wide(c: str | F.Column) -> F.Column:
    """A count as decimal(18,0): products of two are exact in 37 digits, where
    64-bit products overflow near 3e9 x 3e9."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")


def auc_of_totals(twice_rank_sum: F.Column, p: F.Column, n: F.Column) -> F.Column:
    """(2 * rank sum - P (P + 1)) / (2 P N), exact up to the last division."""
    top = twice_rank_sum - _wide(p) * (_wide(p) + F.lit(1).cast("decimal(1,0)"))
    return F.try_divide(top.cast("double"), 2.0 * (_wide(p) * _wide(n)).cast("double"))


def roc_auc(scored: DataFrame, key: str = "user_id", label: str = "label", score: str = "score",
            by: list[str] | None = None) -> DataFrame:
    """Exact ROC-AUC with ties as the Mann-Whitney statistic:
    (sum of mid-ranks of positives - P(P+1)/2) / (P N), for each value of ``by``.

    One distributed sort over (by, score, key) ranks all segments together; a
    row's rank within its segment is its rank less the rows before the segment,
    which leaves the sum as a whole: no segment is one task.  Tie groups are a
    plain group-by on (by, score)."""
    by = by or []
    order = [F.col(c).asc_nulls_first() for c in by] + [F.col(score).asc(), F.col(key).asc()]
    ranked = distributed_rank(scored.select(*by, key, label, score), order, "_r", None)
    groups = ranked.groupBy(*by, score).agg(
        F.min("_r").alias("first"), (F.min("_r") + F.max("_r")).alias("twice_mid_rank"),
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"))
    t = groups.groupBy(*by).agg(F.sum(_wide("twice_mid_rank") * _wide("pos")).alias("twice_rank_sum"),
                                (F.min("first") - 1).alias("before"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    own = F.col("twice_rank_sum") - _wide(F.col("before") * 2) * _wide("p")
    auc = auc_of_totals(own, F.col("p"), F.col("n"))
    return t.select(*by, F.col("p").alias("positives"), F.col("n").alias("negatives"), auc.alias("roc_auc"))


def distributed_cumsum(df: DataFrame, order: list[F.Column], values: list[str]) -> DataFrame:
    """Running sums of ``values`` in the total order ``order`` without a
    single-partition window: running sums within range partitions (written
    once to the checkpoint folder) plus per-partition offsets, which come
    back as one row per partition and are broadcast as a small local table."""
    part = (df.repartitionByRange(*order)
            .withColumn("_cs_part", F.spark_partition_id()))
    part = materialize(part, "cumsum")  # freeze the sampled range assignment
    w = Window.partitionBy("_cs_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = part.select("*", *[F.sum(v).over(w).alias(f"_cs_{v}") for v in values])
    totals = sorted(part.groupBy("_cs_part").agg(*[F.sum(v).alias(v) for v in values]).collect(),
                    key=lambda r: r["_cs_part"])
    rows, run = [], {v: 0 for v in values}
    for r in totals:
        rows.append((int(r["_cs_part"]), *[int(run[v]) for v in values]))
        for v in values:
            run[v] += int(r[v] or 0)
    schema = "_cs_part int, " + ", ".join(f"_off_{v} long" for v in values)
    offs = df.sparkSession.createDataFrame(rows or [(0, *[0] * len(values))], schema)
    out = local.join(F.broadcast(offs), "_cs_part")
    return out.select(*[c for c in df.columns],
                      *[(F.col(f"_cs_{v}") + F.col(f"_off_{v}")).alias(f"cum_{v}") for v in values])


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score", by: str | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first: rates of
    rows scoring >= threshold; and the curve's start (0, 0), where no row is
    called positive, with a null threshold (also for an empty table).

    With ``by`` (a column of few values, e.g. the model) one curve for each
    value: the running sums go through all segments in one sort, and a segment's
    own are these less the totals of the segments before (one row a segment)."""
    seg = [by] if by else []
    g = scored.groupBy(*seg, score).agg(F.count_if(F.col(label) == 1).alias("pos"),
                                        F.count_if(F.col(label) == 0).alias("neg"))
    cum = distributed_cumsum(g, [F.col(c).asc_nulls_first() for c in seg] + [F.col(score).desc()], ["pos", "neg"])
    # running sums never decrease, so their last values are the totals: read
    # from the written running sums instead of grouping the scores again
    last = cum.groupBy(*seg).agg(F.max("cum_pos").alias("P"), F.max("cum_neg").alias("N")).collect()
    rows, before = [], (0, 0)
    for r in sorted(last, key=lambda r: (r["P"] or 0) + (r["N"] or 0)):
        now = (r["P"] or 0, r["N"] or 0)
        rows.append((*(r[c] for c in seg), *before, now[0] - before[0], now[1] - before[1]))
        before = now
    types = {f.name: f.dataType.simpleString() for f in scored.schema.fields}
    schema = ", ".join([f"{c} {types[c]}" for c in seg] + ["_bp long", "_bn long", "_P long", "_N long"])
    totals = scored.sparkSession.createDataFrame(rows, schema)
    if by:
        joined = cum.join(F.broadcast(totals.withColumnRenamed(by, "_seg")), F.col(by).eqNullSafe(F.col("_seg")))
    else:
        joined = X.with_row_values(cum, totals)
    points = joined.select(
        *seg, F.col(score).cast("double").alias("threshold"),
        F.try_divide((F.col("cum_neg") - F.col("_bn")).cast("double"), F.col("_N")).alias("fpr"),
        F.try_divide((F.col("cum_pos") - F.col("_bp")).cast("double"), F.col("_P")).alias("tpr"))
    if seg:
        start = totals.select(*seg, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    else:
        start = scored.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(points)
