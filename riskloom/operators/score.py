"""Model training and scoring: encoded feature matrix, the three classifiers,
reports for each of them on the hold-out split, boosted-tree importances, and
scoring of the whole buyer base with the winner.

The matrix (one array of doubles a row) is written once.  Logistic regression
(``newton``) and boosted trees (``boost``) learn from grouped sums, the forest is
MLlib's.  All rows are scored by all models in one pass into one written table
(user, model, score), which every evaluation reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import schemas as S
from riskloom.functions import exprs as X
from riskloom.operators import boost, evaluate, newton
from riskloom.operators.engineer import label_encode, string_columns
from riskloom.session import materialize

LOGISTIC, FOREST, BOOSTED = "Logistic Regression", "Random Forest", "Gradient Boosted Trees"


@dataclass
class ModelSettings:
    """Reference training set-up (defaults) -- lower only for smoke tests."""
    lr_max_iter: int = 1000
    lr_l2: float = 1.0
    rf_trees: int = 200
    rf_depth: int = 8
    boost: boost.BoostSettings = field(default_factory=boost.BoostSettings)
    seed: int = S.RANDOM_SEED
    checkpoint_interval: int = 10
    models: list[str] = field(default_factory=lambda: [LOGISTIC, FOREST, BOOSTED])


def model_frame(prepared: DataFrame, features: list[str]) -> DataFrame:
    """user_id, label, split and x: the features as one array of doubles,
    strings by their alphabetical code (null as 'nan'); written once."""
    cats = string_columns(prepared, features)
    cols = [F.col("user_id").cast("long").alias("user_id"), F.col("churned").cast("int").alias("label")]
    encoded = label_encode(prepared.select(*cols, *features), cats)
    split = evaluate.stratified_split(encoded, label="label")
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    return materialize(split.select("user_id", "label", "split", x), "model-frame")


def training_rows(frame: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """The train split as key, y, x with the class weights: balanced
    n/(2 n_c) for the linear model and the forest, negatives per positive for
    the boosted trees' positives."""
    train = frame.where(F.col("split") == "train")
    b = evaluate.class_balance(train, "label").first()
    # a class without rows has no weight to give
    weights = {k: float(b[k]) if b[k] is not None else 1.0 for k in ("pos_weight", "weight_0", "weight_1")}
    return train.select(F.col("user_id").alias("key"), F.col("label").cast("double").alias("y"), "x"), weights


@dataclass
class TrainedModels:
    features: list[str]
    models: dict
    frame: DataFrame
    scores: DataFrame | None = None


def train_models(prepared: DataFrame, s: ModelSettings | None = None) -> TrainedModels:
    """Fit the wanted models, each in its own thread: their jobs run side by side."""
    s = s or ModelSettings()
    feats = S.model_feature_columns(prepared.columns)
    frame = model_frame(prepared, feats)
    train, w = training_rows(frame)
    n = len(feats)

    def weighted(neg: float, pos: float) -> DataFrame:
        return train.withColumn("w", F.when(F.col("y") == 1, F.lit(pos)).otherwise(F.lit(neg)))

    def logistic():
        return newton.fit(weighted(w["weight_0"], w["weight_1"]), n, s.lr_l2, s.lr_max_iter)

    def forest():
        est = RandomForestClassifier(labelCol="y", weightCol="w", numTrees=s.rf_trees, maxDepth=s.rf_depth, seed=s.seed,
                                     checkpointInterval=s.checkpoint_interval)
        return est.fit(weighted(w["weight_0"], w["weight_1"]).select("y", "w", array_to_vector("x").alias("features")))

    def boosted():
        return boost.fit(weighted(1.0, w["pos_weight"]), n, s.boost)

    fits = {LOGISTIC: logistic, FOREST: forest, BOOSTED: boosted}
    run = inheritable_thread_target(prepared.sparkSession)
    with ThreadPoolExecutor(max_workers=len(fits)) as pool:
        running = {name: pool.submit(run(fits[name])) for name in s.models}
        return TrainedModels(feats, {name: f.result() for name, f in running.items()}, frame)


def model_scores(tm: TrainedModels) -> DataFrame:
    """user_id, label, split, model, score and prediction of every row under
    every model, in one pass over the matrix; written once."""
    if tm.scores is not None:
        return tm.scores
    n = len(tm.features)
    arrow = {name: m for name, m in tm.models.items() if name != FOREST}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = boost.matrix(batch.column("x"), n)
            cols = [pa.array(m.probability(x)) for m in arrow.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("user_id", "label", "split", "rf")), *cols],
                                             names=["user_id", "label", "split", "rf", *(f"p{i}" for i in range(len(cols)))])

    rows = tm.frame.withColumn("rf", F.lit(None).cast("double"))
    if FOREST in tm.models:
        voted = tm.models[FOREST].transform(tm.frame.withColumn("features", array_to_vector("x")))
        rows = voted.withColumn("rf", vector_to_array("probability").getItem(1))
    schema = "user_id long, label int, split string, rf double" + "".join(f", p{i} double" for i in range(len(arrow)))
    wide = rows.select("user_id", "label", "split", "x", "rf").mapInArrow(run, schema)
    column = {FOREST: "rf"} | {name: f"p{i}" for i, name in enumerate(arrow)}
    each = F.array(*[F.struct(F.lit(name).alias("model"), F.col(column[name]).alias("score")) for name in tm.models])
    long = wide.select("user_id", "label", "split", F.explode(each).alias("m")).select("user_id", "label", "split", "m.model", "m.score")
    tm.scores = materialize(long.withColumn("prediction", (F.col("score") > 0.5).cast("int")), "model-scores")
    return tm.scores


def held_out(tm: TrainedModels) -> DataFrame:
    return model_scores(tm).where(F.col("split") == "test")


def model_comparison(tm: TrainedModels) -> DataFrame:
    """AUC of each model on the test split; the winner is the highest AUC,
    the first listed model on a tie."""
    places = F.create_map(*[F.lit(v) for pos, name in enumerate(tm.models) for v in (name, pos)])
    aucs = evaluate.roc_auc(held_out(tm), by=["model"])
    out = aucs.select(places[F.col("model")].alias("position"), "model", "roc_auc")
    w = Window.orderBy(F.col("roc_auc").desc_nulls_last(), F.col("position"))  # one row a model
    return out.withColumn("is_winner", F.row_number().over(w) == 1)


def feature_importances(tm: TrainedModels, model_name: str = BOOSTED,
                        top: int = S.TOP_IMPORTANCES) -> DataFrame:
    """(feature, importance) of the boosted trees (always, whichever model
    wins), highest first.  One row per feature: bounded by the feature list."""
    spark = tm.frame.sparkSession
    df = spark.createDataFrame(list(zip(tm.features, tm.models[model_name].importances())), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(top)


def score_all(tm: TrainedModels, prepared: DataFrame) -> DataFrame:
    """Score every buyer (train rows included) with the winning model; tier
    on the unrounded probability; top drivers from boosted-tree importances."""
    comp = model_comparison(tm).where("is_winner").select("model").first()
    best = comp["model"] if comp else next(iter(tm.models))
    tops = [r["feature"] for r in feature_importances(tm, top=S.TOP_DRIVERS).collect()] \
        if BOOSTED in tm.models else list(S.BASE_TOP_FEATURES)
    while len(tops) < 3:
        tops.append(None)
    sc = model_scores(tm).where(F.col("model") == best).select("user_id", F.col("score").alias("_p"))
    scored = (prepared.join(sc, "user_id", "inner")
              .withColumn("risk_tier", X.risk_tier("_p"))
              .withColumn("churn_probability", F.round("_p", 4))
              .drop("_p"))
    from riskloom.plans.scoring import predictions_from
    return predictions_from(scored, tops).withColumn("model", F.lit(best))


def scaled_features(prepared: DataFrame, key: str = "user_id") -> DataFrame:
    """Standardise the encoded model features with train-split mean and
    *population* std (as the reference's scaler), one aggregate + a one-row
    broadcast; constant columns scale to 0."""
    feats = S.model_feature_columns(prepared.columns)
    cats = string_columns(prepared, feats)
    enc = evaluate.stratified_split(label_encode(prepared.select(key, "churned", *feats), cats))
    train = enc.where(F.col("split") == "train")
    stats = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"{c}__m") for c in feats],
                      *[F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__s") for c in feats])
    j = X.with_row_values(enc, stats)
    out = [F.col(key), F.col("split")]
    for c in feats:
        z = F.try_divide(F.col(c).cast("double") - F.col(f"{c}__m"), F.col(f"{c}__s"))
        out.append(F.round(F.coalesce(z, F.lit(0.0)), 6).alias(c))
    return j.select(out)
