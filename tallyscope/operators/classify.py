"""Training and applying account classifiers with MLlib."""

from __future__ import annotations

import json
import random

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.groups import global_position
from tallyscope.operators.evaluate import F1_TARGET, best_weight, decide, ensemble, macro_f1, search_weights
from tallyscope.operators.splits import shuffle_key, stratified_folds
from tallyscope.session import settle

SEARCH_SPACE = {"numTrees": (10, 40), "maxDepth": (3, 10), "minInstancesPerNode": (1, 10)}


def canonical(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature columns in canonical order; an absent column or value is 0."""
    extra = [c for c in df.columns if c not in features]
    filled = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c)
        for c in features
    ]
    return df.select(*extra, *filled)


def train_trees(
    train: DataFrame,
    validate: DataFrame,
    features: list[str],
    *,
    trials: int = 3,
    seed: int = 42,
) -> PipelineModel:
    """Random-forest search; the model with the best macro F1 on ``validate``."""
    rng = random.Random(seed)
    assembler = VectorAssembler(inputCols=features, outputCol="_x")
    best, best_score = None, -1.0
    for _ in range(trials):
        chosen = {name: rng.randint(*ends) for name, ends in SEARCH_SPACE.items()}
        forest = RandomForestClassifier(
            featuresCol="_x", labelCol="label", seed=seed, probabilityCol="_tree", **chosen
        )
        model = Pipeline(stages=[assembler, forest]).fit(canonical(train, features))
        scored = predict_with(model, validate, features, "_tree", "probability")
        score = macro_f1(decide(scored, "probability")).first()[0]
        if score > best_score:
            best, best_score = model, score
    return best


def train_network(
    train: DataFrame, features: list[str], classes: int, *, epochs: int = 100, seed: int = 42
) -> PipelineModel:
    """Perceptron with hidden layers of 128 and 64 on standardised features."""
    stages = [
        VectorAssembler(inputCols=features, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        MultilayerPerceptronClassifier(
            layers=[len(features), 128, 64, classes],
            featuresCol="_x",
            labelCol="label",
            probabilityCol="_net",
            maxIter=epochs,
            seed=seed,
        ),
    ]
    return Pipeline(stages=stages).fit(canonical(train, features))


def predict_with(
    model: PipelineModel, df: DataFrame, features: list[str], column: str, name: str
) -> DataFrame:
    """Add the model's class probabilities as the array column ``name``."""
    keep = [c for c in df.columns if c not in features]
    scored = model.transform(canonical(df, features))
    return scored.select(*keep, *features, vector_to_array(column).alias(name))


def score_accounts(
    df: DataFrame,
    features: list[str],
    trees: PipelineModel,
    network: PipelineModel | None = None,
    weights: tuple[float, float] = (0.5, 0.5),
    names: list[str] | None = None,
) -> DataFrame:
    """Label, confidence and class probabilities for every row."""
    scored = predict_with(trees, df, features, "_tree", "trees")
    second = None
    if network is not None:
        scored = predict_with(network, scored, features, "_net", "network")
        second = F.col("network")
    mixed = scored.withColumn("probability", ensemble(F.col("trees"), second, weights))
    return decide(mixed, "probability", names).drop("trees", "network")


def tune_weights(trees: PipelineModel, network: PipelineModel, validate: DataFrame, features: list[str]):
    """Ensemble weights with the best macro F1 on the validation part."""
    scored = predict_with(trees, validate, features, "_tree", "trees")
    scored = predict_with(network, scored, features, "_net", "network")
    weight = best_weight(search_weights(settle(scored), "trees", "network")).first()["weight"]
    return (weight, 1.0 - weight)


def cross_validate(
    df: DataFrame,
    features: list[str],
    *,
    key: str,
    folds: int = 5,
    trials: int = 1,
    seed: int = 42,
    classes: int | None = None,
    epochs: int = 100,
) -> DataFrame:
    """Macro F1 per stratified fold, with mean, population deviation and target flag.

    Everything is chosen inside the other folds: the next fold picks trees and
    ensemble weight, the rest fits them, and the fold itself is scored once. With
    ``classes`` each fold also trains a network and scores the weighted ensemble;
    without it ``tree_weight`` is 1.
    """
    if folds < 3:
        raise ValueError("a fold to score, one to choose by and one to fit on are needed")
    dealt = settle(stratified_folds(df, folds, key=key, seed=seed))
    rows = []
    for fold in range(folds):
        inner = (fold + 1) % folds
        fit = dealt.where(~F.col("fold").isin(fold, inner)).drop("fold")
        choose = dealt.where(F.col("fold") == inner).drop("fold")
        held = dealt.where(F.col("fold") == fold).drop("fold")
        trees = train_trees(fit, choose, features, trials=trials, seed=seed)
        network, weights = None, (1.0, 0.0)
        if classes is not None:
            network = train_network(fit, features, classes, epochs=epochs, seed=seed)
            weights = tune_weights(trees, network, choose, features)
        scored = score_accounts(held, features, trees, network, weights)
        rows.append((fold, float(macro_f1(scored).first()["macro_f1"]), float(weights[0])))
    frame = df.sparkSession.createDataFrame(rows, "fold int, macro_f1 double, tree_weight double")
    summary = frame.agg(F.avg("macro_f1").alias("mean_f1"), F.stddev_pop("macro_f1").alias("std_f1"))
    told = frame.withColumn("_s", summary.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")
    return told.withColumn("meets_target", F.col("mean_f1") >= F1_TARGET)


def importances(model: PipelineModel, features: list[str], df: DataFrame) -> DataFrame:
    """Importance of each feature in the tree model, largest first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(name, float(v)) for name, v in zip(features, values, strict=True)]
    frame = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature")


def permutation_importances(
    model: PipelineModel, features: list[str], df: DataFrame, *, key: str, seed: int = 42, column: str = "_tree"
) -> DataFrame:
    """Fall of macro F1 when a feature's values are dealt anew, largest first.

    Rows stand in pseudo-random order, and each takes the value of the next row (the
    last that of the first): a permutation of every column by one join on positions.
    Each row then counts once per feature, and only the counts per (feature, label,
    class) are moved.
    """
    known = canonical(df.where(F.col("label").isNotNull()), features)
    order = global_position(known, shuffle_key(key, seed), F.col(key))
    whole = settle(order.select("label", "position", "total", F.array(*features).alias("_own")))
    donors = whole.select(
        F.when(F.col("position") == 1, F.col("total")).otherwise(F.col("position") - 1).alias("position"),
        F.col("_own").alias("_other"),
    )
    # Number -1 leaves the row as it is.
    tried = whole.join(donors, "position").select(
        "label", "_own", "_other", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))).alias("_changed")
    )
    mixed = [
        F.when(F.col("_changed") == i, F.col("_other")[i]).otherwise(F.col("_own")[i]).alias(name)
        for i, name in enumerate(features)
    ]
    scored = predict_with(model, tried.select("label", "_changed", *mixed), features, column, "_p")
    scores = settle(macro_f1(decide(scored, "_p"), "_changed"))
    base = scores.where(F.col("_changed") == -1).select("macro_f1").scalar()
    named = F.element_at(F.lit(list(features)), F.col("_changed") + 1)
    fallen = scores.withColumn("_base", base).where(F.col("_changed") >= 0)
    return fallen.select(
        named.alias("feature"), (F.col("_base") - F.col("macro_f1")).alias("importance")
    ).orderBy(F.desc("importance"), "feature")


def save_model(model: PipelineModel, path: str, metadata: dict, df: DataFrame) -> None:
    """Write the model with its metadata (features, label names, weights) beside it."""
    model.write().overwrite().save(f"{path}/model")
    frame = df.sparkSession.createDataFrame([(json.dumps(metadata),)], "value string")
    frame.write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    return PipelineModel.load(f"{path}/model"), metadata
