"""Nested cross-validation and permutation importance on made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import classify

FEATURES = ["sharp", "noise"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    made = [(i, i % 2, float(i % 2) + 0.1 * float(rng.normal()), float(rng.normal())) for i in range(240)]
    return spark.createDataFrame(made, "id int, label int, sharp double, noise double")


def test_the_scored_fold_reaches_no_fit(rows, monkeypatch):
    ids = lambda df: frozenset(r["id"] for r in df.select("id").collect())
    seen = {"fit": [], "choose": [], "weights": [], "scored": []}
    trees, network, weights, score = (
        classify.train_trees,
        classify.train_network,
        classify.tune_weights,
        classify.score_accounts,
    )

    def spy_trees(train, validate, *args, **more):
        seen["fit"].append(ids(train))
        seen["choose"].append(ids(validate))
        return trees(train, validate, *args, **more)

    def spy_network(train, *args, **more):
        assert ids(train) == seen["fit"][-1]
        return network(train, *args, **more)

    def spy_weights(first, second, validate, *args):
        assert ids(validate) == seen["choose"][-1]
        return weights(first, second, validate, *args)

    def spy_score(df, *args):
        seen["scored"].append(ids(df))
        return score(df, *args)

    monkeypatch.setattr(classify, "train_trees", spy_trees)
    monkeypatch.setattr(classify, "train_network", spy_network)
    monkeypatch.setattr(classify, "tune_weights", spy_weights)
    monkeypatch.setattr(classify, "score_accounts", spy_score)
    told = classify.cross_validate(rows, FEATURES, key="id", folds=3, classes=2, epochs=10).collect()
    assert len(told) == len(seen["scored"]) == 3
    for fit, choose, scored in zip(seen["fit"], seen["choose"], seen["scored"]):
        assert not scored & (fit | choose) and not fit & choose
        assert len(scored | fit | choose) == 240
    assert frozenset().union(*seen["scored"]) == frozenset(range(240))
    f1 = [r["macro_f1"] for r in told]
    assert told[0]["mean_f1"] == pytest.approx(np.mean(f1)) and told[0]["std_f1"] == pytest.approx(np.std(f1))
    assert told[0]["meets_target"] and min(f1) > 0.9


def test_two_folds_are_too_few(rows):
    with pytest.raises(ValueError):
        classify.cross_validate(rows, FEATURES, key="id", folds=2)


def test_permuting_noise_costs_nothing(rows):
    model = classify.train_trees(rows, rows, FEATURES, trials=1)
    odd = rows.unionByName(rows.limit(1).withColumn("label", F.lit(None).cast("int")))
    told = classify.permutation_importances(model, FEATURES, odd, key="id").collect()
    assert [r["feature"] for r in told] == FEATURES
    assert told[0]["importance"] > 0.3 and abs(told[1]["importance"]) < 0.05
    # The same by hand: each row takes the next row's value in the order of the hash.
    ordered = rows.orderBy(classify.shuffle_key("id", 42), "id").toPandas()
    ordered["sharp"] = np.roll(ordered["sharp"].to_numpy(), -1)
    spark = rows.sparkSession

    def f1(df):
        scored = classify.decide(classify.predict_with(model, df, FEATURES, "_tree", "p"), "p")
        return classify.macro_f1(scored).first()["macro_f1"]

    assert told[0]["importance"] == pytest.approx(f1(rows) - f1(spark.createDataFrame(ordered, rows.schema)))
