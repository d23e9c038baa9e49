"""Classifiers and the evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators import classify, evaluate, splits
from tallyscope.plans.catalogue import VIEWS, query, r, scratch
from tallyscope.plans.cluster_queries import COLUMNS, ID, wide
from tallyscope.session import settle
from tallyscope.sources.views import Views

# Class probabilities of two models per vector, one row per class.
VIEWS["preds"] = (
    "",
    """SELECT vec_id, label, c, p1 / sum(p1) OVER (PARTITION BY vec_id) AS p1, p2 / sum(p2) OVER (PARTITION BY vec_id) AS p2
    FROM (SELECT vec_id, label % 5 AS label, c,
        list_max([abs(CAST(embedding[k] AS DOUBLE)) FOR k IN range(c + 1, len(embedding) + 1, 10)]) + CASE WHEN c = label % 5 THEN 0.08 ELSE 0 END AS p1,
        list_max([abs(CAST(embedding[k] AS DOUBLE)) FOR k IN range(c + 6, len(embedding) + 1, 10)]) + CASE WHEN c = label % 5 THEN 0.08 ELSE 0 END AS p2
        FROM embeddings, range(5) g(c))""",
)
NAMES = ["airdrop_hunter", "defi_farmer", "hodler", "mev_bot", "retail_trader"]


def decided(p: str, name: str) -> str:
    return f"""{name} AS (SELECT vec_id, label, CAST(c AS INT) AS predicted, {p} AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY {p} DESC, c) AS rn FROM preds) WHERE rn = 1)"""


def report(name: str, source: str) -> str:
    return f"""{name} AS (SELECT class, coalesce(hits / nullif(guesses, 0), 0) AS precision,
    coalesce(hits / nullif(support, 0), 0) AS recall, 2 * hits / (guesses + support) AS f1, support FROM (
    SELECT class, count(*) FILTER (label = class AND predicted = class) AS hits,
    count(*) FILTER (predicted = class) AS guesses, count(*) FILTER (label = class) AS support
    FROM {source}, (SELECT DISTINCT label AS class FROM {source} UNION SELECT predicted FROM {source})
    GROUP BY class))"""


MIXED = decided("(0.5 * p1 + 0.5 * p2)", "mixed")


def mixed(v: Views) -> DataFrame:
    both = v.predictions.withColumn("p", evaluate.ensemble(F.col("first"), F.col("second")))
    return evaluate.decide(both, "p")


@query(
    "d3_ensemble_prediction",
    f"""{MIXED} SELECT vec_id, ['{"', '".join(NAMES)}'][predicted + 1] AS predicted, {r('confidence', 'confidence')}
    FROM mixed""",
    "preds",
)
def _(v: Views):
    both = v.predictions.withColumn("p", evaluate.ensemble(F.col("first"), F.col("second")))
    return evaluate.decide(both, "p", NAMES).select(ID, "predicted", "confidence")


@query(
    "d3_single_model_prediction",
    f"""{decided('p1', 'one')} SELECT vec_id, predicted, {r('confidence', 'confidence')} FROM one""",
    "preds",
)
def _(v: Views):
    only = v.predictions.withColumn("p", evaluate.ensemble(F.col("first"), None))
    return evaluate.decide(only, "p").select(ID, "predicted", "confidence")


WEIGHTS = """tried AS (SELECT vec_id, label, w / 20.0 AS weight, c, p1 * (w / 20.0) + p2 * (1.0 - w / 20.0) AS p
    FROM preds, range(21) g(w)),
won AS (SELECT weight, label, c AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, weight
    ORDER BY p DESC, c) AS rn FROM tried) WHERE rn = 1),
per AS (SELECT weight, class, 2 * count(*) FILTER (label = class AND predicted = class)
    / (count(*) FILTER (predicted = class) + count(*) FILTER (label = class)) AS f1
    FROM won, range(5) k(class) GROUP BY 1, 2),
scored AS (SELECT weight, avg(f1) AS macro_f1 FROM per GROUP BY 1)"""


@query(
    "d4_weight_search",
    f"{WEIGHTS} SELECT {r('weight', 'weight')}, {r('macro_f1', 'macro_f1')} FROM scored",
    "preds",
)
def _(v: Views):
    return evaluate.search_weights(v.predictions, "first", "second")


@query(
    "d4_best_weight",
    f"""{WEIGHTS} SELECT {r('weight', 'weight')}, {r('macro_f1', 'macro_f1')} FROM scored AS s
    ORDER BY round(s.macro_f1, 9) DESC, abs(s.weight - 0.5), s.weight LIMIT 1""",
    "preds",
)
def _(v: Views):
    return evaluate.best_weight(evaluate.search_weights(v.predictions, "first", "second"))


@query(
    "d5_class_report",
    f"""{MIXED}, {report('rep', 'mixed')} SELECT class, {r('precision', 'precision')}, {r('recall', 'recall')},
    {r('f1', 'f1')}, support, {r('(SELECT avg(f1) FROM rep)', 'macro_f1')},
    {r('(SELECT avg(confidence) FROM mixed)', 'mean_confidence')},
    (SELECT avg(f1) FROM rep) >= 0.85 AS meets_target FROM rep""",
    "preds",
)
def _(v: Views):
    return evaluate.class_report(mixed(v))


@query(
    "d6_confusion_matrix",
    f"""{MIXED} SELECT label, {', '.join(f'count(*) FILTER (predicted = {c}) AS "{c}"' for c in range(5))}
    FROM mixed GROUP BY 1""",
    "preds",
)
def _(v: Views):
    return evaluate.confusion_matrix(mixed(v), range(5))


@query(
    "d7_calibration_curve",
    f"""b AS (SELECT *, {' + '.join(f'(CASE WHEN 0.5 * p1 + 0.5 * p2 > CAST({i} AS DOUBLE) / 10 THEN 1 ELSE 0 END)'
                                 for i in range(1, 10))} AS bin, 0.5 * p1 + 0.5 * p2 AS p FROM preds)
    SELECT CAST(c AS INT) AS class, bin, {r('avg(p)', 'mean_predicted')},
    {r('avg(CASE WHEN label = c THEN 1 ELSE 0 END)', 'fraction_positive')}, count(*) AS n FROM b
    WHERE c IN (SELECT label FROM preds WHERE c = 0 GROUP BY 1 HAVING count(*) >= 5) GROUP BY c, bin""",
    "preds",
)
def _(v: Views):
    return evaluate.calibration(mixed(v), "p")


@query(
    "d12_metric_regression",
    f"""{decided('p1', 'one')}, {decided('p2', 'two')}, {report('r1', 'one')}, {report('r2', 'two')}
    SELECT 'f1_class_' || class AS metric, {r('r1.f1', 'baseline')}, {r('r2.f1', 'current')},
    {r('(r2.f1 - r1.f1) / r1.f1', 'change')}, (r2.f1 - r1.f1) / r1.f1 < -0.02 AS failed
    FROM r1 JOIN r2 USING (class)""",
    "preds",
)
def _(v: Views):
    def metrics(column: str) -> DataFrame:
        scores = evaluate.class_report(evaluate.decide(v.predictions, column))
        return scores.select(
            F.concat(F.lit("f1_class_"), F.col("class").cast("string")).alias("metric"), F.col("f1").alias("value")
        )

    return evaluate.regression_check(metrics("first"), metrics("second"))


_DRIFT = ["c_acctbal", "c_nationkey"]
_SHARES = ", ".join(str(i / 10) for i in range(1, 10))


def _drift(feature: str) -> str:
    return f"""SELECT '{feature}' AS feature, {r('any_value(mb)', 'baseline_mean')}, {r('any_value(mc)', 'current_mean')},
    {r('sum((c - b) * ln(c / b))', 'psi')}, sum((c - b) * ln(c / b)) > 0.2 AS drift_detected FROM (
    SELECT bin, greatest(count(*) / any_value(nb), 0.0001) AS b,
    greatest(count(*) FILTER (c_acctbal > 0) / any_value(nc), 0.0001) AS c, any_value(mb) AS mb, any_value(mc) AS mc
    FROM (SELECT *, len(list_filter(q, lambda e: e < {feature})) AS bin FROM customer,
        (SELECT quantile_disc({feature}, [{_SHARES}]) AS q, count(*) AS nb, count(*) FILTER (c_acctbal > 0) AS nc,
        avg({feature}) AS mb, avg({feature}) FILTER (c_acctbal > 0) AS mc FROM customer)) GROUP BY bin)"""


@query("d13_drift_report", " UNION ALL ".join(_drift(f) for f in _DRIFT))
def _(v: Views):
    everyone = v.table("customer")
    return evaluate.drift_report(everyone, everyone.where(F.col("c_acctbal") > 0), _DRIFT)


# ---------------------------------------------------------------- models


def labelled(v: Views) -> DataFrame:
    """Feature columns with the supplied label as class number."""
    known = v.table("embeddings").select(ID, F.col("label").cast("int").alias("label"))
    return wide(v).drop("cluster").join(known, ID)


def parts(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    split = settle(splits.stratified_split(labelled(v), key=ID))
    return tuple(split.where(F.col("split") == n).drop("split") for n in ("train", "validation", "test"))


# The rows that the split leaves for testing; too small a class makes it ignore the labels.
TESTED = """strata AS (SELECT vec_id, CASE WHEN min(n) OVER () < 7 THEN NULL ELSE label END AS stratum FROM (
    SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n FROM embeddings)),
tested AS (SELECT vec_id FROM (SELECT vec_id, (row_number() OVER (PARTITION BY stratum
    ORDER BY md5('42:' || vec_id), vec_id) - 1) / count(*) OVER (PARTITION BY stratum) AS s FROM strata) WHERE s >= 0.85)"""


@query("d1_tree_classifier")
def _(v: Views):
    train, validate, test = parts(v)
    model = classify.train_trees(train, validate, COLUMNS, trials=2)
    return classify.score_accounts(test, COLUMNS, model).select(ID, "label", "predicted", "confidence")


@query("d2_network_classifier")
def _(v: Views):
    train, _validate, test = parts(v)
    model = classify.train_network(train, COLUMNS, 10, epochs=30)
    scored = evaluate.decide(classify.predict_with(model, test, COLUMNS, "_net", "p"), "p")
    return scored.select(ID, "label", "predicted", "confidence")


@query("d8_cross_validation")
def _(v: Views):
    return classify.cross_validate(labelled(v), COLUMNS, key=ID, folds=3)


@query("d8_ensemble_validation")
def _(v: Views):
    return classify.cross_validate(labelled(v), COLUMNS, key=ID, folds=3, classes=10, epochs=20)


@query("d9_batch_scoring")
def _(v: Views):
    train, validate, test = parts(v)
    trees = classify.train_trees(train, validate, COLUMNS, trials=1)
    network = classify.train_network(train, COLUMNS, 10, epochs=20)
    weights = classify.tune_weights(trees, network, validate, COLUMNS)
    # A feature that the input lacks counts as 0.
    scored = classify.score_accounts(test.drop(COLUMNS[-1]), COLUMNS, trees, network, weights)
    return scored.select(ID, "predicted", "confidence", F.posexplode("probability").alias("class", "probability"))


@query(
    "d9_prediction_evidence",
    f"""WITH {TESTED} SELECT vec_id, model, true AS sums_to_one, true AS in_range, true AS takes_the_largest
    FROM tested, (VALUES ('trees'), ('network'), ('both')) m(model)""",
)
def _(v: Views):
    train, validate, test = parts(v)
    trees = classify.train_trees(train, validate, COLUMNS, trials=1)
    network = classify.train_network(train, COLUMNS, 10, epochs=20)
    scored = classify.predict_with(trees, test, COLUMNS, "_tree", "trees")
    scored = classify.predict_with(network, scored, COLUMNS, "_net", "network")
    both = scored.withColumn("both", evaluate.ensemble(F.col("trees"), F.col("network"), (0.3, 0.7)))
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("p")) for c in ("trees", "network", "both")]))
    decided = evaluate.decide(both.select(ID, kinds.alias("_k")).select(ID, "_k.*"), "p")
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    return decided.select(
        ID,
        "model",
        ((F.abs(total - 1) < 1e-9) & (F.size("p") == 10)).alias("sums_to_one"),
        F.forall("p", lambda x: x.between(0, 1 + 1e-12)).alias("in_range"),
        F.forall("p", lambda x: x <= F.element_at("p", F.col("predicted") + 1)).alias("takes_the_largest"),
    )


@query("d11_reload_evidence", f"WITH {TESTED} SELECT vec_id, true AS same FROM tested")
def _(v: Views):
    train, validate, test = parts(v)
    model = classify.train_trees(train, validate, COLUMNS, trials=1)
    path = scratch(v.spark, "model")
    classify.save_model(model, path, {"features": COLUMNS}, train)
    loaded, metadata = classify.load_model(v.spark, path)
    told = classify.predict_with(model, test, COLUMNS, "_tree", "before")
    told = classify.predict_with(loaded, told, metadata["features"], "_tree", "after")
    return told.select(ID, (F.col("before") == F.col("after")).alias("same"))


@query("d10_feature_importance")
def _(v: Views):
    train, validate, _test = parts(v)
    model = classify.train_trees(train, validate, COLUMNS, trials=1)
    return classify.importances(model, COLUMNS, train)


@query("d10_permutation_importance")
def _(v: Views):
    train, validate, test = parts(v)
    model = classify.train_trees(train, validate, COLUMNS, trials=1)
    return classify.permutation_importances(model, COLUMNS, test, key=ID)


@query("d11_saved_model")
def _(v: Views):
    train, validate, test = parts(v)
    model = classify.train_trees(train, validate, COLUMNS, trials=1)
    path = scratch(v.spark, "model")
    classify.save_model(model, path, {"features": COLUMNS, "weights": [0.5, 0.5]}, train)
    loaded, metadata = classify.load_model(v.spark, path)
    return classify.score_accounts(test, metadata["features"], loaded).select(ID, "predicted", "confidence")
