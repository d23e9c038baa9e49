"""Evaluation of class predictions, from counts only.

Predictions are rows with ``label``, ``predicted`` and, where needed, an array
of class probabilities. Every metric starts from counts per (label, predicted),
so map tasks reduce the rows before anything is moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyscope.functions.groups import exact_tiles, one_row
from tallyscope.functions.scalars import listed

F1_TARGET = 0.85


def ensemble(first: Column, second: Column | None, weights: Sequence[float] = (0.5, 0.5)) -> Column:
    """Weighted class probabilities; the first model alone if there is no second."""
    if second is None:
        return first
    a, b = weights
    return F.zip_with(first, second, lambda x, y: x * F.lit(float(a)) + y * F.lit(float(b)))


def decide(df: DataFrame, probability: str, names: Sequence[str] | None = None) -> DataFrame:
    """Most probable class (the first among equals) and its probability."""
    best = F.array_max(probability)
    position = (F.array_position(probability, best) - 1).cast("int")
    label = position if names is None else F.element_at(F.lit(list(names)), position + 1)
    return df.withColumn("predicted", label).withColumn("confidence", best)


def confusion_counts(predictions: DataFrame, *by: str) -> DataFrame:
    """Rows and summed confidence per actual and predicted class."""
    counts = [F.count(F.lit(1)).alias("n")]
    if "confidence" in predictions.columns:
        counts.append(F.sum("confidence").alias("confidence"))
    return predictions.groupBy(*by, "label", "predicted").agg(*counts)


def class_counts(confusion: DataFrame, *by: str) -> DataFrame:
    """True positives, predicted and actual members per class."""
    # Each count belongs to its actual and to its predicted class.
    sides = F.explode(
        F.array(
            F.struct(F.col("label").alias("class"), F.lit(True).alias("actual")),
            F.struct(F.col("predicted").alias("class"), F.lit(False).alias("actual")),
        )
    )
    sure = F.col("confidence") if "confidence" in confusion.columns else F.lit(None).cast("double")
    rows = confusion.withColumn("_c", sure).withColumn("_s", sides)
    rows = rows.select(*by, "n", "label", "predicted", "_c", "_s.*")
    hit = F.col("actual") & (F.col("label") == F.col("predicted"))
    zero = F.lit(0)
    return rows.groupBy(*by, "class").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), zero).alias("hits"),
        F.coalesce(F.sum(F.when(~F.col("actual"), F.col("n"))), zero).alias("guesses"),
        F.coalesce(F.sum(F.when(F.col("actual"), F.col("n"))), zero).alias("support"),
        F.sum(F.when(F.col("actual"), F.col("_c"))).alias("confidence"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1() -> Column:
    return _ratio(2 * F.col("hits"), F.col("guesses") + F.col("support"))


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with the overall figures.

    The predictions are read once; the overall figures come from a window over
    the one row per class.
    """
    counted = class_counts(confusion_counts(predictions)).withColumn("f1", _f1())
    w = Window.partitionBy(F.lit(0))
    macro = F.avg("f1").over(w)
    sure = F.try_divide(F.sum("confidence").over(w), F.sum("support").over(w).cast("double"))
    return counted.select(
        "class",
        _ratio(F.col("hits"), F.col("guesses")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        "f1",
        "support",
        macro.alias("macro_f1"),
        sure.alias("mean_confidence"),
        (macro >= F1_TARGET).alias("meets_target"),
    )


def macro_f1(predictions: DataFrame, *by: str) -> DataFrame:
    """Unweighted mean of the class F1 scores."""
    counted = class_counts(confusion_counts(predictions, *by), *by)
    return counted.withColumn("f1", _f1()).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def confusion_matrix(predictions: DataFrame, classes: Sequence) -> DataFrame:
    """Actual classes as rows, predicted classes as columns; a predicted class must be listed."""
    counted = confusion_counts(predictions)
    counted = counted.withColumn("predicted", listed(F.col("predicted"), classes))
    return counted.groupBy("label").pivot("predicted", list(classes)).agg(F.sum("n")).fillna(0)


def search_weights(
    predictions: DataFrame, first: str, second: str, *, steps: int = 20
) -> DataFrame:
    """Macro F1 for evenly spaced ensemble weights, in one aggregated pass."""
    grid = F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)]))
    tried = predictions.select("label", first, second, grid.alias("weight"))
    mixed = F.zip_with(first, second, lambda x, y: x * F.col("weight") + y * (1.0 - F.col("weight")))
    return macro_f1(decide(tried.withColumn("_p", mixed), "_p"), "weight")


def best_weight(searched: DataFrame) -> DataFrame:
    """The best weight; among equals the one nearest to one half, then the lower."""
    near = F.abs(F.col("weight") - 0.5)
    return searched.orderBy(F.round("macro_f1", 9).desc(), near, "weight").limit(1)


def calibration(predictions: DataFrame, probability: str, bins: int = 10, min_positive: int = 5) -> DataFrame:
    """Mean predicted probability and positive share per class and uniform bin."""
    exploded = predictions.select("label", F.posexplode(probability).alias("class", "p"))
    edge = sum((F.when(F.col("p") > i / bins, 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    binned = exploded.groupBy("class", edge.alias("bin")).agg(
        F.avg("p").alias("mean_predicted"),
        F.count(F.when(F.col("label") == F.col("class"), 1)).alias("positives"),
        F.count(F.lit(1)).alias("n"),
    )
    enough = F.sum("positives").over(Window.partitionBy("class"))
    return (
        binned.withColumn("_all", enough)
        .where(F.col("_all") >= min_positive)
        .select("class", "bin", "mean_predicted", (F.col("positives") / F.col("n")).alias("fraction_positive"), "n")
    )


def regression_check(baseline: DataFrame, current: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Whether a metric is missing or fell by more than the tolerated share of its baseline."""
    base = baseline.select("metric", F.col("value").alias("baseline"))
    now = current.select("metric", F.col("value").alias("current"))
    change = F.try_divide(F.col("current") - F.col("baseline"), F.col("baseline"))
    return base.join(now, "metric", "left").select(
        "metric",
        "baseline",
        "current",
        change.alias("change"),
        (F.col("current").isNull() | (F.coalesce(change, F.lit(0.0)) < -tolerance)).alias("failed"),
    )


def drift_report(
    baseline: DataFrame, current: DataFrame, features: list[str], *, bins: int = 10, threshold: float = 0.2
) -> DataFrame:
    """Population stability index per feature over the baseline's deciles.

    The bounds are values of exact rank; those of all features are one row, and both
    tables are only counted.
    """
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]))
    tiles = exact_tiles(baseline.select(values.alias("i")).select("i.*"), ["feature"], "value", bins, "bounds")
    bounds = one_row(tiles.agg(*[F.max(F.when(F.col("feature") == c, F.col("bounds"))).alias(c) for c in features]))
    floor = 1e-4

    def stats(df: DataFrame, which: int) -> DataFrame:
        items = F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(c).cast("double").alias("value"),
                        F.col("_b")[c].alias("bounds"),
                    )
                    for c in features
                ]
            )
        )
        rows = df.withColumn("_b", bounds).select(items.alias("i")).select("i.*")
        above = F.size(F.filter("bounds", lambda b: b < F.col("value")))
        return rows.where(F.col("value").isNotNull()).groupBy("feature", above.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")
        ).withColumn("which", F.lit(which))

    # At most 2 * features * bins rows from here on.
    counts = stats(baseline, 0).unionByName(stats(current, 1))
    wide = counts.groupBy("feature", "bin").agg(
        *[F.coalesce(F.sum(F.when(F.col("which") == w, F.col(x))), F.lit(0)).alias(f"{x}{w}")
          for w in (0, 1) for x in ("n", "s")]
    )
    w = Window.partitionBy("feature")
    share = {i: F.greatest(_ratio(F.col(f"n{i}"), F.sum(f"n{i}").over(w)), F.lit(floor)) for i in (0, 1)}
    scored = wide.withColumn("_t", (share[1] - share[0]) * F.ln(share[1] / share[0]))
    psi = F.sum("_t")
    return scored.groupBy("feature").agg(
        F.try_divide(F.sum("s0"), F.sum("n0").cast("double")).alias("baseline_mean"),
        F.try_divide(F.sum("s1"), F.sum("n1").cast("double")).alias("current_mean"),
        psi.alias("psi"),
        (psi > threshold).alias("drift_detected"),
    )
