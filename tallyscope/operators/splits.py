"""Splits and samples of account tables.

Ranks come from numbered chunks, so neither the whole table nor one large label
is ordered in a single task. Pseudo-random order is the hash of seed and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.groups import global_position, group_position
from tallyscope.schemas import KEY


def shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def interleaved_split(df: DataFrame, volume: str = "total_eth_volume", key: str = KEY) -> DataFrame:
    """Deal accounts by falling volume alternately into two halves."""
    # To the ninth digit, so that ranks do not depend on the order of addition.
    ranked = global_position(df, F.round(volume, 9).desc(), F.col(key).asc())
    odd = F.col("position") % 2 == 1
    side = F.when(odd, "discovery").otherwise("validation")
    return ranked.select(*df.columns, "position", side.alias("split"))


def spaced_sample(distances: DataFrame, by: str = "cluster", key: str = KEY, ratio: float = 0.20) -> DataFrame:
    """Evenly spaced members over each cluster's distance ranking.

    With N members, n = max(1, floor(ratio * N)) are taken, at the whole parts
    of n even steps from the first rank to the last.
    """
    ranked = group_position(distances, by, F.col("distance").asc(), F.col(key).asc())
    wanted = F.greatest(F.lit(1), F.floor(F.col("group_size") * F.lit(ratio)))
    ranked = ranked.withColumn("_r", F.col("position") - 1).withColumn("_n", wanted)
    # The step that could fall on rank r, and the rank it does fall on.
    last = "(group_size - 1)"
    ranked = ranked.withColumn(
        "_i", F.expr(f"CASE WHEN _n = 1 THEN 0 ELSE (_r * (_n - 1) + {last} - 1) DIV {last} END")
    )
    falls_on = F.expr(f"CASE WHEN _n = 1 THEN 0 ELSE (_i * {last}) DIV (_n - 1) END")
    return (
        ranked.where((falls_on == F.col("_r")) & (F.col("_i") < F.col("_n")))
        .withColumn("pick", F.col("_i").cast("int"))
        .drop("_i", "_r", "_n")
    )


def stratified_split(
    df: DataFrame,
    label: str = "label",
    key: str = KEY,
    *,
    train: float = 0.70,
    validate: float = 0.15,
    seed: int = 42,
    min_class: int = 7,
) -> DataFrame:
    """Train, validation and test parts with equal label shares.

    When the smallest label has fewer than ``min_class`` rows, the labels are
    ignored and the whole table is cut.
    """
    order = [shuffle_key(key, seed), F.col(key)]
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("n"))
    keyed = df.withColumn("_few", smallest.scalar() < min_class)
    keyed = keyed.withColumn("_stratum", F.when(~F.col("_few"), F.col(label).cast("string")))
    ranked = group_position(keyed, "_stratum", *order)
    share = (F.col("position") - 1) / F.col("group_size")
    part = (
        F.when(share < train, "train").when(share < train + validate, "validation").otherwise("test")
    )
    return ranked.select(*df.columns, part.alias("split"))


def stratified_folds(
    df: DataFrame, folds: int = 5, label: str = "label", key: str = KEY, seed: int = 42
) -> DataFrame:
    """Fold numbers 0..folds-1, dealt round robin inside each label."""
    ranked = group_position(df, label, shuffle_key(key, seed), F.col(key))
    fold = ((F.col("position") - 1) % folds).cast("int")
    return ranked.select(*df.columns, fold.alias("fold"))


def subsample(df: DataFrame, ratio: float = 0.8, key: str = KEY, seed: int = 42) -> DataFrame:
    """Exactly floor(ratio * n) rows, without replacement."""
    ranked = global_position(df, shuffle_key(key, seed), F.col(key))
    kept = ranked.where(F.col("position") <= F.floor(F.col("total") * F.lit(ratio)))
    return kept.select(*df.columns)


def explorer_page(
    df: DataFrame, sort: str, *, cluster: int | None = None, ascending: bool = False, rows: int = 100
) -> DataFrame:
    """The first rows of a cluster (or of all) by any column."""
    chosen = df if cluster is None else df.where(F.col("cluster") == cluster)
    order = F.col(sort).asc() if ascending else F.col(sort).desc()
    return chosen.orderBy(order, KEY).limit(rows)
