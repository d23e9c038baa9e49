"""Order-dependent aggregates that cut a hot group into consecutive chunks.

Each works in two steps: rows are reduced inside chunks of time, then the chunk
summaries of a group, one for most, are combined in order. Rows move once, by group
and chunk. No step needs all rows of a hot group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyscope.functions.groups import CHUNK, time_chunks


def running_peak(
    df: DataFrame, key: str, order: Sequence[str], amount: Column, extra: dict[str, Column]
) -> DataFrame:
    """Largest absolute value of the running sum of ``amount`` per key; ``order[0]`` is the time.

    ``extra`` names per-row amounts whose sums are returned beside ``peak``.
    """
    narrow = df.select(key, *order, amount.alias("_a"), *[c.alias(n) for n, c in extra.items()])
    rows = time_chunks(narrow, [key], order[0])
    upto = Window.partitionBy(key, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    chunks = (
        rows.withColumn("_run", F.sum("_a").over(upto))
        .groupBy(key, CHUNK)
        .agg(
            F.sum("_a").alias("_total"),
            F.max("_run").alias("_high"),
            F.min("_run").alias("_low"),
            *[F.sum(n).alias(n) for n in extra],
        )
    )
    earlier = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_total").over(earlier), F.lit(0.0))
    return (
        chunks.withColumn("_before", before)
        .groupBy(key)
        .agg(
            F.max(
                F.greatest(
                    F.abs(F.col("_before") + F.col("_high")), F.abs(F.col("_before") + F.col("_low"))
                )
            ).alias("peak"),
            *[F.sum(n).alias(n) for n in extra],
        )
    )


def closed_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], opens: Column) -> DataFrame:
    """Time between an opening row and the row after it, where that one closes.

    A further opening row replaces the one before it, and a closing row without
    an open one is ignored; so a pair is an opening row directly followed by a
    closing one. ``order[0]`` is the time. Returns seconds and count per key.
    """
    ts = order[0]
    rows = time_chunks(df.select(*keys, *order, opens.alias("_in")), keys, ts)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    gap = (F.unix_micros(F.lead(ts).over(inside)) - F.unix_micros(ts)) / F.lit(1e6)
    closes = F.col("_in") & ~F.lead("_in").over(inside)
    chunks = (
        rows.withColumn("_gap", F.when(closes, gap))
        .groupBy(*keys, CHUNK)
        .agg(
            F.sum("_gap").alias("_seconds"),
            F.count("_gap").alias("_pairs"),
            F.min_by(F.struct("_in", ts), F.struct(*order)).alias("_first"),
            F.max_by(F.struct("_in", ts), F.struct(*order)).alias("_last"),
        )
    )
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    following = F.lead("_first").over(across)
    crosses = F.col("_last._in") & ~following["_in"]
    step = (F.unix_micros(following[ts]) - F.unix_micros(F.col(f"_last.{ts}"))) / F.lit(1e6)
    return (
        chunks.withColumn("_step", F.when(crosses, step))
        .groupBy(*keys)
        .agg(
            (F.coalesce(F.sum("_seconds"), F.lit(0.0)) + F.coalesce(F.sum("_step"), F.lit(0.0))).alias("seconds"),
            (F.sum("_pairs") + F.count("_step")).alias("pairs"),
        )
    )
