"""Relational building blocks that stay even when one group holds most rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyscope.session import settle

CHUNK = "_chunk"

# A side of a join may be broadcast up to this many narrow rows.
BROADCAST_ROWS = 1_000_000
SALTS = 64
# Rows of a key in one chunk of time, up to those of an hour more.
CHUNK_ROWS = 1_000_000
# A group of up to this many values is sorted as one array.
SORTED_ROWS = 100_000


def one_row(stats: DataFrame) -> Column:
    """A one-row frame as a struct column: an uncorrelated scalar subquery.

    Spark runs it once and hands the value to every task as a literal, where
    a window over all rows would move the whole table into one task.
    """
    return stats.select(F.struct("*").alias("stats")).scalar()


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    # A limit would bring up to its number of rows of every partition to one task.
    return df.count() <= limit


def heavy_keys(df: DataFrame, on: str, share: float) -> DataFrame:
    """Keys that hold more than ``share`` of the rows, as one column ``on``.

    From a mergeable frequent-items summary of bounded size, in one pass without a
    shuffle of rows or keys. It may name a few lighter keys too, but misses none.
    """
    # The summary's error is at most 3.5 / tracked of the rows; half the share is left for it.
    tracked = min(1 << 20, max(1_024, 1 << math.ceil(math.log2(7.0 / share))))
    counted = df.where(F.col(on).isNotNull()).agg(
        F.count(F.lit(1)).alias("_rows"), F.expr(f"approx_top_k(`{on}`, {tracked // 2}, {tracked})").alias("_top")
    )
    found = counted.select("_rows", F.explode("_top").alias("_t"))
    return found.where(F.col("_t.count") >= F.col("_rows") * (share / 2)).select(F.col("_t.item").alias(on))


def _join_small_or_salted(
    df: DataFrame, side: DataFrame, on: str, how: str, limit: int
) -> DataFrame:
    """Join rows to a keyed side, by broadcast or by key, heavy keys by key and salt.

    A side of a checked size is broadcast. Of a larger one only the rows of heavy keys
    are repeated ``SALTS`` times, and only the rows of ``df`` with such keys are dealt
    over the salts; without a heavy key it is a plain join by key. Heavy is a key with
    half the rows of an average task or more. The checks read ``side`` and the key of
    ``df`` once more, so both should be stored tables.
    """
    side = side.where(F.col(on).isNotNull())
    if is_small(side, limit):
        return df.join(F.broadcast(side), on, how)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    heavy = settle(heavy_keys(df, on, 0.5 / tasks))
    if heavy.isEmpty():
        return df.join(side, on, how)
    # At most four keys per task: a proven bound.
    heavy = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    others = [F.col(f"`{c}`") for c in df.columns if c != on] or [F.col(on)]
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = df.join(heavy, on, "left").withColumn("_salt", salt).drop("_heavy")
    salts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = side.join(heavy, on, "left").withColumn("_salt", F.explode(salts)).drop("_heavy")
    return salted.join(spread, [on, "_salt"], how).drop("_salt")


def _by_keys(df: DataFrame, keys: DataFrame, on: str, how: str, limit: int) -> DataFrame:
    keys = keys.select(F.col(keys.columns[0]).alias(on))
    # Repeated keys do no harm here; they only matter if they make the set large.
    if is_small(keys, limit):
        joined = df.join(F.broadcast(keys.where(F.col(on).isNotNull())), on, how)
    else:
        joined = _join_small_or_salted(df, keys.distinct(), on, how, limit)
    return joined.select(*df.columns)


def keep_keys(df: DataFrame, keys: DataFrame, on: str, *, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``on`` occurs in the one-column frame ``keys``."""
    return _by_keys(df, keys, on, "left_semi", limit)


def drop_keys(df: DataFrame, keys: DataFrame, on: str, *, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``on`` does not occur in ``keys``."""
    return _by_keys(df, keys, on, "left_anti", limit)


def flag_keys(
    df: DataFrame, keys: DataFrame, on: str, flag: str, *, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Add a column that tells whether ``on`` occurs in ``keys``."""
    side = keys.select(F.col(keys.columns[0]).alias(on)).distinct().withColumn("_found", F.lit(True))
    matched = _join_small_or_salted(df, side, on, "left", limit)
    return matched.select(*df.columns, F.coalesce("_found", F.lit(False)).alias(flag))


def attach(df: DataFrame, side: DataFrame, on: str, *, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Add the columns of ``side`` (one row per ``on``); NULL where it has none."""
    added = [c for c in side.columns if c != on]
    matched = _join_small_or_salted(df, side, on, "left", limit)
    return matched.select(*df.columns, *added)


def both_sides(df: DataFrame, *, once: bool = False, key: str = "wallet_address") -> DataFrame:
    """One row per row and participating account, in one pass over ``df``.

    ``once`` gives a transfer to oneself a single row instead of two.
    """
    ends = F.array(F.lower("from_address"), F.lower("to_address"))
    if once:
        ends = F.array_distinct(ends)
    return df.withColumn(key, F.explode(ends)).where(F.col(key).isNotNull())


def best_row(df: DataFrame, by: Sequence[str], order: Column, *, largest: bool = True) -> DataFrame:
    """The row of each key with the largest (or smallest) ``order``.

    An aggregate, so map tasks reduce each key to one row before the shuffle.
    """
    rest = [c for c in df.columns if c not in by]
    pick = (F.max_by if largest else F.min_by)(F.struct(*rest), order)
    return df.groupBy(*by).agg(pick.alias("_best")).select(*by, "_best.*").select(*df.columns)


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group with their rank.

    Spark limits each group before the shuffle when ``k`` is below its window
    group limit. Above it the group is cut per salt first, so at most
    ``SALTS * k`` rows of a group meet in one task.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        everything = [F.col(f"`{c}`") for c in df.columns]
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*everything), F.lit(SALTS)))
        first = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = df.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
        df = df.drop("_salt", "_r")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def range_chunks(df: DataFrame, *order: Column | str) -> DataFrame:
    """Cut the rows, in this order, into even consecutive chunks.

    Spark's range partitioning samples the full key, so a hot leading key is
    cut over many chunks, and chunk numbers follow the order.
    """
    return df.repartitionByRange(*order).withColumn(CHUNK, F.spark_partition_id())


def time_chunks(df: DataFrame, keys: Sequence[str], ts: str, *, rows: int | None = None) -> DataFrame:
    """Number consecutive chunks of time inside each key, in a column ``CHUNK``; NULL times come first.

    Only keys with more than ``rows`` rows are cut, between hours, about every ``rows``
    rows. Rows are counted but not moved, so the only exchange of rows is that of the
    window by key and chunk which follows.
    """
    rows = CHUNK_ROWS if rows is None else rows
    hour = F.coalesce(F.floor(F.unix_seconds(ts) / 3600), F.lit(-(1 << 60)))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) <= rows:
        return df.withColumn(CHUNK, F.lit(0).cast("bigint"))
    hot = settle(counts.where(F.col("_n") > rows).drop("_n"))

    def joined(left: DataFrame, right: DataFrame, names: Sequence[str], how: str) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns])
        same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names]
        side = F.broadcast(right) if is_small(right) else right
        return left.join(side, same, how).drop(*[f"_r_{c}" for c in names])

    timed = df.withColumn("_hour", hour)
    hours = joined(timed.select(*keys, "_hour"), hot, keys, "left_semi").groupBy(*keys, "_hour").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.floor(F.coalesce(F.sum("_n").over(earlier), F.lit(0)) / rows).alias("_cut")
    numbered = joined(timed, settle(hours.select(*keys, "_hour", cut)), [*keys, "_hour"], "left")
    return numbered.withColumn(CHUNK, F.coalesce("_cut", F.lit(0)).cast("bigint")).drop("_cut", "_hour")


def global_position(
    df: DataFrame, *order: Column, name: str = "position", size: str = "total"
) -> DataFrame:
    """Number all rows 1..n in the given (total) order, without one sorting task.

    The sorted chunks are settled once, so both readers see the same chunks.
    Only one size per chunk meets in a single task. ``size`` becomes n.
    """
    low_bits = (1 << 33) - 1
    ordered = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn(CHUNK, F.shiftright("_id", 33))
        .withColumn("_at", F.col("_id").bitwiseAND(F.lit(low_bits)))
        .drop("_id")
    )
    sizes = ordered.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    all_chunks = Window.partitionBy(F.lit(0))
    earlier = all_chunks.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        CHUNK,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_n").over(all_chunks).alias(size),
    )
    # One row per partition: a proven bound for the broadcast.
    placed = ordered.join(F.broadcast(starts), CHUNK)
    return placed.select(*df.columns, (F.col("_start") + F.col("_at") + 1).alias(name), size)


def group_position(
    df: DataFrame, by: str, *order: Column, name: str = "position", size: str = "group_size"
) -> DataFrame:
    """Number the rows 1..n inside each group; a hot group spans many chunks.

    For few groups (labels, clusters): the group table is joined by its size.
    """
    placed = global_position(df, F.col(by).asc_nulls_first(), *order, name="_all")
    # A missing group is a group of its own, so the join key must not be NULL.
    placed = placed.withColumn(
        "_group", F.concat(F.col(by).isNull().cast("string"), F.coalesce(F.col(by).cast("string"), F.lit("")))
    )
    groups = placed.groupBy("_group").agg(F.min("_all").alias("_first"), F.count(F.lit(1)).alias(size))
    joined = attach(placed, groups, "_group")
    return joined.select(*df.columns, (F.col("_all") - F.col("_first") + 1).alias(name), size)


def tile(position: Column, total: Column, tiles: int) -> Column:
    """The ``ntile`` of a row number: earlier tiles take the remainder."""
    small = F.floor(total / tiles)
    extra = total % tiles
    edge = extra * (small + 1)
    return (
        F.when(position <= edge, F.floor((position - 1) / (small + 1)) + 1)
        .otherwise(extra + F.floor((position - 1 - edge) / F.greatest(small, F.lit(1))) + 1)
        .cast("int")
    )


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group as a double: the mean of the two middle values of an even number."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    middle = exact_ranks(rows, by, "_v", ["(_all + 1) div 2", "(_all + 2) div 2"], "_middle")
    return middle.select(*by, ((F.col("_middle")[0] + F.col("_middle")[1]) / 2).alias(name))


def exact_tiles(df: DataFrame, by: Sequence[str], value: str, parts: int, name: str) -> DataFrame:
    """Per group the ``parts - 1`` values of exact rank ceil(n * i / parts), as an array (the median for two parts)."""
    return exact_ranks(df, by, value, [f"(_all * {i} + {parts - 1}) div {parts}" for i in range(1, parts)], name)


def exact_ranks(
    df: DataFrame, by: Sequence[str], value: str, ranks: Sequence[str], name: str, *, limit: int | None = None
) -> DataFrame:
    """Per group the values of the given ranks, as an array; ``ranks`` are SQL of the number of values ``_all``.

    A group of up to ``limit`` rows is sorted by one aggregate. Larger ones, found by
    counting, go by range chunks of their counts per value, and no task needs one
    whole. NULL values have no rank; a group of only such values gets NULLs. ``by``
    must not be NULL.
    """
    limit = SORTED_ROWS if limit is None else limit
    keys = list(by) or ["_everything"]
    rows = df.select(*(by or [F.lit(0).alias("_everything")]), F.col(value).alias("_v"))
    counts = rows.groupBy(*keys).agg(F.count("_v").alias("_rows"))
    if (counts.agg(F.max("_rows")).first()[0] or 0) <= limit:
        return _ranks_by_sorting(rows, keys, ranks, name).select(*by, name)
    large = settle(counts.where(F.col("_rows") > limit).drop("_rows"))
    # So many groups at most: the rows over the limit.
    side = F.broadcast(large) if is_small(large) else large
    ordinary = _ranks_by_sorting(rows.join(side, keys, "left_anti"), keys, ranks, name)
    return ordinary.union(_ranks_by_chunks(rows.join(side, keys, "left_semi"), keys, ranks, name)).select(*by, name)


def _ranks_by_sorting(rows: DataFrame, keys: Sequence[str], ranks: Sequence[str], name: str) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_sorted")).withColumn("_all", F.size("_sorted"))
    wanted = ", ".join(f"get(_sorted, CAST({rank} AS INT) - 1)" for rank in ranks)
    return found.select(*keys, F.expr(f"array({wanted})").alias(name))


def _ranks_by_chunks(rows: DataFrame, keys: Sequence[str], ranks: Sequence[str], name: str) -> DataFrame:
    """Counts per (group, value) in range chunks; only chunks that hold a wanted rank are ranked, each by itself."""
    counts = rows.where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    chunks = settle(range_chunks(counts, *keys, "_v"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    every = F.expr("array(" + ", ".join(f"struct({i} AS i, {rank} AS r)" for i, rank in enumerate(ranks)) + ")")

    def held(begin: Column, end: Column) -> Column:
        return F.filter("_ranks", lambda x: (x["r"] > begin) & (x["r"] <= end))

    wanted = (
        chunks.groupBy(*keys, CHUNK)
        .agg(F.sum("_c").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_all", F.sum("_n").over(group))
        .withColumn("_ranks", every)
        .withColumn("_ranks", held(F.col("_before"), F.col("_before") + F.col("_n")))
        .where(F.size("_ranks") > 0)
        .drop("_n")
    )
    upto = Window.partitionBy(*keys, CHUNK).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    seen = chunks.join(wanted, [*keys, CHUNK]).withColumn("_seen", F.col("_before") + F.sum("_c").over(upto))
    found = seen.select(*keys, "_v", F.explode(held(F.col("_seen") - F.col("_c"), F.col("_seen"))).alias("_r"))
    in_order = F.sort_array(F.collect_list(F.struct("_r.i", "_v")))
    return found.groupBy(*keys).agg(F.transform(in_order, lambda x: x["_v"]).alias(name))
