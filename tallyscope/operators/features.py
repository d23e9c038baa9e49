"""The twelve behavioural features on the account-exploded ledger.

Rhythm features come from one aggregate by account, day and hour; the later
levels only read that small table. Missing activity counts as 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.groups import exact_median, one_row
from tallyscope.functions.ordered import closed_pairs, running_peak
from tallyscope.functions.scalars import share_where
from tallyscope.functions.shares import concentration, entropy_from_sums
from tallyscope.schemas import FEATURES, KEY
from tallyscope.session import settle

HOURS = range(24)


def by_day(ledger: DataFrame) -> DataFrame:
    """Counts per account and day with the day's hourly shape.

    Two shrinking aggregates: (account, day, hour), then (account, day).
    """
    ts = F.col("block_timestamp")
    gas = F.col("gas_price").cast("double") if "gas_price" in ledger.columns else F.lit(None).cast("double")
    data = F.length(F.col("input").cast("string")) > 2 if "input" in ledger.columns else F.lit(False)
    hourly = ledger.groupBy(KEY, F.to_date(ts).alias("_day"), F.hour(ts).alias("_hour")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(gas).alias("_gas"),
        F.count(gas).alias("_gas_n"),
        F.min(ts).alias("_from"),
        F.max(ts).alias("_to"),
        F.max(data).alias("_data"),
    )
    return hourly.groupBy(KEY, "_day").agg(
        F.sum("_n").alias("_n"),
        F.max("_n").alias("_busiest"),
        F.count(F.lit(1)).alias("_hours"),
        F.sum("_gas").alias("_gas"),
        F.sum("_gas_n").alias("_gas_n"),
        F.min("_from").alias("_from"),
        F.max("_to").alias("_to"),
        F.max("_data").alias("_data"),
        *hour_sums("_n"),
    )


def hour_sums(count: str) -> list[Column]:
    """The expression ``count`` summed per hour of day, as columns ``_h0``..``_h23``."""
    return [F.expr(f"sum(CASE WHEN _hour = {h} THEN {count} END)").alias(f"_h{h}") for h in HOURS]


def hour_entropy(total: Column, base2: bool) -> Column:
    """Entropy over the 24 hour sums of a ``by_day`` group."""
    log, sql_log = (F.log2, "log2") if base2 else (F.ln, "ln")
    # SQL text: hundreds of single column calls would slow down planning.
    c = [f"CAST(sum(_h{h}) AS DOUBLE)" for h in HOURS]
    parts = F.expr(" + ".join(f"coalesce({x} * {sql_log}({x}), 0D)" for x in c))
    return entropy_from_sums(total, parts, log(total))


def rhythm_features(ledger: DataFrame) -> DataFrame:
    """Frequency, regularity, entropy, weekend ratio, gas, code flag, bursts."""
    days = by_day(ledger)
    total = F.sum("_n").cast("double")
    span = (F.unix_micros(F.max("_to")) - F.unix_micros(F.min("_from"))) / F.lit(86_400e6)
    weekend = F.sum(F.when(F.weekday("_day") >= 5, F.col("_n")).otherwise(0))
    weekday = F.sum(F.when(F.weekday("_day") < 5, F.col("_n")).otherwise(0))
    priced = F.when(F.col("_gas_n") > 0, F.col("_n").cast("double"))
    price = F.try_divide(F.col("_gas"), F.col("_gas_n"))
    # Written out, since ``corr`` fails on a constant column in ANSI mode.
    paired = F.when(price.isNotNull(), priced)
    spread = F.stddev_pop(paired) * F.stddev_pop(price)
    gas = F.when(spread > 0, F.try_divide(F.covar_pop(paired, price), spread))
    return days.groupBy(KEY).agg(
        F.when(span == 0, total).otherwise(F.try_divide(total, span)).alias("tx_frequency_per_day"),
        F.when(F.count("_day") > 1, F.stddev_samp("_n")).otherwise(0.0).alias("activity_regularity"),
        hour_entropy(total, base2=True).alias("hour_of_day_entropy"),
        F.when(weekday == 0, weekend.cast("double"))
        .otherwise(F.try_divide(weekend.cast("double"), weekday.cast("double")))
        .alias("weekend_vs_weekday_ratio"),
        F.when(F.count(paired) >= 3, F.coalesce(F.nanvl(gas, F.lit(0.0)), F.lit(0.0)))
        .otherwise(0.0)
        .alias("gas_price_sensitivity"),
        F.max(F.coalesce(F.col("_data"), F.lit(False))).cast("double").alias("is_contract"),
        (F.max("_busiest") * F.sum("_hours") / total).alias("burst_score"),
    )


def holding_duration(transfers: DataFrame) -> DataFrame:
    """Mean hours between a token inflow and the outflow that follows it."""
    incoming = F.lower("to_address") == F.col(KEY)
    rows = transfers.select(
        KEY,
        "token_address",
        "block_timestamp",
        "transaction_hash",
        # Inside one transaction the inflow comes first.
        (~incoming).alias("_out"),
    )
    # Stored: whoever removed repeated transfers need not do so again for counting them.
    pairs = closed_pairs(
        settle(rows),
        [KEY, "token_address"],
        ["block_timestamp", "transaction_hash", "_out"],
        ~F.col("_out"),
    )
    hours = F.try_divide(F.sum("seconds"), F.sum("pairs").cast("double")) / 3600.0
    return pairs.groupBy(KEY).agg(
        F.coalesce(hours, F.lit(0.0)).alias("avg_holding_duration_estimate")
    )


def protocol_ratios(calls: DataFrame, dex: list[str], lending: list[str]) -> DataFrame:
    """Shares of calls that go to exchange routers and to lending protocols."""
    callee = F.lower("to_address")
    return calls.groupBy(KEY).agg(
        share_where(callee.isin(dex)).alias("dex_to_total_ratio"),
        share_where(callee.isin(lending)).alias("lending_to_total_ratio"),
    )


def counterparty_concentration(ledger: DataFrame) -> DataFrame:
    """Herfindahl index of receivers over all ledger rows of an account."""
    pairs = (
        ledger.where(F.col("to_address").isNotNull())
        .groupBy(KEY, "to_address")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return pairs.groupBy(KEY).agg(concentration(F.col("_n")).alias("counterparty_concentration"))


def value_velocity(ledger: DataFrame) -> DataFrame:
    """Outbound volume over the peak of the running balance."""
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    outbound = F.lower("from_address") == F.col(KEY)
    sums = running_peak(
        ledger,
        KEY,
        ["block_timestamp", "hash"],
        F.when(outbound, -value).otherwise(value),
        {"_sent": F.when(outbound, value).otherwise(0.0), "_all": value},
    )
    moved = F.when(F.col("_sent") == 0, F.col("_all")).otherwise(F.col("_sent"))
    return sums.select(
        KEY,
        F.when(F.col("peak") == 0, 0.0).otherwise(F.try_divide(moved, F.col("peak"))).alias("value_velocity"),
    )


def all_features(
    ledger: DataFrame, transfers: DataFrame, calls: DataFrame, dex: list[str], lending: list[str]
) -> DataFrame:
    """All twelve features, one row per account that has transactions.

    Every part ends in an aggregate by account, so the joins find their inputs
    already partitioned by their key.
    """
    joined = rhythm_features(ledger)
    for part in (
        counterparty_concentration(ledger),
        value_velocity(ledger),
        holding_duration(transfers),
        protocol_ratios(calls, dex, lending),
    ):
        joined = joined.join(part, KEY, "left")
    return joined.select(KEY, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FEATURES])


def impute(df: DataFrame, numeric: list[str], text: list[str] = ()) -> DataFrame:
    """Fill gaps: the median for numbers, the most frequent value for text."""
    # NaN counts as missing, as in a data frame library.
    clean = df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in numeric else F.col(c)
            for c in df.columns
        ]
    )
    long = clean.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        [], numeric, "feature", "value"
    )
    medians = exact_median(long, ["feature"], "value", "fill")
    fills = medians.agg(
        *[F.max(F.when(F.col("feature") == c, F.col("fill"))).alias(c) for c in numeric]
    )
    fill = one_row(fills)
    result = clean.withColumn("_fill", fill)
    for c in numeric:
        result = result.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col("_fill")[c]))
    result = result.drop("_fill")
    for c in text:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        # Ties go to the smallest value.
        best = counts.agg(F.min_by(F.col(c), F.struct(-F.col("_n"), F.col(c))).alias("fill"))
        result = result.withColumn("_fill", one_row(best)).withColumn(
            c, F.coalesce(F.col(c), F.col("_fill.fill"), F.lit("unknown"))
        )
        result = result.drop("_fill")
    return result.select(*df.columns)


def _spread(df: DataFrame, columns: list[str], spread) -> Column:
    stats = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[spread(c).alias(f"{c}_std") for c in columns],
    )
    return one_row(stats)


def standardise(
    df: DataFrame,
    columns: list[str],
    *,
    population: bool = False,
    constant: float | None = 0.0,
    suffix: str = "",
) -> DataFrame:
    """Z-scores over the whole table; a constant column becomes ``constant``."""
    spread = F.stddev_pop if population else F.stddev_samp
    scored = df.withColumn("_s", _spread(df, columns, spread))
    std = {c: F.col("_s")[f"{c}_std"] for c in columns}
    z = {
        c: F.when(std[c] > 0, (F.col(c) - F.col("_s")[f"{c}_mean"]) / std[c])
        .otherwise(F.lit(constant).cast("double"))
        .alias(f"{c}{suffix}")
        for c in columns
    }
    if suffix:
        return scored.select(*df.columns, *z.values())
    return scored.select(*[z.get(c, F.col(c)) for c in df.columns])


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale columns to [0, 1]; a constant column becomes 0."""
    ends = df.agg(
        *[F.min(c).alias(f"{c}_min") for c in columns], *[F.max(c).alias(f"{c}_max") for c in columns]
    )
    scaled = df.withColumn("_e", one_row(ends))
    exprs = {}
    for c in columns:
        low, high = F.col("_e")[f"{c}_min"], F.col("_e")[f"{c}_max"]
        exprs[c] = F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0).alias(c)
    return scaled.select(*[exprs.get(c, F.col(c)) for c in df.columns])


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, maximum, mean and population deviation, one row per feature; none for an empty table.

    One wide aggregate, of which only the single result row is turned into long form.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.avg(x).alias("mean"),
                F.stddev_pop(x).alias("std"),
            ).alias(c)
            for c, x in values.items()
        ],
    )
    stats = wide.where("_rows > 0").select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("_s"))
    return stats.select("_s.*")
