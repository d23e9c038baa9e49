"""Account sampling, staging tables, feature table and mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.groups import both_sides, exact_tiles, global_position, tile, top_k
from tallyscope.functions.scalars import count_where, in_window, safe_divide
from tallyscope.functions.shares import concentration, entropy_from_sums
from tallyscope.functions.wei import add_limbs, in_units, join_parts, pair_of, part_sums, total, units, wei, with_parts
from tallyscope.operators.features import hour_entropy, hour_sums, impute, standardise
from tallyscope.schemas import KEY, addresses
from tallyscope.session import settle


def account_totals(transactions: DataFrame) -> DataFrame:
    """Transactions and volume per account over both directions, in one pass; ``_volume`` is the exact sum in wei."""
    valued, parts = with_parts(transactions)
    # By day first, so that the sums of parts stay within a long.
    day = F.to_date("block_timestamp").alias("_day") if "block_timestamp" in transactions.columns else F.lit(0).alias("_day")
    days = both_sides(valued).groupBy(KEY, day).agg(F.count(F.lit(1)).alias("_n"), *part_sums(parts, "_sum"))
    sums = days.groupBy(KEY).agg(F.sum("_n").alias("tx_count"), *join_parts("_sum"))
    return sums.select(KEY, "tx_count", total("_sum").alias("_volume")).withColumn("total_eth", in_units("_volume"))


def sample_accounts(
    transactions: DataFrame,
    *,
    as_of: str,
    days: int = 365,
    min_tx: int = 10,
    min_eth: float = 1000.0,
    max_accounts: int = 5000,
) -> DataFrame:
    """Active accounts, a third of the quota from each tier of volume.

    Bounds and tiers compare exact sums of wei. Inside a tier the smallest address
    hashes are kept, so the sample does not depend on the order of the input.
    """
    recent = transactions.where(in_window(F.col("block_timestamp"), as_of, days))
    active = account_totals(recent).where((F.col("tx_count") >= min_tx) & (F.col("_volume") >= pair_of(min_eth)))
    ranked = global_position(active, F.col("_volume").desc(), F.col(KEY).asc())
    tiers = ranked.withColumn("_tier", tile(F.col("position"), F.col("total"), 3))
    kept = top_k(tiers, ["_tier"], [F.md5(KEY), F.col(KEY)], max_accounts // 3)
    return kept.orderBy(F.desc("_volume"), KEY).select(KEY, "tx_count", "total_eth")


def _recent_success(df: DataFrame, as_of: str, days: int, status: str) -> DataFrame:
    return df.where(in_window(F.col("block_timestamp"), as_of, days) & (F.col(status) == 1))


def _directed(transactions: DataFrame, *columns: str) -> DataFrame:
    """Both sides of each transaction with a direction flag, in one pass."""
    ends = F.array(
        F.struct(F.col("from_address").alias("a"), F.col("to_address").alias("b"), F.lit(True).alias("s")),
        F.struct(F.col("to_address").alias("a"), F.col("from_address").alias("b"), F.lit(False).alias("s")),
    )
    return (
        transactions.select(F.explode(ends).alias("_e"), *columns)
        .select(F.col("_e.a").alias(KEY), F.col("_e.b").alias("_other"), F.col("_e.s").alias("_sent"), *columns)
        .where(F.col(KEY).isNotNull())
    )


def median_value(transactions: DataFrame) -> DataFrame:
    """Median transferred value per account, both directions.

    The amount of exact rank ceil(n / 2), compared in wei; a hot account needs no task
    of its own.
    """
    amounts = _directed(transactions.withColumn("_wei", wei(transactions)), "_wei")
    middle = exact_tiles(amounts, [KEY], "_wei", 2, "_middle")
    return middle.select(KEY, units(F.col("_middle")[0]).alias("median_value_per_tx"))


def _account_days(transactions: DataFrame) -> DataFrame:
    """Both directions of each account by day, with the day's hourly shape.

    One pass over the ledger and two shrinking aggregates, by (account, day,
    hour) and by (account, day); totals and rhythm both come from it.
    """
    valued, parts = with_parts(transactions)
    sides = _directed(valued, "block_timestamp", "gas_price", "receipt_gas_used", *parts)
    sent = F.col("_sent")
    ts = F.col("block_timestamp")
    price = F.col("gas_price").cast("double")
    cost = F.col("receipt_gas_used").cast("double") * price / F.lit(1e18)

    def if_sent(value: Column) -> Column:
        return F.when(sent, value)

    hourly = sides.groupBy(KEY, F.to_date(ts).alias("_day"), F.hour(ts).alias("_hour")).agg(
        count_where(sent).alias("_sent_n"),
        count_where(~sent).alias("_got_n"),
        *part_sums(parts, "_sent_value", sent),
        *part_sums(parts, "_got_value", ~sent),
        F.sum(if_sent(cost)).alias("_cost"),
        F.sum(if_sent(price)).alias("_price"),
        F.count(if_sent(price)).alias("_price_n"),
        F.min(ts).alias("_from"),
        F.max(ts).alias("_to"),
    )
    n = F.col("_sent_n") + F.col("_got_n")
    summed = ["_sent_n", "_got_n", "_cost", "_price", "_price_n"]
    return hourly.groupBy(KEY, "_day").agg(
        *[F.sum(c).alias(c) for c in summed],
        *join_parts("_sent_value"),
        *join_parts("_got_value"),
        F.min("_from").alias("_from"),
        F.max("_to").alias("_to"),
        F.max(n).alias("_busiest"),
        F.count(F.lit(1)).alias("_hours"),
        *hour_sums("_sent_n + _got_n"),
    )


def _total_columns(as_of: str) -> list[Column]:
    count = F.sum("_sent_n") + F.sum("_got_n")
    first = F.min("_from")
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(first)
    active = F.greatest(count_where(F.col("_sent_n") > 0), count_where(F.col("_got_n") > 0))
    gas = F.try_divide(F.sum("_price"), F.sum("_price_n"))
    return [
        count.alias("tx_count"),
        F.sum("_sent_n").alias("tx_count_sent"),
        F.sum("_got_n").alias("tx_count_received"),
        *add_limbs("_sent_value"),
        *add_limbs("_got_value"),
        first.alias("first_tx_timestamp"),
        F.max("_to").alias("last_tx_timestamp"),
        active.alias("active_days"),
        F.floor(age / F.lit(86_400_000_000)).cast("long").alias("days_since_first_tx"),
        F.coalesce(gas, F.lit(0.0)).alias("avg_gas_price"),
        F.coalesce(F.sum("_cost"), F.lit(0.0)).alias("total_gas_spent_eth"),
    ]


def _with_volumes(totals: DataFrame) -> DataFrame:
    """Settle the sums of wei; each becomes units of ether by one division."""
    pairs = {"_volume": total("_sent_value", "_got_value"), "_sent": total("_sent_value"), "_got": total("_got_value")}
    return totals.withColumns(pairs).withColumns(
        {
            "total_value_sent_eth": in_units("_sent"),
            "total_value_received_eth": in_units("_got"),
            "avg_value_per_tx": safe_divide(in_units("_volume"), F.col("tx_count")),
        }
    )


def _rhythm_columns() -> list[Column]:
    n = F.col("_sent_n") + F.col("_got_n")
    total = F.sum(n).cast("double")
    weekend = F.sum(F.when(F.weekday("_day") >= 5, n).otherwise(0))
    return [
        hour_entropy(total, base2=False).alias("hour_of_day_entropy"),
        safe_divide(weekend, F.sum(n) - weekend).alias("weekend_vs_weekday_ratio"),
        (F.max("_busiest") * F.sum("_hours") / total).alias("burst_score"),
    ]


def _partners(transactions: DataFrame) -> DataFrame:
    """Counterparties per account, and the concentration of those it sent to."""
    pairs = (
        _directed(transactions)
        .where(F.col("_other").isNotNull())
        .groupBy(KEY, "_sent", "_other")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return pairs.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("unique_counterparties"),
        concentration(F.when(F.col("_sent"), F.col("_n"))).alias("counterparty_concentration"),
    )


def _qualified(totals: DataFrame, min_tx: int, min_eth: float) -> DataFrame:
    return totals.where((F.col("tx_count") >= min_tx) & (F.col("_volume") >= pair_of(min_eth)))


STAGED_COLUMNS = [
    KEY,
    "tx_count",
    "tx_count_sent",
    "tx_count_received",
    "total_value_sent_eth",
    "total_value_received_eth",
    "avg_value_per_tx",
    "first_tx_timestamp",
    "last_tx_timestamp",
    "active_days",
    "days_since_first_tx",
    "unique_counterparties",
    "avg_gas_price",
    "total_gas_spent_eth",
    "median_value_per_tx",
]


def _with_partners(totals: DataFrame, transactions: DataFrame) -> DataFrame:
    joined = totals.join(_partners(transactions), KEY, "left").join(median_value(transactions), KEY, "left")
    return joined.withColumn("unique_counterparties", F.coalesce("unique_counterparties", F.lit(0)))


def stage_transactions(
    transactions: DataFrame,
    *,
    as_of: str,
    days: int = 90,
    min_tx: int = 10,
    min_eth: float = 1.0,
) -> DataFrame:
    """Transaction statistics per account over the window, successful only.

    Values are summed and compared in wei (``value``, or ``value_eth`` of an extract).
    Distinct days and counterparties come from pre-aggregated pairs instead of
    distinct aggregates, which would multiply the ledger rows.
    """
    good = _recent_success(transactions, as_of, days, "receipt_status")
    totals = _with_volumes(_account_days(good).groupBy(KEY).agg(*_total_columns(as_of)))
    kept = _qualified(totals, min_tx, min_eth)
    return _with_partners(kept, good).select(*STAGED_COLUMNS)


def stage_token_activity(transfers: DataFrame, *, as_of: str, days: int = 90) -> DataFrame:
    """Token variety per account.

    A share is taken per direction, token and kind; a value that is no whole
    number above 1 counts as a collectible.
    """
    recent = transfers.where(in_window(F.col("block_timestamp"), as_of, days))
    number = F.col("value").try_cast("decimal(38,0)")
    sides = _directed(recent, "token_address", "value")
    kinds = sides.groupBy(
        KEY, "_sent", "token_address", F.coalesce(number > 1, F.lit(False)).alias("_erc20")
    ).agg(F.count(F.lit(1)).alias("_n"))
    c = F.col("_n").cast("double")
    tokens = kinds.groupBy(KEY, "token_address").agg(
        F.sum("_n").alias("_n"),
        F.sum(F.when(F.col("_erc20"), F.col("_n")).otherwise(0)).alias("_n20"),
        F.max("_n").alias("_most"),
        F.sum(c * F.ln(c)).alias("_clogc"),
    )
    total = F.sum("_n").cast("double")
    return tokens.groupBy(KEY).agg(
        F.count("token_address").alias("unique_tokens_interacted"),
        F.sum("_n20").alias("erc20_transfer_count"),
        (F.sum("_n") - F.sum("_n20")).alias("erc721_transfer_count"),
        (F.max("_most") / total).alias("top_token_concentration"),
        entropy_from_sums(total, F.sum("_clogc"), F.ln(total)).alias("token_diversity_entropy"),
    )


def stage_contract_calls(
    traces: DataFrame,
    *,
    as_of: str,
    days: int = 90,
    book: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Contract calls per account and protocol category."""
    book = book or {
        c: addresses(c, "staging") for c in ("dex", "lending", "bridge", "nft_marketplace")
    }
    calls = _recent_success(traces, as_of, days, "status").where(
        (F.col("trace_type") == "call")
        & F.col("from_address").isNotNull()
        & F.col("to_address").isNotNull()
    )
    pairs = calls.groupBy(F.col("from_address").alias(KEY), "to_address").agg(
        F.count(F.lit(1)).alias("_n")
    )

    def of(category: str) -> Column:
        known = F.lower("to_address").isin(book[category])
        return F.sum(F.when(known, F.col("_n")).otherwise(0))

    return pairs.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("unique_contracts_called"),
        F.sum("_n").alias("contract_call_count"),
        of("dex").alias("dex_interaction_count"),
        of("lending").alias("lending_interaction_count"),
        of("bridge").alias("bridge_interaction_count"),
        of("nft_marketplace").alias("nft_marketplace_interaction_count"),
    )


TOKEN_COLUMNS = [
    "unique_tokens_interacted",
    "erc20_transfer_count",
    "erc721_transfer_count",
    "top_token_concentration",
    "token_diversity_entropy",
]
CALL_COLUMNS = [
    "unique_contracts_called",
    "contract_call_count",
    "dex_interaction_count",
    "lending_interaction_count",
    "bridge_interaction_count",
    "nft_marketplace_interaction_count",
]


def window_rhythm(transactions: DataFrame, *, as_of: str, days: int = 90) -> DataFrame:
    """Natural-log hour entropy, weekend ratio and bursts over both directions."""
    good = _recent_success(transactions, as_of, days, "receipt_status")
    return _account_days(good).groupBy(KEY).agg(*_rhythm_columns())


def sent_concentration(transactions: DataFrame, *, as_of: str, days: int = 90) -> DataFrame:
    """Herfindahl index of the receivers of an account's sent transactions."""
    good = _recent_success(transactions, as_of, days, "receipt_status")
    index = _partners(good).select(KEY, "counterparty_concentration")
    return index.where(F.col("counterparty_concentration").isNotNull())


def _pace_columns() -> list[Column]:
    age = F.col("days_since_first_tx")
    volume = F.col("total_value_sent_eth") + F.col("total_value_received_eth")
    return [
        safe_divide(F.col("tx_count"), age).alias("tx_frequency_per_day"),
        safe_divide(F.col("active_days"), age).alias("activity_regularity"),
        safe_divide(volume, F.col("active_days")).alias("value_velocity"),
    ]


def _share_columns() -> list[Column]:
    calls = F.col("contract_call_count")
    return [
        safe_divide(F.col("dex_interaction_count"), calls).alias("dex_to_total_ratio"),
        safe_divide(F.col("lending_interaction_count"), calls).alias("lending_to_total_ratio"),
    ]


def window_pace(staged: DataFrame) -> DataFrame:
    """Transactions, active days and volume of staged accounts per day."""
    return staged.select(KEY, *_pace_columns())


def call_shares(staged: DataFrame) -> DataFrame:
    """Shares of staged contract calls by category; NULL without calls."""
    return staged.select(KEY, *_share_columns())


def holds_code(accounts: DataFrame, contracts: DataFrame) -> DataFrame:
    """Whether each account is a known contract."""
    known = contracts.where(F.col("address").isNotNull()).select(F.col("address").alias(KEY)).distinct()
    flagged = accounts.join(known.withColumn("is_contract", F.lit(True)), KEY, "left")
    return flagged.select(*accounts.columns, F.coalesce("is_contract", F.lit(False)).alias("is_contract"))


def behavioural_features(
    transactions: DataFrame,
    transfers: DataFrame,
    traces: DataFrame,
    contracts: DataFrame,
    *,
    as_of: str,
    days: int = 90,
    book: dict[str, list[str]] | None = None,
    min_tx: int = 10,
    min_eth: float = 1.0,
) -> DataFrame:
    """Staging tables and derived features, one row per qualified account."""
    window = {"as_of": as_of, "days": days}
    good = _recent_success(transactions, as_of, days, "receipt_status")
    # Totals and rhythm share one pass, counterparties and concentration another.
    both = _with_volumes(_account_days(good).groupBy(KEY).agg(*_total_columns(as_of), *_rhythm_columns()))
    base = _with_partners(_qualified(both, min_tx, min_eth), good)
    joined = (
        holds_code(base, contracts)
        .join(stage_token_activity(transfers, **window), KEY, "left")
        .join(stage_contract_calls(traces, **window, book=book), KEY, "left")
    )
    return joined.select(
        *STAGED_COLUMNS,
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in TOKEN_COLUMNS + CALL_COLUMNS],
        *_pace_columns(),
        F.coalesce("hour_of_day_entropy", F.lit(0.0)).alias("hour_of_day_entropy"),
        "weekend_vs_weekday_ratio",
        "is_contract",
        *_share_columns(),
        F.coalesce("counterparty_concentration", F.lit(0.0)).alias("counterparty_concentration"),
        F.coalesce("burst_score", F.lit(1.0)).alias("burst_score"),
    )


SCORED = [
    "tx_count",
    "tx_count_sent",
    "tx_count_received",
    "total_value_sent_eth",
    "total_value_received_eth",
    "avg_value_per_tx",
    "median_value_per_tx",
    "active_days",
    "days_since_first_tx",
    "unique_counterparties",
    "avg_gas_price",
    "total_gas_spent_eth",
    *TOKEN_COLUMNS,
    *CALL_COLUMNS,
    "tx_frequency_per_day",
    "activity_regularity",
    "hour_of_day_entropy",
    "weekend_vs_weekday_ratio",
    "dex_to_total_ratio",
    "lending_to_total_ratio",
    "counterparty_concentration",
    "value_velocity",
    "burst_score",
]


#: Features that are NULL where their denominator is zero.
GAPPED = [
    "median_value_per_tx",
    "tx_frequency_per_day",
    "activity_regularity",
    "value_velocity",
    "weekend_vs_weekday_ratio",
    "dex_to_total_ratio",
    "lending_to_total_ratio",
]


def feature_mart(features: DataFrame, *, as_of: str, days: int = 90, fill: bool = True) -> DataFrame:
    """Z-scores of the feature table plus run metadata; a constant gives NULL.

    Gaps are filled with the feature's median first, unless ``fill`` is off: then a
    gap has no score. The features are read several times, for the medians, the
    moments and the scores, so they are stored first.
    """
    features = settle(features)
    if fill:
        features = settle(impute(features, [c for c in SCORED if c in GAPPED]))
    kept = [
        KEY,
        "is_contract",
        "first_tx_timestamp",
        "last_tx_timestamp",
        "tx_count",
        "tx_count_sent",
        "tx_count_received",
    ]
    scored = standardise(features, SCORED, constant=None, suffix="_z")
    return scored.select(
        *kept,
        *[f"{c}_z" for c in SCORED],
        F.lit(as_of).cast("timestamp").alias("feature_computed_at"),
        F.lit(days).alias("sample_window_days"),
    )
