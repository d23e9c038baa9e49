"""Rule labels: per-account statistics, rules, and the resolved label table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.groups import best_row, keep_keys
from tallyscope.functions.scalars import in_window, number_or, safe_divide
from tallyscope.schemas import KEY, LABEL_PRIORITY, OTHER_PRIORITY, PROTOCOLS, addresses

# The rule names written to the label table.
SOURCES = {
    "mev_bot": "mev_pattern_heuristic_local",
    "smart_money": "smart_money_heuristic_local",
    "defi_farmer": "dex_heavy_heuristic_local",
    "nft_trader": "nft_marketplace_heuristic_local",
    "airdrop_hunter": "airdrop_hunter_heuristic_local",
    "hodler": "whale_heuristic_local",
    "retail_trader": "default_unlabeled",
}
WAREHOUSE_SOURCES = {
    "mev_bot": "mev_pattern_heuristic",
    "defi_farmer": "dex_heavy_heuristic",
    "hodler": "whale_heuristic",
}


def _lower(addresses: Sequence[str]) -> list[str]:
    return [a.lower() for a in addresses]


def _senders(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    sender = F.lower("from_address")
    return df.withColumn("address", sender).where(~sender.isin(_lower(excluded)))


def recent(df: DataFrame, as_of: str | None, days: int | None) -> DataFrame:
    """Rows of the ``days`` days before ``as_of`` or later; all rows without them. The bound reaches the scan."""
    return df if as_of is None or days is None else df.where(in_window(F.col("block_timestamp"), as_of, days))


# ------------------------------------------------------------ statistics


def call_stats(
    calls: DataFrame, book: dict[str, list[str]] | None = None, excluded: Sequence[str] = PROTOCOLS
) -> DataFrame:
    """Calls per sender: total, distinct callees and calls per category."""
    book = book or {c: addresses(c) for c in ("dex", "nft_marketplace", "bridge")}
    pairs = (
        _senders(calls, excluded)
        .groupBy("address", F.lower("to_address").alias("_to"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )

    def of(category: str) -> Column:
        return F.sum(F.when(F.col("_to").isin(_lower(book[category])), F.col("_n")).otherwise(0))

    total = F.sum("_n")
    return pairs.groupBy("address").agg(
        total.alias("calls"),
        F.count("_to").alias("callees"),
        of("dex").alias("dex_calls"),
        (of("dex") / total).alias("dex_share"),
        (of("nft_marketplace") / total).alias("nft_share"),
        of("bridge").alias("bridge_calls"),
    )


def sender_stats(
    transactions: DataFrame, excluded: Sequence[str] = PROTOCOLS, as_of: str | None = None, days: int | None = None
) -> DataFrame:
    """Sent transactions, value and transactions per active day."""
    active = (
        _senders(recent(transactions, as_of, days), excluded)
        .groupBy("address", F.to_date("block_timestamp").alias("_day"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(number_or(F.col("value_eth"))).alias("_value"))
    )
    return (
        active.groupBy("address")
        .agg(
            F.sum("_n").alias("total_tx"),
            F.sum("_value").alias("total_eth"),
            F.count("_day").alias("active_days"),
        )
        .where(F.col("active_days") >= 1)
        .withColumn("tx_per_day", F.col("total_tx") / F.col("active_days"))
    )


def block_stats(
    transactions: DataFrame,
    dex: Sequence[str],
    excluded: Sequence[str] = PROTOCOLS,
    as_of: str | None = None,
    days: int | None = None,
) -> DataFrame:
    """Blocks with several transactions around a router, and with several routers."""
    routed = F.when(F.lower("to_address").isin(_lower(dex)), F.lower("to_address"))
    # One row per account, block and router (or none), then per block.
    per_router = (
        _senders(recent(transactions, as_of, days), excluded)
        .groupBy("address", "block_number", routed.alias("_router"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    per_block = per_router.groupBy("address", "block_number").agg(
        F.sum("_n").alias("_n"), F.count("_router").alias("_routers")
    )
    n, routers = F.col("_n"), F.col("_routers")
    return per_block.groupBy("address").agg(
        F.count(F.when((n >= 2) & (routers >= 1), 1)).alias("sandwich_blocks"),
        F.count(F.when(routers >= 2, 1)).alias("arb_blocks"),
    )


# ----------------------------------------------------------------- rules


def _labelled(df: DataFrame, label: str, source: str | None = None, *metrics: str) -> DataFrame:
    return df.select(
        "address", F.lit(label).alias("label"), F.lit(source or SOURCES[label]).alias("source"), *metrics
    )


def is_dex_heavy(min_tx: int = 50, min_share: float = 0.70) -> Column:
    return (F.col("calls") >= min_tx) & (F.col("dex_share") >= min_share)


def is_mev_bot(min_sandwich: int = 5, min_arb: int = 3) -> Column:
    return (F.col("sandwich_blocks") >= min_sandwich) | (F.col("arb_blocks") >= min_arb)


def is_whale(min_eth: float = 100.0, max_tx_per_day: float = 2.0) -> Column:
    return (F.col("total_eth") >= min_eth) & (F.col("tx_per_day") <= max_tx_per_day)


def is_nft_trader(min_tx: int = 10, min_share: float = 0.30) -> Column:
    return (F.col("calls") >= min_tx) & (F.col("nft_share") >= min_share)


def is_smart_money(min_eth: float = 50.0, min_tx_per_day: float = 1.0, min_share: float = 0.30) -> Column:
    return (
        (F.col("total_eth") >= min_eth)
        & (F.col("tx_per_day") >= min_tx_per_day)
        & (F.col("dex_share") >= min_share)
    )


def is_airdrop_hunter(min_contracts: int = 20, min_bridge: int = 3) -> Column:
    return (F.col("callees") >= min_contracts) & (F.col("bridge_calls") >= min_bridge)


def label_dex_heavy(stats: DataFrame, **limits) -> DataFrame:
    """Accounts whose calls mostly go to exchange routers."""
    found = stats.where(is_dex_heavy(**limits)).select(
        "address",
        F.col("calls").alias("total_tx"),
        F.col("dex_calls").alias("dex_tx"),
        F.col("dex_share").alias("dex_ratio"),
    )
    return _labelled(found, "defi_farmer", None, "total_tx", "dex_tx", "dex_ratio")


def label_dex_heavy_transactions(
    transactions: DataFrame,
    dex: Sequence[str],
    *,
    min_tx: int = 50,
    min_share: float = 0.70,
    limit: int | None = None,
    excluded: Sequence[str] = PROTOCOLS,
    as_of: str | None = None,
    days: int | None = None,
) -> DataFrame:
    """The same rule on sent transactions; with ``limit`` only the strongest accounts."""
    routed = F.lower("to_address").isin(_lower(dex))
    stats = (
        _senders(recent(transactions, as_of, days), excluded)
        .groupBy("address")
        .agg(F.count(F.lit(1)).alias("total_tx"), F.count(F.when(routed, 1)).alias("dex_tx"))
        .where(F.col("total_tx") >= min_tx)
        .withColumn("dex_ratio", safe_divide(F.col("dex_tx"), F.col("total_tx")))
        .where(F.col("dex_ratio") >= min_share)
    )
    if limit is not None:
        stats = stats.orderBy(F.desc("dex_ratio"), "address").limit(limit)
    return _labelled(stats, "defi_farmer", WAREHOUSE_SOURCES["defi_farmer"], "total_tx", "dex_tx", "dex_ratio")


def label_mev_bots(stats: DataFrame, **limits) -> DataFrame:
    return _labelled(stats.where(is_mev_bot(**limits)), "mev_bot")


def trace_candidates(
    traces: DataFrame,
    dex: Sequence[str],
    *,
    min_calls: int = 20,
    excluded: Sequence[str] = PROTOCOLS,
    as_of: str | None = None,
    days: int | None = None,
) -> DataFrame:
    """Accounts with many internal router calls."""
    routed = F.lower("to_address").isin(_lower(dex))
    calls = recent(traces, as_of, days).where((F.col("call_type") == "call") & routed)
    return (
        _senders(calls, excluded)
        .groupBy("address")
        .agg(F.count(F.lit(1)).alias("trace_mev_tx"))
        .where(F.col("trace_mev_tx") >= min_calls)
    )


def label_mev_bots_with_traces(
    stats: DataFrame,
    traces: DataFrame,
    dex: Sequence[str],
    *,
    min_calls: int = 20,
    excluded: Sequence[str] = PROTOCOLS,
    as_of: str | None = None,
    days: int | None = None,
    **limits,
) -> DataFrame:
    """Block patterns or many router traces."""
    found = stats.where(is_mev_bot(**limits)).select("address")
    traced = trace_candidates(traces, dex, min_calls=min_calls, excluded=excluded, as_of=as_of, days=days)
    return _labelled(found.union(traced.select("address")).distinct(), "mev_bot", WAREHOUSE_SOURCES["mev_bot"])


def label_whales(stats: DataFrame, source: str | None = None, **limits) -> DataFrame:
    """High value, few transactions per active day."""
    found = stats.where(is_whale(**limits))
    return _labelled(found, "hodler", source, "total_tx", "total_eth", "tx_per_day")


def label_top_whales(stats: DataFrame, *, limit: int | None = None, **limits) -> DataFrame:
    """The same rule; with ``limit`` only the largest accounts by value."""
    top = stats.where(is_whale(**limits))
    if limit is not None:
        top = top.orderBy(F.desc("total_eth"), "address").limit(limit)
    return _labelled(top, "hodler", WAREHOUSE_SOURCES["hodler"], "total_tx", "total_eth", "tx_per_day")


def label_nft_traders(stats: DataFrame, **limits) -> DataFrame:
    return _labelled(stats.where(is_nft_trader(**limits)), "nft_trader")


def label_smart_money(senders: DataFrame, callers: DataFrame, **limits) -> DataFrame:
    both = senders.join(callers, "address")
    return _labelled(both.where(is_smart_money(**limits)), "smart_money")


def label_airdrop_hunters(stats: DataFrame, **limits) -> DataFrame:
    return _labelled(stats.where(is_airdrop_hunter(**limits)), "airdrop_hunter")


# ------------------------------------------------------------ resolution


def priority(label: Column) -> Column:
    position = F.array_position(F.lit(LABEL_PRIORITY), label) - 1
    return F.when(position >= 0, position).otherwise(OTHER_PRIORITY)


def resolve_labels(frames: Sequence[DataFrame], excluded: Sequence[str] = PROTOCOLS) -> DataFrame:
    """Union of label frames with one row per address, strongest label first."""
    combined = frames[0]
    for frame in frames[1:]:
        combined = combined.unionByName(frame, allowMissingColumns=True)
    combined = combined.where(~F.col("address").isin(_lower(excluded)))
    order = F.struct(priority(F.col("label")).alias("p"), F.col("source"))
    return best_row(combined, ["address"], order, largest=False)


def build_labels(
    transactions: DataFrame,
    calls: DataFrame,
    active: DataFrame,
    *,
    book: dict[str, list[str]] | None = None,
    excluded: Sequence[str] = PROTOCOLS,
    limits: dict[str, dict] | None = None,
) -> DataFrame:
    """The label of every active account; ``retail_trader`` where no rule fires.

    The rules read one joined table of account statistics, and the strongest
    rule decides, so no candidate rows have to be united and deduplicated.
    """
    book = book or {c: addresses(c) for c in ("dex", "nft_marketplace", "bridge")}
    limits = limits or {}
    accounts = (
        active.select(F.lower(active.columns[0]).alias("address"))
        .distinct()
        .where(~F.col("address").isin(_lower(excluded)))
    )
    sent = _of_active(transactions, accounts)
    called = _of_active(calls, accounts)
    stats = (
        accounts.join(sender_stats(sent, excluded), "address", "left")
        .join(block_stats(sent, book["dex"], excluded), "address", "left")
        .join(call_stats(called, book, excluded), "address", "left")
    )
    rules = {
        "mev_bot": is_mev_bot,
        "smart_money": is_smart_money,
        "defi_farmer": is_dex_heavy,
        "nft_trader": is_nft_trader,
        "airdrop_hunter": is_airdrop_hunter,
        "hodler": is_whale,
    }
    label = F.lit("retail_trader")
    for name in reversed([n for n in LABEL_PRIORITY if n in rules]):
        label = F.when(rules[name](**limits.get(name, {})), name).otherwise(label)
    chosen = stats.withColumn("label", label)
    source = F.create_map(*[F.lit(x) for pair in SOURCES.items() for x in pair])
    farmer, hodler = F.col("label") == "defi_farmer", F.col("label") == "hodler"
    return chosen.select(
        "address",
        "label",
        source[F.col("label")].alias("source"),
        F.when(farmer, F.col("calls")).when(hodler, F.col("total_tx")).alias("total_tx"),
        F.when(farmer, F.col("dex_calls")).alias("dex_tx"),
        F.when(farmer, F.col("dex_share")).alias("dex_ratio"),
        F.when(hodler, F.col("total_eth")).alias("total_eth"),
        F.when(hodler, F.col("tx_per_day")).alias("tx_per_day"),
        F.col("address").alias(KEY),
    )


def _of_active(df: DataFrame, accounts: DataFrame) -> DataFrame:
    marked = df.withColumn("_sender", F.lower("from_address"))
    return keep_keys(marked, accounts, "_sender").drop("_sender")


# ------------------------------------------------------- label assertions


def assert_labels(assertions: DataFrame) -> DataFrame:
    """Label rows from outside, with confidence and evidence, for the label table."""
    return assertions.select(
        F.lower("address").alias("address"),
        "label",
        F.coalesce("source", F.lit("agent_verified")).alias("source"),
        F.least(F.greatest(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.coalesce("evidence", F.lit("")).alias("evidence"),
        "asserted_at",
        F.lower("address").alias(KEY),
    )


def latest_labels(assertions: DataFrame) -> DataFrame:
    """The newest assertion per address."""
    order = F.struct("asserted_at", "label", "source")
    return best_row(assertions, ["address"], order)


def label_cluster(
    members: DataFrame,
    cluster: int,
    *,
    label: str,
    confidence: float,
    asserted_at: str,
    evidence: str = "",
    source: str = "agent_cluster_label",
) -> DataFrame:
    """One label assertion for every member of a cluster."""
    return assert_labels(
        members.where(F.col("cluster") == cluster).select(
            F.col(KEY).alias("address"),
            F.lit(label).alias("label"),
            F.lit(source).alias("source"),
            F.lit(confidence).alias("confidence"),
            F.lit(evidence).alias("evidence"),
            F.lit(asserted_at).cast("timestamp").alias("asserted_at"),
        )
    )


def encode_labels(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Give each label a number, counted from 0 in alphabetical order.

    The label names are few; each row's number is its place among them.
    """
    names = labelled.select(label).where(F.col(label).isNotNull()).distinct()
    listed = names.agg(F.sort_array(F.collect_list(label)).alias("names"))
    position = F.array_position(listed.scalar(), F.col(label)) - 1
    return labelled.withColumn("label_id", position.cast("int"))
