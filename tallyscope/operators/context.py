"""Account context: what an account does, with whom, and when.

All functions work for many accounts at once. With ``accounts`` (one column of
addresses) the rows of other accounts are dropped before anything is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.groups import both_sides, keep_keys, top_k
from tallyscope.functions.scalars import count_where
from tallyscope.schemas import FEATURES, KEY
from tallyscope.session import settle

HOURS = range(24)


def _only(df: DataFrame, accounts: DataFrame | None) -> DataFrame:
    return df if accounts is None else keep_keys(df, accounts, KEY)


def transaction_summary(transactions: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Count, volume, mean and first and last time; a self transfer counts once."""
    return (
        _only(both_sides(transactions, once=True), accounts)
        .groupBy(KEY)
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            F.coalesce(F.sum("value_eth"), F.lit(0.0)).alias("total_eth_volume"),
            F.coalesce(F.avg("value_eth"), F.lit(0.0)).alias("avg_tx_value_eth"),
            F.min("block_timestamp").alias("first_seen"),
            F.max("block_timestamp").alias("last_seen"),
        )
    )


def top_contracts(
    calls: DataFrame, registry: DataFrame, limit: int = 10, accounts: DataFrame | None = None
) -> DataFrame:
    """Most called contracts per sender with registry label and category.

    Calls are counted and cut to the top before the registry is joined.
    """
    sent = _only(calls.withColumn(KEY, F.lower("from_address")), accounts)
    counted = sent.groupBy(KEY, "to_address").agg(
        F.count(F.lit(1)).alias("interaction_count"), F.sum("value_eth").alias("total_eth")
    )
    best = top_k(counted, [KEY], [F.desc("interaction_count"), F.asc("to_address")], limit)
    names = registry.select(
        F.col("address").alias("to_address"),
        F.nullif(F.col("label"), F.lit("")).alias("protocol_label"),
        F.nullif(F.col("category"), F.lit("")).alias("_category"),
    )
    return best.join(names, "to_address", "left").select(
        KEY,
        "rank",
        F.col("to_address").alias("address"),
        "protocol_label",
        F.coalesce("_category", F.lit("unknown")).alias("category"),
        "interaction_count",
        "total_eth",
    )


def token_counts(transfers: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Transfers per account and token, by kind."""
    return (
        _only(both_sides(transfers, once=True), accounts)
        .groupBy(KEY, "token_address")
        .agg(
            F.count(F.lit(1)).alias("transfer_count"),
            count_where(F.col("is_erc20").cast("int") == 1).alias("erc20_count"),
            count_where(F.col("is_erc721").cast("int") == 1).alias("erc721_count"),
        )
    )


def token_activity(
    transfers: DataFrame, limit: int = 10, accounts: DataFrame | None = None
) -> DataFrame:
    """Distinct tokens per account, and its most transferred tokens by rank."""
    # Counted by aggregate and cut by group limit, so no task needs all tokens of an account.
    counted = token_counts(transfers, accounts)
    tokens = counted.groupBy(KEY).agg(F.count("token_address").alias("unique_tokens"))
    best = top_k(counted, [KEY], [F.desc("transfer_count"), F.asc("token_address")], limit)
    return best.join(tokens, KEY).select(
        KEY, "unique_tokens", "rank", "token_address", "transfer_count", "erc20_count", "erc721_count"
    )


def timing_patterns(transactions: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """24 hour shares, three busiest hours and weekday share of sent rows."""
    ts = F.col("block_timestamp")
    sent = _only(transactions.withColumn(KEY, F.lower("from_address")), accounts)
    counted = sent.groupBy(KEY, F.hour(ts).alias("_h"), F.weekday(ts).alias("_d")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    total = F.sum("_n")
    per_hour = [F.coalesce(F.sum(F.when(F.col("_h") == h, F.col("_n"))), F.lit(0)) for h in HOURS]
    sums = counted.groupBy(KEY).agg(
        F.array(*per_hour).alias("_hours"),
        (F.sum(F.when(F.col("_d") < 5, F.col("_n")).otherwise(0)) / total).alias("_weekday"),
        total.alias("_total"),
    )
    # Largest count first, and the lower hour first among equals.
    ranked = F.sort_array(
        F.transform("_hours", lambda n, h: F.struct((-n).alias("n"), h.alias("h")))
    )
    return sums.select(
        KEY,
        F.transform("_hours", lambda n: F.round(n / F.col("_total"), 6)).alias("hourly_distribution"),
        F.transform(F.slice(ranked, 1, 3), lambda x: x["h"]).alias("most_active_hours"),
        F.round("_weekday", 4).alias("weekday_ratio"),
    )


def account_context(
    accounts: DataFrame,
    transactions: DataFrame,
    calls: DataFrame,
    transfers: DataFrame,
    registry: DataFrame,
    limit: int = 10,
) -> DataFrame:
    """All four sections as structs per account; an absent section is NULL.

    Lists hold at most ``limit`` entries, so collecting them is bounded.
    """
    wanted = settle(accounts.select(F.lower(accounts.columns[0]).alias(KEY)).distinct())
    summary = transaction_summary(transactions, wanted)
    summary = summary.select(
        KEY, F.struct(*[c for c in summary.columns if c != KEY]).alias("transaction_summary")
    )
    contracts = top_contracts(calls, registry, limit, wanted)
    contracts = contracts.groupBy(KEY).agg(_ranked(contracts, [KEY, "rank"]).alias("top_contracts"))
    tokens = token_activity(transfers, limit, wanted)
    tokens = (
        tokens.groupBy(KEY, "unique_tokens")
        .agg(_ranked(tokens, [KEY, "rank", "unique_tokens"]).alias("top_tokens"))
        .select(KEY, F.struct("unique_tokens", "top_tokens").alias("token_activity"))
    )
    timing = timing_patterns(transactions, wanted)
    timing = timing.select(
        KEY, F.struct("most_active_hours", "weekday_ratio", "hourly_distribution").alias("timing_patterns")
    )
    result = wanted
    for part in (summary, contracts, tokens, timing):
        result = result.join(part, KEY, "left")
    return result


def _ranked(df: DataFrame, without: list[str]) -> Column:
    fields = [c for c in df.columns if c not in without]
    listed = F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("item"))))
    return F.transform(listed, lambda x: x["item"])


def flat_context(context: DataFrame) -> DataFrame:
    """Context of sampled accounts as flat rows with rounded numbers."""
    contracts = F.transform(
        F.slice(F.coalesce("top_contracts", F.array()), 1, 5),
        lambda c: F.struct(
            c["address"].alias("address"),
            F.coalesce(c["protocol_label"], F.lit("Unknown")).alias("label"),
            c["category"].alias("category"),
            c["interaction_count"].alias("interactions"),
            F.round(c["total_eth"], 2).alias("eth"),
        ),
    )
    summary, timing = F.col("transaction_summary"), F.col("timing_patterns")
    extra = [c for c in ("cluster",) if c in context.columns]
    return context.select(
        KEY,
        *extra,
        F.coalesce(summary["total_transactions"], F.lit(0)).alias("tx_count"),
        F.round(F.coalesce(summary["total_eth_volume"], F.lit(0.0)), 2).alias("total_eth"),
        F.round(F.coalesce(summary["avg_tx_value_eth"], F.lit(0.0)), 4).alias("avg_tx_eth"),
        summary["first_seen"].alias("first_seen"),
        summary["last_seen"].alias("last_seen"),
        contracts.alias("top_contracts"),
        F.coalesce(F.col("token_activity.unique_tokens"), F.lit(0)).alias("unique_tokens"),
        F.coalesce(timing["weekday_ratio"], F.lit(0.0)).alias("weekday_ratio"),
        F.coalesce(timing["most_active_hours"], F.array().cast("array<int>")).alias("active_hours"),
    )


def profile_exemplars(exemplars: DataFrame, context: DataFrame) -> DataFrame:
    """One descriptive row per exemplar: named protocols and unnamed share."""
    contracts = F.coalesce(F.col("top_contracts"), F.array())
    named = F.filter(contracts, lambda c: c["protocol_label"].isNotNull())
    text = F.array_join(
        F.transform(
            F.slice(named, 1, 5),
            lambda c: F.concat(c["protocol_label"], F.lit(" ["), c["category"], F.lit("]")),
        ),
        ", ",
    )
    unnamed = (F.size(contracts) - F.size(named)) / F.greatest(F.size(contracts), F.lit(1))
    summary, timing = F.col("transaction_summary"), F.col("timing_patterns")
    hours = F.array_join(F.transform(timing["most_active_hours"], lambda h: h.cast("string")), ", ")
    return exemplars.join(context, KEY, "left").select(
        *exemplars.columns,
        F.coalesce(summary["total_transactions"], F.lit(0)).alias("tx_count"),
        F.coalesce(summary["avg_tx_value_eth"], F.lit(0.0)).alias("avg_tx_eth"),
        summary["first_seen"].alias("first_seen"),
        summary["last_seen"].alias("last_seen"),
        F.coalesce(F.col("token_activity.unique_tokens"), F.lit(0)).alias("unique_tokens"),
        F.coalesce(timing["weekday_ratio"], F.lit(0.0)).alias("weekday_ratio"),
        F.concat(F.lit("["), F.coalesce(hours, F.lit("")), F.lit("]")).alias("active_hours"),
        F.when(text == "", "None identified").otherwise(text).alias("top_protocols"),
        F.round(unnamed, 2).alias("unknown_contract_pct"),
    )


ACCOUNT_TEXT = (
    "Account {account} is labelled {label} with confidence {confidence}.\n"
    "Its behaviour:\n{features}\n"
    "Describe its strategy and its part in the market in two or three sentences."
)
CLUSTER_TEXT = (
    "Cluster {cluster} has {size} members.\nIts statistics:\n{statistics}\n"
    "Its most typical members:\n{members}\n"
    "Name the cluster, describe what its members share, and say what that means for others."
)
COMPARISON_TEXT = (
    "First account {first}:\n{first_features}\nSecond account {second}:\n{second_features}\n"
    "Compare both: what they share, how they differ, and whether one owner is likely."
)


def _fill(template: str, fields: dict[str, Column]) -> Column:
    text = F.lit(template)
    for mark, value in fields.items():
        text = F.replace(text, F.lit("{" + mark + "}"), value.cast("string"))
    return text


def feature_lines(values: dict[str, Column]) -> Column:
    """``  name: value`` lines in the given order."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"  {k}: "), v.cast("string")) for k, v in values.items()])


def describe_accounts(
    scored: DataFrame, features: list[str] = FEATURES, template: str = ACCOUNT_TEXT
) -> DataFrame:
    """Fill a text template from features, label and confidence."""
    text = _fill(
        template,
        {
            "account": F.col(KEY),
            "label": F.col("label"),
            "confidence": F.format_string("%.1f%%", F.col("confidence") * 100),
            "features": feature_lines({f: F.col(f) for f in features}),
        },
    )
    return scored.select(KEY, text.alias("prompt"))


def describe_clusters(
    profile: DataFrame, exemplars: DataFrame, key: str = KEY, template: str = CLUSTER_TEXT
) -> DataFrame:
    """Fill a text template per cluster from its profile and exemplars.

    A cluster has one profile row per feature and a few exemplars, so the
    collected lists are short.
    """
    lines = F.transform(
        F.sort_array(F.collect_list(F.struct("feature", F.round("mean", 4).alias("mean")))),
        lambda x: F.concat(F.lit("  "), x["feature"], F.lit(": "), F.format_string("%.4f", x["mean"])),
    )
    stats = profile.groupBy("cluster", "size").agg(F.array_join(lines, "\n").alias("_stats"))
    named = F.transform(
        F.sort_array(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("k")))),
        lambda x: F.concat(F.lit("  "), x["k"]),
    )
    members = exemplars.groupBy("cluster").agg(F.array_join(named, "\n").alias("_members"))
    text = _fill(
        template,
        {
            "cluster": F.col("cluster"),
            "size": F.col("size"),
            "statistics": F.col("_stats"),
            "members": F.coalesce("_members", F.lit("  none")),
        },
    )
    return stats.join(members, "cluster", "left").select("cluster", text.alias("prompt"))


def compare_accounts(
    pairs: DataFrame, features: DataFrame, names: list[str] = FEATURES, template: str = COMPARISON_TEXT
) -> DataFrame:
    """Fill a text template for each given pair of accounts (first, second)."""
    lines = feature_lines({n: F.col(n) for n in names})
    first = features.select(F.col(KEY).alias("first"), lines.alias("_a"))
    second = features.select(F.col(KEY).alias("second"), lines.alias("_b"))
    joined = pairs.join(first, "first").join(second, "second")
    fields = {
        "first": F.col("first"),
        "first_features": F.col("_a"),
        "second": F.col("second"),
        "second_features": F.col("_b"),
    }
    return joined.select("first", "second", _fill(template, fields).alias("prompt"))
