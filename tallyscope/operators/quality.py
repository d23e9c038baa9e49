"""Column tests of tables: no missing values, unique keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that must not be NULL, per table.
NOT_NULL = {
    "transactions": ["hash", "block_timestamp", "from_address", "value"],
    "token_transfers": ["transaction_hash", "token_address"],
    "traces": ["transaction_hash"],
    "contracts": ["address"],
    "stg_wallet_transactions": [
        "wallet_address",
        "tx_count",
        "tx_count_sent",
        "tx_count_received",
        "total_value_sent_eth",
        "total_value_received_eth",
        "active_days",
        "unique_counterparties",
    ],
    "stg_wallet_token_activity": [
        "wallet_address",
        "unique_tokens_interacted",
        "erc20_transfer_count",
        "erc721_transfer_count",
        "token_diversity_entropy",
    ],
    "stg_wallet_contract_interactions": [
        "wallet_address",
        "unique_contracts_called",
        "contract_call_count",
        "dex_interaction_count",
        "lending_interaction_count",
        "bridge_interaction_count",
        "nft_marketplace_interaction_count",
    ],
}

# The key of each table that must be unique.
UNIQUE = {
    "transactions": "hash",
    "contracts": "address",
    "stg_wallet_transactions": "wallet_address",
    "stg_wallet_token_activity": "wallet_address",
    "stg_wallet_contract_interactions": "wallet_address",
}


def missing_values(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Missing values per column, in one pass over the table."""
    counted = df.agg(*[F.count_if(F.isnull(c)).alias(c) for c in columns])
    long = counted.unpivot([], list(columns), "column", "failures")
    return long.select(F.lit(table).alias("table"), "column", "failures")


def repeated_keys(df: DataFrame, table: str, column: str) -> DataFrame:
    """How many key values occur more than once."""
    repeated = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.count_if(F.col("_n") > 1).alias("failures"))
    )
    return repeated.select(F.lit(table).alias("table"), F.lit(column).alias("column"), "failures")


def not_null_report(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([missing_values(df, t, NOT_NULL[t]) for t, df in tables.items() if t in NOT_NULL])


def unique_report(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([repeated_keys(df, t, UNIQUE[t]) for t, df in tables.items() if t in UNIQUE])


def _union(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
