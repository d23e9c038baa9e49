"""From raw extracts to the account-exploded ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.groups import attach, both_sides, flag_keys, keep_keys
from tallyscope.functions.scalars import in_window, method_id, wei_to_eth
from tallyscope.schemas import KEY


def touching(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows with a wanted account on either side, each row once, in one pass."""
    wanted = accounts.select(F.lower(accounts.columns[0]))
    marked = df.withColumn("_from", F.lower("from_address")).withColumn("_to", F.lower("to_address"))
    marked = flag_keys(marked, wanted, "_from", "_sends")
    marked = flag_keys(marked, wanted, "_to", "_receives")
    return marked.where(F.col("_sends") | F.col("_receives")).select(*df.columns)


def project_transactions(
    transactions: DataFrame, accounts: DataFrame, as_of: str, days: int
) -> DataFrame:
    """Transaction extract: window, either side, value in whole units, call id."""
    recent = transactions.where(in_window(F.col("block_timestamp"), as_of, days))
    return touching(recent, accounts).select(
        "hash",
        "block_number",
        "block_timestamp",
        "from_address",
        "to_address",
        wei_to_eth(F.col("value")).alias("value_eth"),
        "gas",
        "gas_price",
        "receipt_status",
        method_id(F.col("input")).alias("method_id"),
    )


def project_token_transfers(
    transfers: DataFrame, contracts: DataFrame, accounts: DataFrame, as_of: str, days: int
) -> DataFrame:
    """Token-transfer extract with the token contract's flags."""
    recent = transfers.where(in_window(F.col("block_timestamp"), as_of, days))
    flags = contracts.select(F.col("address").alias("token_address"), "is_erc20", "is_erc721")
    return (
        touching(recent, accounts)
        .withColumnRenamed("value", "raw_value")
        .transform(attach, flags, "token_address")
        .select(
            "transaction_hash",
            "block_timestamp",
            "from_address",
            "to_address",
            "token_address",
            "raw_value",
            "is_erc20",
            "is_erc721",
        )
    )


def project_contract_calls(
    traces: DataFrame, contracts: DataFrame, accounts: DataFrame, as_of: str, days: int
) -> DataFrame:
    """Contract-call extract: call traces with the callee's flags."""
    calls = traces.where(
        in_window(F.col("block_timestamp"), as_of, days) & (F.col("trace_type") == "call")
    )
    flags = contracts.select(F.col("address").alias("to_address"), "is_erc20", "is_erc721")
    return (
        touching(calls, accounts)
        .transform(attach, flags, "to_address")
        .select(
            "transaction_hash",
            "block_timestamp",
            "from_address",
            "to_address",
            "trace_type",
            wei_to_eth(F.col("value")).alias("value_eth"),
            "gas_used",
            "status",
            method_id(F.col("input")).alias("method_id"),
            "is_erc20",
            "is_erc721",
        )
    )


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    for old, new in names.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def _lowered(accounts: DataFrame) -> DataFrame:
    """Addresses are compared in lower case, however the list writes them."""
    return accounts.select(F.lower(F.col(accounts.columns[0])).alias(KEY))


def explode_transactions(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row per transaction and side; a transfer to oneself counts twice."""
    named = _renamed(transactions, {"value_eth": "value", "method_id": "input"})
    return keep_keys(both_sides(named), _lowered(accounts), KEY)


def explode_token_transfers(transfers: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row per distinct transfer and participating account."""
    named = _renamed(transfers, {"raw_value": "value"})
    return keep_keys(both_sides(named, once=True), _lowered(accounts), KEY).dropDuplicates()


def explode_contract_calls(calls: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row per distinct call and participating account."""
    return keep_keys(both_sides(calls, once=True), _lowered(accounts), KEY).dropDuplicates()
