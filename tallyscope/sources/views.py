"""Ledger views over the supplied tables.

``events`` is the base: user ``u`` is account ``w<u>``, the number ``k`` in its
properties is the counterparty. Each view is a lazy projection of the whole
table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.operators.ledger import (
    explode_contract_calls,
    explode_token_transfers,
    explode_transactions,
)
from tallyscope.session import settle, use_utc

# Protocol category by k; above 59 the registry does not know the contract.
RANGES = {
    "dex": (0, 20),
    "lending": (20, 30),
    "nft_marketplace": (30, 40),
    "bridge": (40, 50),
    "exchange": (50, 60),
}
AS_OF = "2024-01-31 00:00:00"
DAYS = 30


def book(prefix: str) -> dict[str, list[str]]:
    """The address book of the views: 20 routers, 10 lending contracts, ..."""
    return {c: [f"{prefix}{k}" for k in range(*r)] for c, r in RANGES.items()}


def category_of(k: Column) -> Column:
    result = F.lit(None).cast("string")
    for name, (low, high) in RANGES.items():
        result = F.when((k >= low) & (k < high), name).otherwise(result)
    return result


class Views:
    """Views over one folder of supplied tables."""

    def __init__(self, spark: SparkSession, folder: str):
        use_utc(spark)
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "user_id",
            "event_type",
            "value",
            # The properties are flat, so a pattern finds the number faster than a parser.
            F.regexp_extract("props", r'"k":\s*(\d+)', 1).try_cast("int").alias("k"),
        )

    def _ids(self) -> tuple[Column, Column, Column]:
        text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        return text("e", "event_id"), text("w", "user_id"), F.col("event_type") != "error"

    # ------------------------------------------------ extracted layouts

    @cached_property
    def tx(self) -> DataFrame:
        event, user, good = self._ids()
        plain = F.col("event_type").isin("view", "click")
        return self.events.select(
            event.alias("hash"),
            F.floor(F.unix_seconds("ts") / 21600).alias("block_number"),
            F.col("ts").alias("block_timestamp"),
            user.alias("from_address"),
            F.concat(F.lit("w"), F.col("k").cast("string")).alias("to_address"),
            F.col("value").alias("value_eth"),
            F.lit(21000.0).alias("gas"),
            (20 + F.col("event_id") % 81).cast("double").alias("gas_price"),
            good.cast("int").alias("receipt_status"),
            F.when(plain, "0x").otherwise("0xabcdef12").alias("method_id"),
            F.lit(21000.0).alias("receipt_gas_used"),
        )

    @cached_property
    def ci(self) -> DataFrame:
        event, user, good = self._ids()
        return self.events.select(
            event.alias("transaction_hash"),
            F.col("ts").alias("block_timestamp"),
            user.alias("from_address"),
            F.concat(F.lit("c"), F.col("k").cast("string")).alias("to_address"),
            F.lit("call").alias("trace_type"),
            F.when(F.col("event_type") == "signup", "delegatecall").otherwise("call").alias("call_type"),
            F.col("value").alias("value_eth"),
            good.cast("int").alias("status"),
        )

    @cached_property
    def tt(self) -> DataFrame:
        event, user, _ = self._ids()
        other = F.concat(F.lit("x"), F.col("k").cast("string"))
        inflow = F.col("event_type").isin("signup", "view")
        return self.events.select(
            event.alias("transaction_hash"),
            F.col("ts").alias("block_timestamp"),
            F.when(inflow, other).otherwise(user).alias("from_address"),
            F.when(inflow, user).otherwise(other).alias("to_address"),
            F.concat(F.lit("t"), (F.col("k") % 10).cast("string")).alias("token_address"),
            F.col("value").alias("raw_value"),
            (F.col("k") % 10 < 7).alias("is_erc20"),
            (F.col("k") % 10 >= 7).alias("is_erc721"),
        )

    # --------------------------------------------------- source layouts

    @cached_property
    def source_transactions(self) -> DataFrame:
        wei = F.round(F.col("value_eth") * 100).cast("decimal(20,0)").cast("decimal(38,0)")
        return self.tx.select(
            "hash",
            "block_number",
            "block_timestamp",
            "from_address",
            "to_address",
            (wei * F.lit(10**16).cast("decimal(17,0)")).cast("decimal(38,0)").alias("value"),
            "gas",
            "gas_price",
            "receipt_gas_used",
            "receipt_status",
            F.concat("method_id", F.lit("00ff")).alias("input"),
        )

    @cached_property
    def source_transfers(self) -> DataFrame:
        """Token amounts as text, some of them no number."""
        odd = F.substring("transaction_hash", -1, 1) == "5"
        whole = (F.floor("raw_value") % 4).cast("string")
        return self.tt.select(
            "transaction_hash",
            "block_timestamp",
            "from_address",
            "to_address",
            "token_address",
            F.when(odd, "n/a").otherwise(whole).alias("value"),
        )

    @cached_property
    def source_traces(self) -> DataFrame:
        wei = F.round(F.col("value_eth") * 100).cast("decimal(20,0)").cast("decimal(38,0)")
        return self.ci.select(
            "transaction_hash",
            "block_timestamp",
            "from_address",
            "to_address",
            F.when(F.substring("transaction_hash", -1, 1) == "7", "create")
            .otherwise(F.col("trace_type"))
            .alias("trace_type"),
            "call_type",
            (wei * F.lit(10**16).cast("decimal(17,0)")).cast("decimal(38,0)").alias("value"),
            F.lit(50000.0).alias("gas_used"),
            "status",
            F.lit("0xa9059cbb0000").alias("input"),
        )

    # -------------------------------------------------------- dimensions

    @cached_property
    def _numbers(self) -> DataFrame:
        return self.events.select("k").where(F.col("k").isNotNull()).distinct()

    @cached_property
    def contracts(self) -> DataFrame:
        """Contracts ``c<k>``, tokens ``t<k>`` and some accounts that hold code."""
        k = F.col("k")
        kinds = F.array(
            F.struct(F.lit("c").alias("p"), F.lit(True).alias("keep")),
            F.struct(F.lit("t").alias("p"), (k < 8).alias("keep")),
            F.struct(F.lit("w").alias("p"), (k % 10 == 0).alias("keep")),
        )
        return (
            self._numbers.select("k", F.explode(kinds).alias("e"))
            .where("e.keep")
            .select(
                F.concat(F.col("e.p"), k.cast("string")).alias("address"),
                (k % 3 == 0).alias("is_erc20"),
                (k % 3 == 1).alias("is_erc721"),
            )
        )

    @cached_property
    def registry(self) -> DataFrame:
        """Known contracts ``c0``..``c59``; even ones were relabelled later."""
        versions = F.when(F.col("k") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        day = F.when(F.col("v") == 1, F.lit("2024-01-01")).otherwise(F.lit("2024-01-15"))
        return (
            self._numbers.where(F.col("k") < 60)
            .select("k", F.explode(versions).alias("v"))
            .select(
                F.concat(F.lit("c"), F.col("k").cast("string")).alias("address"),
                F.concat(F.lit("Protocol "), F.col("k").cast("string"), F.lit(" v"), F.col("v").cast("string")).alias(
                    "label"
                ),
                category_of(F.col("k")).alias("category"),
                F.lit("supplied").alias("source"),
                day.cast("timestamp").alias("updated_at"),
            )
        )

    @cached_property
    def token_documents(self) -> DataFrame:
        """Token-list documents, one per part: two entries on two chains."""
        name, symbol = F.col("p_name"), F.col("p_brand")
        address = F.concat(F.lit("0xAB"), F.col("p_partkey").cast("string"))

        def entry(chain):
            return F.struct(
                chain.alias("chainId"), address.alias("address"), name.alias("name"), symbol.alias("symbol")
            )

        tokens = F.array(entry((F.col("p_partkey") % 2).cast("int")), entry(F.lit(137)))
        return self.table("part").select(F.to_json(F.struct(tokens.alias("tokens"))).alias("value"))

    @cached_property
    def protocol_documents(self) -> DataFrame:
        """Protocol-list documents, one per supplier."""
        key = F.col("s_suppkey")
        kinds = ["Dexs", "Lending", "CDP", "Bridge", "Yield", "Liquid Staking", "CEX", "Real World Assets"]
        chains = F.when(key % 3 == 0, F.array(F.lit("Polygon"))).otherwise(
            F.array(F.lit("Ethereum"), F.lit("Polygon"))
        )
        prefix = F.when(key % 5 == 0, "sol:").otherwise("0xCD")
        document = F.struct(
            F.concat(prefix, key.cast("string")).alias("address"),
            F.col("s_name").alias("name"),
            F.element_at(F.lit(kinds), (key % 8 + 1).cast("int")).alias("category"),
            chains.alias("chains"),
        )
        return self.table("supplier").select(F.to_json(document).alias("value"))

    @cached_property
    def contract_names(self) -> DataFrame:
        """Looked-up names of some of the unknown contracts ``c60``.. ."""
        words = ["SwapRouter", "LendingPoolCore", "ComptrollerLend", "Nft721Drop", "L2Inbox", "StakeHub", "YieldVault"]
        words += ["MyToken", "ProxyAdmin", "Greeter"]
        k = F.col("k")
        return self._numbers.where((k >= 60) & (k % 4 != 3)).select(
            F.concat(F.lit("c"), k.cast("string")).alias("address"),
            F.when(k % 8 == 2, F.lit(" ")).otherwise(F.element_at(F.lit(words), (k % 10 + 1).cast("int"))).alias("name"),
        )

    # ------------------------------------------------------------ ledger

    @cached_property
    def active(self) -> DataFrame:
        """All users as active accounts; stored, as the sample of accounts is."""
        user = F.concat(F.lit("w"), F.col("user_id").cast("string"))
        return settle(self.events.select(user.alias("wallet_address")).distinct())

    @cached_property
    def led(self) -> DataFrame:
        return explode_transactions(self.tx.drop("receipt_gas_used"), self.active)

    @cached_property
    def led_tt(self) -> DataFrame:
        return explode_token_transfers(self.tt, self.active)

    @cached_property
    def led_ci(self) -> DataFrame:
        return explode_contract_calls(self.ci, self.active)

    # ----------------------------------------------------------- vectors

    @cached_property
    def points(self) -> DataFrame:
        """Supplied vectors; label 9 stands for noise."""
        return self.table("embeddings").select(
            "vec_id",
            F.col("embedding").cast("array<double>").alias("vector"),
            F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("int").alias("cluster"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Labels with the probabilities of two made-up models over five classes.

        A class's weight is the largest of every tenth vector component, the classes of both models in turn.
        """
        label = (F.col("label") % 5).cast("int")
        v = F.transform("embedding", lambda x: F.abs(x.cast("double")))

        def model(offset: int) -> Column:
            raw = F.transform(
                F.sequence(F.lit(0), F.lit(4)),
                lambda c: F.array_max(F.filter(v, lambda _, i: i % 10 == c + offset)) + F.when(c == label, 0.08).otherwise(0.0),
            )
            return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda s, y: s + y))

        return self.table("embeddings").select(
            "vec_id", label.alias("label"), model(0).alias("first"), model(5).alias("second")
        )
