"""The versioned registry of known contracts and how it is filled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.groups import best_row, flag_keys
from tallyscope.functions.scalars import category_from_name
from tallyscope.schemas import KNOWN_CONTRACTS, REGISTRY_COLUMNS

# Protocol-list categories and the registry category they mean.
# Any other category is lower-cased with underscores for spaces.
LISTED_CATEGORIES = {
    "Dexs": "dex",
    "DEX Aggregator": "dex",
    "Lending": "lending",
    "CDP": "lending",
    "Liquid Staking": "staking",
    "Staking Pool": "staking",
    "Restaking": "staking",
    "Liquid Restaking": "staking",
    "Bridge": "bridge",
    "Canonical Bridge": "bridge",
    "Yield": "yield",
    "Yield Aggregator": "yield",
    "Farm": "yield",
    "Derivatives": "derivatives",
    "Prediction Market": "derivatives",
    "CEX": "exchange",
}

TOKEN_LIST_SCHEMA = "struct<tokens:array<struct<chainId:int,address:string,name:string,symbol:string>>>"
PROTOCOL_SCHEMA = "struct<address:string,name:string,category:string,chains:array<string>>"


def known_contracts(spark: SparkSession) -> DataFrame:
    """The built-in addresses as (address, label, category)."""
    return spark.createDataFrame(KNOWN_CONTRACTS, "address string, label string, category string")


def seed_rows(known: DataFrame, book: dict[str, Sequence[str]], source: str = "hardcoded") -> DataFrame:
    """Registry rows of known addresses; the category is the set they are in.

    Sets are tested in the order dex, lending, nft_marketplace, bridge; an
    address in none of them is an exchange.
    """
    category = F.lit("exchange")
    for name in ("bridge", "nft_marketplace", "lending", "dex"):
        category = F.when(F.col("address").isin(list(book.get(name, []))), name).otherwise(category)
    return known.select(
        F.lower("address").alias("address"), "label", category.alias("category"), F.lit(source).alias("source")
    )


def token_list_rows(documents: DataFrame, chain_id: int = 1) -> DataFrame:
    """Registry rows from token-list snapshots (one JSON document per row)."""
    token = F.col("t")
    return (
        documents.select(F.from_json("value", TOKEN_LIST_SCHEMA).alias("d"))
        .select(F.explode("d.tokens").alias("t"))
        .where((token["chainId"] == chain_id) & token["address"].isNotNull())
        .select(
            F.lower(token["address"]).alias("address"),
            F.concat(token["name"], F.lit(" ("), token["symbol"], F.lit(")")).alias("label"),
            F.lit("token").alias("category"),
            F.lit("coingecko_token_list").alias("source"),
        )
    )


def listed_category(category: Column) -> Column:
    given = F.coalesce(category, F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in LISTED_CATEGORIES.items() for x in pair])
    return F.coalesce(known[given], F.replace(F.lower(given), F.lit(" "), F.lit("_")))


def protocol_list_rows(documents: DataFrame, chain: str = "Ethereum") -> DataFrame:
    """Registry rows from protocol-list snapshots (one protocol per row)."""
    p = documents.select(F.from_json("value", PROTOCOL_SCHEMA).alias("p")).select("p.*")
    return p.where(F.col("address").startswith("0x") & F.array_contains("chains", chain)).select(
        F.lower("address").alias("address"),
        F.col("name").alias("label"),
        listed_category(F.col("category")).alias("category"),
        F.lit("defillama").alias("source"),
    )


def resolved_name_rows(unknown: DataFrame, names: DataFrame) -> DataFrame:
    """Registry rows of contracts whose names were looked up elsewhere.

    ``names`` is (address, name). A contract without a name is kept as
    unverified, so that it is not looked up again.
    """
    found = names.select(F.lower("address").alias("address"), F.nullif(F.trim("name"), F.lit("")).alias("name"))
    keys = unknown.select(F.lower("address").alias("address")).distinct()
    return keys.join(found, "address", "left").select(
        "address",
        F.coalesce("name", F.lit("Unverified Contract")).alias("label"),
        F.when(F.col("name").isNull(), "unknown").otherwise(category_from_name(F.col("name"))).alias("category"),
        F.lit("etherscan").alias("source"),
    )


def merge_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """One row per address; the first source that knows an address wins.

    One aggregate over all sources instead of an anti join per source.
    """
    combined = None
    for rank, rows in enumerate(sources):
        ranked = rows.select(*REGISTRY_COLUMNS, F.lit(rank).alias("_rank"))
        combined = ranked if combined is None else combined.unionByName(ranked)
    order = F.struct("_rank", "label", "category")
    return best_row(combined, ["address"], order, largest=False).select(*REGISTRY_COLUMNS)


def counts_by_source(registry: DataFrame) -> DataFrame:
    """Registry size per source, with the total."""
    counted = registry.groupBy("source").agg(F.count(F.lit(1)).alias("addresses"))
    # From the counts, which share one exchange, not from the registry again.
    total = counted.agg(F.coalesce(F.sum("addresses"), F.lit(0)).alias("addresses"))
    return counted.unionByName(total.select(F.lit("total_registry_size").alias("source"), "addresses"))


def latest(registry: DataFrame) -> DataFrame:
    """The newest version of each address."""
    return best_row(registry, ["address"], F.struct("updated_at", "label", "category"))


def callee_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("to_address").agg(F.count(F.lit(1)).alias("interaction_count"))


def unknown_contracts(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Called contracts that the registry does not know, with their calls.

    Calls are counted first, so the lookup sees one row per contract. (An anti
    join would be pushed below the count and meet every call of a hot contract.)
    """
    counted = flag_keys(callee_counts(calls), registry.select("address"), "to_address", "_known")
    return counted.where(~F.col("_known")).drop("_known")


def top_unknown(calls: DataFrame, registry: DataFrame, n: int) -> DataFrame:
    """The ``n`` most called contracts that the registry does not know."""
    return unknown_contracts(calls, registry).orderBy(F.desc("interaction_count"), "to_address").limit(n)


def coverage(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Share of calls whose contract has a registry label."""
    known = registry.select(F.col("address").alias("to_address"), F.lit(1).alias("_known")).distinct()
    counted = callee_counts(calls).join(known, "to_address", "left")
    labelled = F.coalesce(F.sum(F.when(F.col("_known") == 1, F.col("interaction_count"))), F.lit(0))
    total = F.sum("interaction_count")
    return counted.agg(
        total.alias("interactions"),
        labelled.alias("labelled"),
        F.try_divide(labelled.cast("double"), total.cast("double")).alias("coverage"),
    )


def name_known_contracts(contracts: DataFrame, known: DataFrame) -> DataFrame:
    """Contracts of the contract table that are known, with kind and name."""
    names = known.select(F.lower("address").alias("address"), F.col("label").alias("_name"))
    kind = F.when(F.col("is_erc20"), "erc20_contract").when(F.col("is_erc721"), "nft_contract")
    return (
        contracts.withColumn("address", F.lower("address"))
        .join(names, "address")
        .select(
            "address",
            F.coalesce("_name", F.lit("contract")).alias("label"),
            F.lit("known_protocol").alias("source"),
            kind.otherwise("contract").alias("contract_type"),
        )
    )
