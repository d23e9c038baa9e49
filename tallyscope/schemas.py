"""Table layouts, label taxonomy and known addresses."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- layouts

RAW_TRANSACTIONS = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("block_timestamp", T.TimestampType()),
        T.StructField("from_address", T.StringType()),
        T.StructField("to_address", T.StringType()),
        T.StructField("value_eth", T.DoubleType()),
        T.StructField("gas", T.LongType()),
        T.StructField("gas_price", T.LongType()),
        T.StructField("receipt_status", T.IntegerType()),
        T.StructField("method_id", T.StringType()),
    ]
)

RAW_TOKEN_TRANSFERS = T.StructType(
    [
        T.StructField("transaction_hash", T.StringType()),
        T.StructField("block_timestamp", T.TimestampType()),
        T.StructField("from_address", T.StringType()),
        T.StructField("to_address", T.StringType()),
        T.StructField("token_address", T.StringType()),
        T.StructField("raw_value", T.StringType()),
        T.StructField("is_erc20", T.IntegerType()),
        T.StructField("is_erc721", T.IntegerType()),
    ]
)

RAW_CONTRACT_INTERACTIONS = T.StructType(
    [
        T.StructField("transaction_hash", T.StringType()),
        T.StructField("block_timestamp", T.TimestampType()),
        T.StructField("from_address", T.StringType()),
        T.StructField("to_address", T.StringType()),
        T.StructField("trace_type", T.StringType()),
        T.StructField("value_eth", T.DoubleType()),
        T.StructField("gas_used", T.DoubleType()),
        T.StructField("status", T.DoubleType()),
        T.StructField("method_id", T.StringType()),
        T.StructField("is_erc20", T.IntegerType()),
        T.StructField("is_erc721", T.IntegerType()),
    ]
)

RAW_LAYOUTS = {
    "raw_transactions": RAW_TRANSACTIONS,
    "raw_token_transfers": RAW_TOKEN_TRANSFERS,
    "raw_contract_interactions": RAW_CONTRACT_INTERACTIONS,
}

KEY = "wallet_address"

# Fixed names: the twelve behavioural feature columns, in canonical order.
FEATURES = [
    "tx_frequency_per_day",
    "activity_regularity",
    "hour_of_day_entropy",
    "weekend_vs_weekday_ratio",
    "avg_holding_duration_estimate",
    "gas_price_sensitivity",
    "is_contract",
    "dex_to_total_ratio",
    "lending_to_total_ratio",
    "counterparty_concentration",
    "value_velocity",
    "burst_score",
]

LABEL_TEXT_COLUMNS = ["address", "label", "source", "wallet_address"]
LABEL_COLUMNS = [
    "address",
    "label",
    "source",
    "total_tx",
    "dex_tx",
    "dex_ratio",
    "total_eth",
    "tx_per_day",
    "wallet_address",
]

REGISTRY_COLUMNS = ["address", "label", "category", "source"]

# ---------------------------------------------------------------- labels

# Archetype labels, strongest first. An address that several
# rules claim takes the label that stands first.
LABEL_PRIORITY = [
    "mev_bot",
    "smart_money",
    "defi_farmer",
    "nft_trader",
    "airdrop_hunter",
    "hodler",
    "retail_trader",
]
OTHER_PRIORITY = 99

# ---------------------------------------------------------------- addresses

# Known mainnet addresses, their names and their category.
KNOWN_CONTRACTS = [
    ("0x7a250d5630b4cf539739df2c5dacb4c659f2488d", "Uniswap V2: Router", "dex"),
    ("0xe592427a0aece92de3edee1f18e0157c05861564", "Uniswap V3: Router", "dex"),
    ("0x3fc91a3afd70395cd496c647d5a6cc9d4b2b7fad", "Uniswap: Universal Router", "dex"),
    ("0xd9e1ce17f2641f24ae83637ab66a2cca9c378b9f", "SushiSwap: Router", "dex"),
    ("0x1111111254eeb25477b68fb85ed929f73a960582", "1inch v5: Aggregation Router", "dex"),
    ("0x7d2768de32b0b80b7a3454c06bdac94a69ddc7a9", "Aave V2: Lending Pool", "lending"),
    ("0x87870bca3f3fd6335c3f4ce8392d69350b4fa4e2", "Aave V3: Pool", "lending"),
    ("0x3d9819210a31b4961b30ef54be2aed79b9c9cd3b", "Compound: Comptroller", "lending"),
    ("0xc3d688b66703497daa19211eedff47f25384cdc3", "Compound V3: cUSDCv3", "lending"),
    ("0x00000000000000adc04c56bf30ac9d3c0aaf14dc", "OpenSea: Seaport", "nft_marketplace"),
    ("0x29469395eaf6f95920e59f858042f0e28d98a20b", "Blur: Marketplace", "nft_marketplace"),
    ("0x0000000000a39bb272e79075ade125fd351887ac", "Blur: Pool", "nft_marketplace"),
    ("0x4dbd4fc535ac27206064b68ffcf827b0a60bab3f", "Arbitrum: Delayed Inbox", "bridge"),
    ("0x72ce9c846789fdb6fc1f34ac4ad25dd9ef7031ef", "Arbitrum: Gateway Router", "bridge"),
    ("0x99c9fc46f92e8a1c0dec1b1747d010903e884be1", "Optimism: L1 Standard Bridge", "bridge"),
    ("0x28c6c06298d514db089934071355e5743bf21d60", "Binance: Hot Wallet", "exchange"),
    ("0xf6874c88757721a02f47592140905c4336dfbc61", "Coinbase Commerce", "exchange"),
]

# Addresses that only the staging models count, by category, and
# addresses that only the label rules count.
STAGING_ONLY = {
    "dex": [
        "0x68b3465833fb72a70ecdf485e0e4c7bd8665fc45",
        "0x1111111254fb6c44bac0bed2854e76f90643097d",
    ],
    "lending": [],
    "bridge": ["0x25ace71c97b33cc4729cf772ae268934f7ab5fa1"],
    "nft_marketplace": [
        "0x00000000006c3852cbef3e08e8df289169ede581",
        "0x00000000000001ad428e4906ae43d8f9852d0dd6",
        "0x000000000000ad05ccc4f10045630fb830b95127",
    ],
}
RULES_ONLY = {"nft_marketplace": ["0x0000000000a39bb272e79075ade125fd351887ac"]}


def addresses(category: str, variant: str = "rules") -> list[str]:
    """Known addresses of a category; ``variant`` is ``rules`` or ``staging``."""
    known = [a for a, _, c in KNOWN_CONTRACTS if c == category]
    if variant == "rules":
        return known
    dropped = RULES_ONLY.get(category, [])
    return [a for a in known if a not in dropped] + STAGING_ONLY.get(category, [])


PROTOCOLS = [a for a, _, _ in KNOWN_CONTRACTS]
