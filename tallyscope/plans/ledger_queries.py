"""Scans, projections, sampling, staging tables and data tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.functions.scalars import in_window, valid_address
from tallyscope.operators import ledger, quality, registry, staging
from tallyscope.operators.features import feature_stats
from tallyscope.plans.catalogue import query, r, scratch
from tallyscope.schemas import FEATURES, KEY
from tallyscope.sources import scans, sinks
from tallyscope.sources.views import AS_OF, DAYS, Views, book

WINDOW = {"as_of": AS_OF, "days": DAYS}
RECENT = f"block_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY"
# A shorter window, so that the filter drops rows.
SHORT = {"as_of": AS_OF, "days": 10}
SHORT_SQL = f"block_timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY"
SIDES = "(from_address IN (SELECT wallet_address FROM wanted) OR to_address IN (SELECT wallet_address FROM wanted))"


def wanted(v: Views):
    """Wanted accounts: suppliers in credit, in upper case to exercise folding."""
    rich = v.table("supplier").where(F.col("s_acctbal") > 5000)
    return rich.select(F.concat(F.lit("W"), F.col("s_suppkey").cast("string")).alias(KEY))


# ------------------------------------------------------------------ scans


@query("s1_pruned_scan", "SELECT event_id, user_id, " + r("value", "value") + " FROM events WHERE value > 100")
def _(v: Views):
    return scans.scan(v.spark, v.path("events"), ["event_id", "user_id", "value"]).where(F.col("value") > 100)


@query(
    "s2_scan_either_side",
    f"SELECT hash, from_address, to_address, {r('value_eth', 'value_eth')} FROM tx WHERE {SIDES}",
    "tx wanted",
)
def _(v: Views):
    rows = ledger.touching(v.tx, wanted(v))
    return rows.select("hash", "from_address", "to_address", "value_eth")


@query(
    "s3_scan_by_key",
    f"""SELECT event_id, event_type, {r('value', 'value')} FROM events
    WHERE event_type IN (SELECT event_type FROM events WHERE value > 350)""",
)
def _(v: Views):
    values = v.events.where(F.col("value") > 350).select("event_type")
    return scans.scan_keyed(v.spark, v.path("events"), ["event_id", "event_type", "value"], "event_type", values)


@query(
    "s4_numbers_as_double",
    """SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS DOUBLE) AS p_size,
    round(p_retailprice, 6) AS p_retailprice FROM part""",
)
def _(v: Views):
    return scans.numbers_as_double(v.table("part"))


# --------------------------------------------------------------- writers


@query(
    "s5_partitioned_extract",
    f"SELECT o_orderkey, {r('o_totalprice', 'o_totalprice')}, o_orderpriority FROM orders",
)
def _(v: Views):
    rows = v.table("orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = scratch(v.spark, "extract")
    sinks.write_once(rows, path, "o_orderpriority")
    # A second run finds the result and writes nothing.
    return sinks.write_once(rows, path, "o_orderpriority")


def _customer_features(v: Views, shift: float):
    balance = F.col("c_acctbal") + shift
    return v.table("customer").select(
        F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias(KEY),
        F.col("c_acctbal").alias("_balance"),
        F.col("c_mktsegment").alias("_segment"),
        *[(balance + i).alias(c) for i, c in enumerate(FEATURES)],
    )


@query(
    "s6_feature_upsert",
    "SELECT 'w' || c_custkey AS wallet_address, "
    + ", ".join(
        r(f"c_acctbal + {i} + CASE WHEN c_mktsegment = 'BUILDING' THEN 1000 ELSE 0 END", c)
        for i, c in enumerate(FEATURES)
    )
    + " FROM customer WHERE c_acctbal > 0 OR c_mktsegment = 'BUILDING'",
)
def _(v: Views):
    path = scratch(v.spark, "features")
    sinks.upsert_features(_customer_features(v, 0.0).where("_balance > 0"), path, "1")
    return sinks.upsert_features(_customer_features(v, 1000.0).where("_segment = 'BUILDING'"), path, "2")


@query(
    "s7_feature_append",
    "SELECT 'w' || c_custkey AS wallet_address, "
    + ", ".join(
        r("CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END" if i == 0 else f"c_acctbal + {i}", c)
        for i, c in enumerate(FEATURES)
    )
    + " FROM customer",
)
def _(v: Views):
    first = FEATURES[0]
    rows = _customer_features(v, 0.0).withColumn(first, F.when(F.col("_segment") != "BUILDING", F.col(first)))
    path = scratch(v.spark, "appended")
    sinks.append_features(rows.where("_balance > 0"), path)
    return sinks.append_features(rows.where("_balance <= 0"), path)


@query(
    "s8_label_replace",
    f"""SELECT 'w' || c_custkey AS address, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'hodler' END AS label,
    '' AS source, {r('0', 'total_tx')}, {r('0', 'dex_tx')}, {r('0', 'dex_ratio')},
    {r('c_acctbal', 'total_eth')}, {r('0', 'tx_per_day')}, '' AS wallet_address FROM customer""",
)
def _(v: Views):
    labels = v.table("customer").select(
        F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("address"),
        F.when(F.col("c_mktsegment") != "BUILDING", "hodler").alias("label"),
        F.col("c_acctbal").alias("total_eth"),
    )
    path = scratch(v.spark, "labels")
    # The second load replaces the first one whole.
    sinks.replace_labels(labels.where("total_eth > 0"), path)
    return sinks.replace_labels(labels, path)


@query(
    "s9_raw_load_transactions",
    f"""SELECT hash, block_number, block_timestamp, from_address, to_address,
    {r('CASE WHEN receipt_status = 0 THEN 0 ELSE value_eth END', 'value_eth')}, CAST(gas AS BIGINT) AS gas,
    CAST(CASE WHEN value_eth > 100 THEN 0 ELSE gas_price END AS BIGINT) AS gas_price, receipt_status,
    CASE WHEN method_id = '0x' THEN '' ELSE method_id END AS method_id FROM tx""",
    "tx",
)
def _(v: Views):
    value = F.col("value_eth")
    rows = (
        v.tx.withColumn("gas_price", F.when(value <= 100, F.col("gas_price")))
        .withColumn("method_id", F.when(F.col("method_id") != "0x", F.col("method_id")))
        .withColumn("value_eth", F.when(F.col("receipt_status") == 0, "none").otherwise(value.cast("string")))
    )
    return sinks.load_raw(rows, "raw_transactions", scratch(v.spark, "raw-tx"))


@query(
    "s9_raw_load_transfers",
    """SELECT transaction_hash, block_timestamp, from_address, to_address, token_address,
    coalesce(CAST(amount AS VARCHAR), '') AS raw_value,
    CAST(CASE WHEN raw_value > 100 THEN 0 ELSE is_erc20 END AS INT) AS is_erc20,
    CAST(is_erc721 AS INT) AS is_erc721 FROM src_tt""",
    "src_tt",
)
def _(v: Views):
    flags = v.tt.select(
        "transaction_hash", F.when(F.col("raw_value") <= 100, F.col("is_erc20")).alias("is_erc20"), "is_erc721"
    )
    amount = F.when(F.col("value") != "n/a", F.col("value"))
    rows = v.source_transfers.withColumn("raw_value", amount).join(flags, "transaction_hash")
    return sinks.load_raw(rows, "raw_token_transfers", scratch(v.spark, "raw-tt"))


@query(
    "s9_raw_load_calls",
    f"""SELECT transaction_hash, block_timestamp, from_address, to_address, trace_type,
    {r('value_eth', 'value_eth')}, CAST(status AS DOUBLE) AS status FROM ci""",
    "ci",
)
def _(v: Views):
    return sinks.load_raw(v.ci, "raw_contract_interactions", scratch(v.spark, "raw-ci"))


@query(
    "s10_label_file",
    """SELECT 'w' || c_custkey AS address, lower(c_mktsegment) AS label_name, 'w' || c_custkey AS wallet_address
    FROM customer""",
)
def _(v: Views):
    labels = v.table("customer").select(
        F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("address"),
        F.lower("c_mktsegment").alias("label"),
    )
    path = scratch(v.spark, "label-file")
    sinks.save_labels(labels, path)
    saved = scans.read_labels(v.spark, path)
    # The same labels by way of a CSV file.
    csv = scratch(v.spark, "label-csv")
    saved.write.csv(csv, header=True)
    return scans.read_labels(v.spark, csv, "address string, label string, wallet_address string")


@query(
    "s11_token_list",
    """SELECT lower('0xAB' || p_partkey) AS address, p_name || ' (' || p_brand || ')' AS label,
    'token' AS category, 'coingecko_token_list' AS source FROM part WHERE p_partkey % 2 = 1""",
)
def _(v: Views):
    return registry.token_list_rows(v.token_documents)


@query(
    "s12_protocol_list",
    """SELECT lower('0xCD' || s_suppkey) AS address, s_name AS label,
    CASE s_suppkey % 8 WHEN 0 THEN 'dex' WHEN 1 THEN 'lending' WHEN 2 THEN 'lending' WHEN 3 THEN 'bridge'
    WHEN 4 THEN 'yield' WHEN 5 THEN 'staking' WHEN 6 THEN 'exchange' ELSE 'real_world_assets' END AS category,
    'defillama' AS source FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0""",
)
def _(v: Views):
    return registry.protocol_list_rows(v.protocol_documents)


# ----------------------------------------------------------- projections


@query(
    "p1_transaction_extract",
    f"""SELECT hash, block_number, block_timestamp, from_address, to_address, {r('value_eth', 'value_eth')},
    {r('gas', 'gas')}, {r('gas_price', 'gas_price')}, receipt_status, substr(method_id || '00ff', 1, 10) AS method_id
    FROM tx WHERE {SHORT_SQL} AND {SIDES}""",
    "tx wanted",
)
def _(v: Views):
    return ledger.project_transactions(v.source_transactions, wanted(v), **SHORT)


@query(
    "p2_token_transfer_extract",
    f"""SELECT transaction_hash, block_timestamp, from_address, to_address, token_address,
    coalesce(CAST(amount AS VARCHAR), 'n/a') AS raw_value, c.is_erc20, c.is_erc721
    FROM src_tt LEFT JOIN contracts c ON token_address = c.address WHERE {SHORT_SQL} AND {SIDES}""",
    "src_tt contracts wanted",
)
def _(v: Views):
    return ledger.project_token_transfers(v.source_transfers, v.contracts, wanted(v), **SHORT)


@query(
    "p3_contract_call_extract",
    f"""SELECT transaction_hash, block_timestamp, from_address, to_address, trace_type, {r('value_eth', 'value_eth')},
    {r('50000', 'gas_used')}, status, '0xa9059cbb' AS method_id, c.is_erc20, c.is_erc721
    FROM ci LEFT JOIN contracts c ON to_address = c.address
    WHERE {SHORT_SQL} AND event_id % 10 <> 7 AND {SIDES}""",
    "ci contracts wanted",
)
def _(v: Views):
    return ledger.project_contract_calls(v.source_traces, v.contracts, wanted(v), **SHORT)


@query("p4_rolling_window", f"SELECT hash, block_timestamp FROM tx WHERE {SHORT_SQL}", "tx")
def _(v: Views):
    return v.tx.where(in_window(F.col("block_timestamp"), **SHORT)).select("hash", "block_timestamp")


_ADDRESS = """CASE c_custkey % 3 WHEN 0 THEN '0x' || md5(c_name) || substr(md5(c_name), 1, 8)
    WHEN 1 THEN '0x' || upper(md5(c_name)) || substr(md5(c_name), 1, 8) ELSE md5(c_name) END"""


@query(
    "p7_address_check",
    f"""SELECT c_custkey, lower({_ADDRESS}) AS address,
    regexp_full_match({_ADDRESS}, '0x[a-fA-F0-9]{{40}}') AS valid FROM customer""",
)
def _(v: Views):
    hashed = F.md5("c_name")
    head = F.when(F.col("c_custkey") % 3 == 1, F.upper(hashed)).otherwise(hashed)
    full = F.concat(F.lit("0x"), head, F.substring(hashed, 1, 8))
    address = F.when(F.col("c_custkey") % 3 == 2, hashed).otherwise(full)
    return v.table("customer").select("c_custkey", F.lower(address).alias("address"), valid_address(address).alias("valid"))


@query(
    "p8_known_contracts",
    """SELECT c.address, r.label, 'known_protocol' AS source, CASE WHEN is_erc20 THEN 'erc20_contract'
    WHEN is_erc721 THEN 'nft_contract' ELSE 'contract' END AS contract_type
    FROM contracts c JOIN registry r USING (address)""",
    "contracts registry",
)
def _(v: Views):
    return registry.name_known_contracts(v.contracts, registry.latest(v.registry))


# ---------------------------------------------------------------- ledger


@query(
    "e1_ledger_transactions",
    f"SELECT wallet_address, hash, from_address, to_address, {r('value_eth', 'value')}, method_id AS input FROM led",
    "led",
)
def _(v: Views):
    return v.led.select(KEY, "hash", "from_address", "to_address", "value", "input")


@query(
    "e1_ledger_transfers",
    f"SELECT wallet_address, transaction_hash, token_address, {r('raw_value', 'value')} FROM led_tt",
    "led_tt",
)
def _(v: Views):
    return v.led_tt.select(KEY, "transaction_hash", "token_address", "value")


@query("e1_ledger_calls", "SELECT wallet_address, transaction_hash, to_address FROM led_ci", "led_ci")
def _(v: Views):
    # Twice the calls give the same ledger: equal rows are dropped.
    doubled = v.ci.unionByName(v.ci)
    return ledger.explode_contract_calls(doubled, v.active).select(KEY, "transaction_hash", "to_address")


# ---------------------------------------------------------- sample, staging

SAMPLE = {"min_tx": 10, "min_eth": 1000.0, "max_accounts": 90}


@query(
    "m1_account_sample",
    f"""q AS (SELECT wallet_address, count(*) AS tx_count, sum(wei) AS total FROM (
        SELECT from_address AS wallet_address, wei FROM src_tx WHERE {RECENT}
        UNION ALL SELECT to_address, wei FROM src_tx WHERE {RECENT}) GROUP BY 1
        HAVING count(*) >= 10 AND sum(wei) >= CAST(1000 AS HUGEINT) * 1000000000000000000),
    t AS (SELECT *, ntile(3) OVER (ORDER BY total DESC, wallet_address) AS tier FROM q),
    n AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5(wallet_address), wallet_address) AS rn FROM t)
    SELECT wallet_address, tx_count, {r('total / 1e18', 'total_eth')} FROM n WHERE rn <= 30""",
    "src_tx",
)
def _(v: Views):
    return staging.sample_accounts(v.source_transactions, **WINDOW, **SAMPLE)


STAGE_TX = f"""good AS (SELECT * FROM src_tx WHERE receipt_status = 1 AND {RECENT}),
sides AS (SELECT from_address AS a, to_address AS o, true AS s, * FROM good
    UNION ALL SELECT to_address, from_address, false, * FROM good),
stx AS (SELECT a AS wallet_address, count(*) AS tx_count, count(*) FILTER (s) AS tx_count_sent,
    count(*) FILTER (NOT s) AS tx_count_received,
    coalesce(sum(wei) FILTER (s) / 1e18, 0) AS total_value_sent_eth,
    coalesce(sum(wei) FILTER (NOT s) / 1e18, 0) AS total_value_received_eth,
    sum(wei) / 1e18 / count(*) AS avg_value_per_tx,
    min(block_timestamp) AS first_tx_timestamp, max(block_timestamp) AS last_tx_timestamp,
    greatest(count(DISTINCT CASE WHEN s THEN CAST(block_timestamp AS DATE) END),
        count(DISTINCT CASE WHEN NOT s THEN CAST(block_timestamp AS DATE) END)) AS active_days,
    (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(min(block_timestamp))) // 86400000000 AS days_since_first_tx,
    count(DISTINCT CASE WHEN s THEN o END) + count(DISTINCT CASE WHEN NOT s THEN o END) AS unique_counterparties,
    coalesce(avg(gas_price) FILTER (s), 0) AS avg_gas_price,
    coalesce(sum(21000.0 * gas_price / 1e18) FILTER (s), 0) AS total_gas_spent_eth,
    quantile_disc(wei, 0.5) / 1e18 AS median_value_per_tx
    FROM sides GROUP BY a
    HAVING count(*) >= 10 AND sum(wei) >= CAST(1000000000000000000 AS HUGEINT))"""

STAGE_TT = f"""kinds AS (SELECT wallet_address, s, token_address, erc20, count(*) AS n FROM (
        SELECT from_address AS wallet_address, true AS s, token_address, coalesce(amount > 1, false) AS erc20
        FROM src_tt WHERE {RECENT}
        UNION ALL SELECT to_address, false, token_address, coalesce(amount > 1, false) FROM src_tt WHERE {RECENT})
    GROUP BY ALL),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY wallet_address) AS p FROM kinds),
stt AS (SELECT wallet_address, count(DISTINCT token_address) AS unique_tokens_interacted,
    CAST(sum(CASE WHEN erc20 THEN n ELSE 0 END) AS BIGINT) AS erc20_transfer_count,
    CAST(sum(CASE WHEN erc20 THEN 0 ELSE n END) AS BIGINT) AS erc721_transfer_count,
    max(p) AS top_token_concentration, -sum(p * ln(p)) AS token_diversity_entropy FROM shares GROUP BY 1)"""

_COUNTED = ", ".join(
    f"count(*) FILTER (k >= {low} AND k < {high}) AS {name}"
    for name, (low, high) in {
        "dex_interaction_count": (0, 20),
        "lending_interaction_count": (20, 30),
        "bridge_interaction_count": (40, 50),
        "nft_marketplace_interaction_count": (30, 40),
    }.items()
)
STAGE_CI = f"""sci AS (SELECT from_address AS wallet_address, count(DISTINCT to_address) AS unique_contracts_called,
    count(*) AS contract_call_count, {_COUNTED} FROM ci
    WHERE status = 1 AND event_id % 10 <> 7 AND {RECENT} GROUP BY 1)"""

TX_COUNTS = ["tx_count", "tx_count_sent", "tx_count_received", "active_days", "days_since_first_tx"]
TX_COUNTS += ["unique_counterparties"]
TX_NUMBERS = ["total_value_sent_eth", "total_value_received_eth", "avg_value_per_tx", "avg_gas_price"]
TX_NUMBERS += ["total_gas_spent_eth", "median_value_per_tx"]
TX_TIMES = ["first_tx_timestamp", "last_tx_timestamp"]
TX_OUT = ", ".join(["wallet_address", *TX_COUNTS, *TX_TIMES, *[r(c, c) for c in TX_NUMBERS]])
TT_COUNTS = staging.TOKEN_COLUMNS[:3]
TT_NUMBERS = staging.TOKEN_COLUMNS[3:]


@query("m2_staged_transactions", f"{STAGE_TX} SELECT {TX_OUT} FROM stx", "src_tx")
def _(v: Views):
    return staging.stage_transactions(v.source_transactions, **WINDOW)


@query(
    "m3_staged_token_activity",
    f"{STAGE_TT} SELECT wallet_address, {', '.join(TT_COUNTS)}, {', '.join(r(c, c) for c in TT_NUMBERS)} FROM stt",
    "src_tt",
)
def _(v: Views):
    return staging.stage_token_activity(v.source_transfers, **WINDOW)


@query("m4_staged_contract_calls", f"{STAGE_CI} SELECT * FROM sci", "ci")
def _(v: Views):
    return staging.stage_contract_calls(v.source_traces, **WINDOW, book=book("c"))


RHYTHM = """hours AS (SELECT a AS wallet_address, hour(block_timestamp) AS h, count(*) AS n FROM sides GROUP BY 1, 2),
hshare AS (SELECT *, n / sum(n) OVER (PARTITION BY wallet_address) AS p FROM hours),
he AS (SELECT wallet_address, -sum(p * ln(p)) AS hour_of_day_entropy FROM hshare GROUP BY 1),
wk AS (SELECT a AS wallet_address, count(*) FILTER (isodow(block_timestamp) >= 6) AS we,
    count(*) FILTER (isodow(block_timestamp) < 6) AS wd FROM sides GROUP BY 1),
hh AS (SELECT a AS wallet_address, date_trunc('hour', block_timestamp) AS h, count(*) AS n FROM sides GROUP BY 1, 2),
bu AS (SELECT wallet_address, max(n) / avg(n) AS burst_score FROM hh GROUP BY 1),
cp AS (SELECT from_address AS wallet_address, to_address, count(*) AS n FROM good GROUP BY 1, 2),
cs AS (SELECT *, n / sum(n) OVER (PARTITION BY wallet_address) AS p FROM cp),
hhi AS (SELECT wallet_address, sum(p * p) AS counterparty_concentration FROM cs GROUP BY 1)"""

FEATURE_TABLE = f"""{STAGE_TX}, {STAGE_TT}, {STAGE_CI}, {RHYTHM},
bf AS (SELECT stx.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in staging.TOKEN_COLUMNS + staging.CALL_COLUMNS)},
    tx_count / nullif(days_since_first_tx, 0) AS tx_frequency_per_day,
    active_days / nullif(days_since_first_tx, 0) AS activity_regularity,
    coalesce(hour_of_day_entropy, 0) AS hour_of_day_entropy,
    we / nullif(wd, 0) AS weekend_vs_weekday_ratio, c.address IS NOT NULL AS is_contract,
    dex_interaction_count / nullif(contract_call_count, 0) AS dex_to_total_ratio,
    lending_interaction_count / nullif(contract_call_count, 0) AS lending_to_total_ratio,
    coalesce(counterparty_concentration, 0) AS counterparty_concentration,
    (total_value_sent_eth + total_value_received_eth) / nullif(active_days, 0) AS value_velocity,
    coalesce(burst_score, 1) AS burst_score
    FROM stx LEFT JOIN stt USING (wallet_address) LEFT JOIN sci USING (wallet_address)
    LEFT JOIN he USING (wallet_address) LEFT JOIN wk USING (wallet_address) LEFT JOIN bu USING (wallet_address)
    LEFT JOIN hhi USING (wallet_address) LEFT JOIN contracts c ON c.address = stx.wallet_address)"""

DERIVED = [c for c in staging.SCORED if c not in TX_COUNTS + TX_NUMBERS + staging.TOKEN_COLUMNS + staging.CALL_COLUMNS]
WHOLE = TX_COUNTS + TT_COUNTS + staging.CALL_COLUMNS


def feature_table(v: Views):
    return staging.behavioural_features(
        v.source_transactions, v.source_transfers, v.source_traces, v.contracts, **WINDOW, book=book("c")
    )


@query(
    "m5_behavioural_features",
    f"""{FEATURE_TABLE} SELECT wallet_address, is_contract, {', '.join(TX_TIMES)}, {', '.join(WHOLE)},
    {', '.join(r(c, c) for c in TX_NUMBERS + TT_NUMBERS + DERIVED)} FROM bf""",
    "src_tx src_tt ci contracts",
)
def _(v: Views):
    return feature_table(v)


_Z = ", ".join(
    r(f"({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0)", f"{c}_z") for c in staging.SCORED
)


@query(
    "m6_feature_mart",
    f"""{FEATURE_TABLE}, filled AS (SELECT * REPLACE ({', '.join(
        f'coalesce({c}, median({c}) OVER ()) AS {c}' for c in staging.GAPPED)}) FROM bf)
    SELECT wallet_address, is_contract, {', '.join(TX_TIMES)}, tx_count, tx_count_sent,
    tx_count_received, {_Z}, TIMESTAMP '{AS_OF}' AS feature_computed_at, {DAYS} AS sample_window_days FROM filled""",
    "src_tx src_tt ci contracts",
)
def _(v: Views):
    return staging.feature_mart(feature_table(v), **WINDOW)


@query(
    "a3_median_value",
    f"""SELECT wallet_address, {r('quantile_disc(wei, 0.5) / 1e18', 'median_value_per_tx')} FROM (
    SELECT from_address AS wallet_address, wei FROM src_tx UNION ALL SELECT to_address, wei FROM src_tx)
    GROUP BY 1""",
    "src_tx",
)
def _(v: Views):
    return staging.median_value(v.source_transactions)


_STATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a8_feature_statistics",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {r(f'min({c})', 'min')}, {r(f'max({c})', 'max')}, {r(f'avg({c})', 'mean')},
        {r(f'stddev_pop({c})', 'std')} FROM lineitem"""
        for c in _STATS
    ),
)
def _(v: Views):
    return feature_stats(v.table("lineitem"), _STATS)


# ------------------------------------------------------------ data tests


def _tables(v: Views):
    staged = {
        "stg_wallet_transactions": staging.stage_transactions(v.source_transactions, **WINDOW),
        "stg_wallet_token_activity": staging.stage_token_activity(v.source_transfers, **WINDOW),
        "stg_wallet_contract_interactions": staging.stage_contract_calls(v.source_traces, **WINDOW, book=book("c")),
    }
    return {
        "transactions": v.source_transactions,
        "token_transfers": v.source_transfers,
        "traces": v.source_traces,
        "contracts": v.contracts,
        **staged,
    }


_CHECKED = {
    "transactions": "(SELECT *, wei AS value FROM src_tx)",
    "token_transfers": "src_tt",
    "traces": "ci",
    "contracts": "contracts",
    "stg_wallet_transactions": "stx",
    "stg_wallet_token_activity": "stt",
    "stg_wallet_contract_interactions": "sci",
}


@query(
    "q1_not_null",
    f"{STAGE_TX}, {STAGE_TT}, {STAGE_CI} "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS failures FROM {source}"
        for t, source in _CHECKED.items()
        for c in quality.NOT_NULL[t]
    ),
    "src_tx src_tt ci contracts",
)
def _(v: Views):
    return quality.not_null_report(_tables(v))


@query(
    "q2_unique",
    f"{STAGE_TX}, {STAGE_TT}, {STAGE_CI} "
    + " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) FILTER (n > 1) AS failures
        FROM (SELECT {c}, count(*) AS n FROM {_CHECKED[t]} WHERE {c} IS NOT NULL GROUP BY 1)"""
        for t, c in quality.UNIQUE.items()
    ),
    "src_tx src_tt ci contracts",
)
def _(v: Views):
    return quality.unique_report(_tables(v))


@query(
    "q2_unique_lineitem_keys",
    """SELECT 'lineitem' AS "table", 'l_orderkey' AS "column", count(*) FILTER (n > 1) AS failures
    FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def _(v: Views):
    return quality.repeated_keys(v.table("lineitem"), "lineitem", "l_orderkey")
