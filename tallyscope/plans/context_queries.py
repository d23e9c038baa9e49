"""The contract registry, account context, and keyed text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.scalars import NAME_CATEGORIES, category_from_name
from tallyscope.operators import context, registry, store
from tallyscope.plans.catalogue import query, r, scratch
from tallyscope.plans.feature_queries import MATRIX, MATRIX_VIEWS, matrix
from tallyscope.schemas import FEATURES, KEY
from tallyscope.sources import batches, sinks
from tallyscope.sources.views import Views, book

# --------------------------------------------------------------- registry

SEED_SQL = """SELECT 'c' || k AS address, 'Contract ' || k AS label, CASE WHEN k < 20 THEN 'dex'
    WHEN k < 30 THEN 'lending' WHEN k < 40 THEN 'nft_marketplace' WHEN k < 50 THEN 'bridge'
    ELSE 'exchange' END AS category, 'hardcoded' AS source FROM nums WHERE k < 55"""


def seed(v: Views) -> DataFrame:
    called = v.events.where(F.col("k") < 55).select("k").distinct()
    known = called.select(
        F.concat(F.lit("C"), F.col("k").cast("string")).alias("address"),
        F.concat(F.lit("Contract "), F.col("k").cast("string")).alias("label"),
    )
    return registry.seed_rows(known, {n: [a.upper() for a in b] for n, b in book("c").items()})


@query("r1_seed_rows", SEED_SQL, "nums")
def _(v: Views):
    return seed(v)


UNKNOWN_SQL = """SELECT to_address, count(*) AS interaction_count FROM ci
    WHERE to_address NOT IN (SELECT address FROM registry) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""


@query("r2_top_unknown_contracts", UNKNOWN_SQL, "ci registry")
def _(v: Views):
    return registry.top_unknown(v.ci, v.registry, 15)


_WORDS = {
    0: ("SwapRouter", "dex"),
    1: ("LendingPoolCore", "dex"),
    2: ("ComptrollerLend", "lending"),
    3: ("Nft721Drop", "nft_marketplace"),
    4: ("L2Inbox", "bridge"),
    5: ("StakeHub", "staking"),
    6: ("YieldVault", "yield"),
    7: ("MyToken", "token"),
    8: ("ProxyAdmin", "proxy"),
    9: ("Greeter", "other"),
}
_NAME = "CASE WHEN k % 4 = 3 OR k % 8 = 2 THEN 'Unverified Contract' ELSE CASE k % 10 " + " ".join(
    f"WHEN {i} THEN '{w}'" for i, (w, _) in _WORDS.items()
) + " END END"
_KIND = "CASE WHEN k % 4 = 3 OR k % 8 = 2 THEN 'unknown' ELSE CASE k % 10 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, (_, c) in _WORDS.items()
) + " END END"
RESOLVED_SQL = f"""SELECT 'c' || k AS address, {_NAME} AS label, {_KIND} AS category, 'etherscan' AS source
    FROM nums WHERE k >= 60"""


def resolved(v: Views) -> DataFrame:
    unknown = registry.unknown_contracts(v.ci, v.registry)
    return registry.resolved_name_rows(unknown.select(F.col("to_address").alias("address")), v.contract_names)


@query("r3_resolved_names", RESOLVED_SQL, "nums")
def _(v: Views):
    return resolved(v)


_KEYWORDS = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(p_name || p_type), '{'|'.join(words)}') THEN '{c}'"
    for c, words in NAME_CATEGORIES
) + " ELSE 'other' END"


@query("x2_category_from_name", f"SELECT p_partkey, {_KEYWORDS} AS category FROM part")
def _(v: Views):
    return v.table("part").select("p_partkey", category_from_name(F.concat("p_name", "p_type")).alias("category"))


_TOKENS = """SELECT lower('0xAB' || p_partkey) AS address, p_name || ' (' || p_brand || ')' AS label,
    'token' AS category, 'coingecko_token_list' AS source FROM part WHERE p_partkey % 2 = 1"""
_PROTOCOLS = """SELECT lower('0xCD' || s_suppkey) AS address, s_name AS label,
    CASE s_suppkey % 8 WHEN 0 THEN 'dex' WHEN 1 THEN 'lending' WHEN 2 THEN 'lending' WHEN 3 THEN 'bridge'
    WHEN 4 THEN 'yield' WHEN 5 THEN 'staking' WHEN 6 THEN 'exchange' ELSE 'real_world_assets' END AS category,
    'defillama' AS source FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0"""
# The seed knows c50..c54 and the supplied registry ends at c59, so sources overlap.
MERGED = f"""every AS (SELECT 0 AS rank, * FROM ({SEED_SQL}) UNION ALL SELECT 1, * FROM ({_TOKENS})
    UNION ALL SELECT 2, * FROM ({_PROTOCOLS}) UNION ALL SELECT 3, * FROM ({RESOLVED_SQL})
    UNION ALL SELECT 4, address, label, category, 'supplied' FROM registry),
merged AS (SELECT address, label, category, source FROM
    (SELECT *, row_number() OVER (PARTITION BY address ORDER BY rank) AS rn FROM every) WHERE rn = 1)"""


def merged(v: Views) -> DataFrame:
    return registry.merge_sources(
        [
            seed(v),
            registry.token_list_rows(v.token_documents),
            registry.protocol_list_rows(v.protocol_documents),
            resolved(v),
            registry.latest(v.registry).drop("updated_at"),
        ]
    )


@query("r4_merged_registry", f"{MERGED} SELECT * FROM merged", "nums registry")
def _(v: Views):
    return merged(v)


@query(
    "r4_registry_counts",
    f"""{MERGED} SELECT source, count(*) AS addresses FROM merged GROUP BY 1
    UNION ALL SELECT 'total_registry_size', count(*) FROM merged""",
    "nums registry",
)
def _(v: Views):
    return registry.counts_by_source(merged(v))


@query(
    "r5_registry_coverage",
    f"""SELECT CAST(count(*) AS BIGINT) AS interactions, count(*) FILTER (k < 60) AS labelled,
    {r('count(*) FILTER (k < 60) / count(*)', 'coverage')} FROM ci""",
    "ci",
)
def _(v: Views):
    return registry.coverage(v.ci, v.registry)


@query(
    "w6_latest_registry",
    """SELECT address, label, category, 'supplied' AS source,
    CASE WHEN k % 2 = 0 THEN TIMESTAMP '2024-01-15' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM registry""",
    "registry",
)
def _(v: Views):
    return registry.latest(v.registry)


# ---------------------------------------------------------------- context

SUMMARY = """summary AS (SELECT wallet_address, count(*) AS total_transactions, sum(value_eth) AS total_eth_volume,
    avg(value_eth) AS avg_tx_value_eth, min(block_timestamp) AS first_seen, max(block_timestamp) AS last_seen
    FROM (SELECT from_address AS wallet_address, * FROM tx UNION ALL
        SELECT to_address, * FROM tx WHERE to_address <> from_address) GROUP BY 1)"""


@query(
    "c1_transaction_summary",
    f"""{SUMMARY} SELECT wallet_address, total_transactions, {r('total_eth_volume', 'total_eth_volume')},
    {r('avg_tx_value_eth', 'avg_tx_value_eth')}, first_seen, last_seen FROM summary""",
    "tx",
)
def _(v: Views):
    return context.transaction_summary(v.tx)


CALLED = """called AS (SELECT from_address AS wallet_address, to_address, count(*) AS interaction_count,
    sum(value_eth) AS total_eth FROM ci GROUP BY 1, 2),
best AS (SELECT wallet_address, CAST(rn AS INT) AS rank, to_address AS address, r.label AS protocol_label,
    coalesce(r.category, 'unknown') AS category, interaction_count, total_eth
    FROM (SELECT *, row_number() OVER (PARTITION BY wallet_address ORDER BY interaction_count DESC, to_address) AS rn
        FROM called) LEFT JOIN registry r ON r.address = to_address WHERE rn <= 10)"""


@query(
    "c2_top_contracts",
    f"""{CALLED} SELECT wallet_address, rank, address, protocol_label, category, interaction_count,
    {r('total_eth', 'total_eth')} FROM best""",
    "ci registry",
)
def _(v: Views):
    return context.top_contracts(v.ci, registry.latest(v.registry))


TOKENS = """tc AS (SELECT wallet_address, token_address, count(*) AS transfer_count,
    count(*) FILTER (is_erc20) AS erc20_count, count(*) FILTER (is_erc721) AS erc721_count
    FROM (SELECT from_address AS wallet_address, * FROM tt UNION ALL SELECT to_address, * FROM tt) GROUP BY 1, 2),
tokens AS (SELECT wallet_address, unique_tokens, CAST(rn AS INT) AS rank, token_address, transfer_count, erc20_count,
    erc721_count FROM (SELECT *, count(*) OVER (PARTITION BY wallet_address) AS unique_tokens, row_number() OVER (
        PARTITION BY wallet_address ORDER BY transfer_count DESC, token_address) AS rn FROM tc) WHERE rn <= 5)"""


@query("c3_token_activity", f"{TOKENS} SELECT * FROM tokens", "tt")
def _(v: Views):
    return context.token_activity(v.tt, 5)


HOURLY = """grid AS (SELECT wallet_address, h FROM (SELECT DISTINCT from_address AS wallet_address FROM tx),
    range(24) g(h)),
hourly AS (SELECT g.wallet_address, h, count(hash) AS n FROM grid g LEFT JOIN tx ON from_address = g.wallet_address
    AND hour(block_timestamp) = h GROUP BY 1, 2)"""


@query(
    "c4_hour_shares",
    f"""{HOURLY} SELECT wallet_address, CAST(h AS INT) AS hour,
    {r('n / sum(n) OVER (PARTITION BY wallet_address)', 'share')} FROM hourly""",
    "tx",
)
def _(v: Views):
    timing = context.timing_patterns(v.tx)
    return timing.select(KEY, F.posexplode("hourly_distribution").alias("hour", "share"))


TIMING = f"""{HOURLY},
top3 AS (SELECT wallet_address, string_agg(h, ',' ORDER BY rn) AS hours FROM (SELECT *, row_number() OVER (
    PARTITION BY wallet_address ORDER BY n DESC, h) AS rn FROM hourly) WHERE rn <= 3 GROUP BY 1),
wr AS (SELECT from_address AS wallet_address, round(avg(CASE WHEN isodow(block_timestamp) <= 5 THEN 1.0 ELSE 0.0
    END), 4) AS weekday_ratio FROM tx GROUP BY 1)"""


@query(
    "c4_active_hours",
    f"{TIMING} SELECT wallet_address, hours AS active_hours, {r('weekday_ratio', 'weekday_ratio')} "
    "FROM top3 JOIN wr USING (wallet_address)",
    "tx",
)
def _(v: Views):
    timing = context.timing_patterns(v.tx)
    hours = F.array_join(F.transform("most_active_hours", lambda h: h.cast("string")), ",")
    return timing.select(KEY, hours.alias("active_hours"), "weekday_ratio")


# All ledger accounts plus the suppliers, some of which have no activity.
ACCOUNTS = "SELECT wallet_address FROM active UNION SELECT 'w' || (1000 + s_suppkey) FROM supplier"


def everything(v: Views) -> DataFrame:
    idle = v.table("supplier").select(F.concat(F.lit("W"), (1000 + F.col("s_suppkey")).cast("string")).alias(KEY))
    return context.account_context(
        v.active.unionByName(idle), v.tx, v.ci, v.tt, registry.latest(v.registry)
    )


CONTEXT = f"{SUMMARY}, {CALLED}, {TOKENS}, {TIMING}, accounts AS ({ACCOUNTS})"
CONTEXT_VIEWS = "tx ci tt registry active"
_JOINED = """accounts LEFT JOIN summary USING (wallet_address)
    LEFT JOIN (SELECT wallet_address, string_agg(address || ':' || interaction_count || ':' || category, ' '
        ORDER BY rank) AS contracts FROM best GROUP BY 1) USING (wallet_address)
    LEFT JOIN (SELECT wallet_address, any_value(unique_tokens) AS unique_tokens,
        string_agg(token_address || ':' || transfer_count, ' ' ORDER BY rank) AS tokens FROM tokens GROUP BY 1)
        USING (wallet_address)
    LEFT JOIN top3 USING (wallet_address) LEFT JOIN wr USING (wallet_address)"""


@query(
    "c5_account_context",
    f"""{CONTEXT} SELECT wallet_address, total_transactions, {r('total_eth_volume', 'total_eth_volume')}, contracts,
    unique_tokens, tokens, hours, {r('weekday_ratio', 'weekday_ratio')} FROM {_JOINED}""",
    CONTEXT_VIEWS,
)
def _(v: Views):
    found = everything(v)
    text = lambda c: c.cast("string")
    contracts = F.transform(
        "top_contracts", lambda c: F.concat_ws(":", c["address"], text(c["interaction_count"]), c["category"])
    )
    top = F.slice("token_activity.top_tokens", 1, 5)
    tokens = F.transform(top, lambda t: F.concat_ws(":", t["token_address"], text(t["transfer_count"])))
    return found.select(
        KEY,
        "transaction_summary.total_transactions",
        "transaction_summary.total_eth_volume",
        F.array_join(contracts, " ").alias("contracts"),
        F.col("token_activity.unique_tokens"),
        F.array_join(tokens, " ").alias("tokens"),
        F.array_join(F.transform("timing_patterns.most_active_hours", text), ",").alias("hours"),
        "timing_patterns.weekday_ratio",
    )


@query(
    "c6_flat_context",
    f"""{CONTEXT} SELECT wallet_address, coalesce(total_transactions, 0) AS tx_count,
    {r('round(coalesce(total_eth_volume, 0), 2)', 'total_eth')},
    {r('round(coalesce(avg_tx_value_eth, 0), 4)', 'avg_tx_eth')}, first_seen, last_seen,
    coalesce(unique_tokens, 0) AS unique_tokens, {r('coalesce(weekday_ratio, 0)', 'weekday_ratio')},
    coalesce(hours, '') AS active_hours, b.label, b.interactions, {r('b.eth', 'eth')} FROM {_JOINED}
    LEFT JOIN (SELECT wallet_address, coalesce(protocol_label, 'Unknown') AS label,
        interaction_count AS interactions, round(total_eth, 2) AS eth FROM best WHERE rank <= 5) b
        USING (wallet_address)""",
    CONTEXT_VIEWS,
)
def _(v: Views):
    flat = context.flat_context(everything(v))
    hours = F.array_join(F.transform("active_hours", lambda h: h.cast("string")), ",")
    return (
        flat.withColumn("active_hours", hours)
        .withColumn("_c", F.explode_outer("top_contracts"))
        .select(
            *[c for c in flat.columns if c != "top_contracts"],
            F.col("_c.label"),
            F.col("_c.interactions"),
            F.col("_c.eth"),
        )
    )


@query(
    "c7_exemplar_profiles",
    f"""{CONTEXT},
    prof AS (SELECT wallet_address, string_agg(protocol_label || ' [' || category || ']', ', ' ORDER BY rank)
        FILTER (protocol_label IS NOT NULL AND nth <= 5) AS top_protocols,
        round(count(*) FILTER (protocol_label IS NULL) / count(*), 2) AS unknown_contract_pct
        FROM (SELECT *, sum(CASE WHEN protocol_label IS NULL THEN 0 ELSE 1 END) OVER (
            PARTITION BY wallet_address ORDER BY rank) AS nth FROM best) GROUP BY 1)
    SELECT wallet_address, coalesce(total_transactions, 0) AS tx_count,
    {r('coalesce(avg_tx_value_eth, 0)', 'avg_tx_eth')}, first_seen, last_seen,
    coalesce(unique_tokens, 0) AS unique_tokens, {r('coalesce(weekday_ratio, 0)', 'weekday_ratio')},
    '[' || coalesce(replace(hours, ',', ', '), '') || ']' AS active_hours,
    coalesce(top_protocols, 'None identified') AS top_protocols,
    {r('coalesce(unknown_contract_pct, 0)', 'unknown_contract_pct')}
    FROM {_JOINED} LEFT JOIN prof USING (wallet_address)""",
    CONTEXT_VIEWS,
)
def _(v: Views):
    found = everything(v)
    return context.profile_exemplars(found.select(KEY), found)


@query(
    "c8_account_text",
    """SELECT 'w' || c_custkey AS wallet_address, 'Account w' || c_custkey || ' is labelled ' || lower(c_mktsegment)
    || ' with confidence ' || format('{:.1f}', c_nationkey * 4.0) || '%.' || chr(10) || 'Its behaviour:' || chr(10)
    || '  orders: ' || c_nationkey || chr(10) || '  tier: ' || (c_custkey % 3) || chr(10)
    || 'Describe its strategy and its part in the market in two or three sentences.' AS prompt FROM customer""",
)
def _(v: Views):
    scored = v.table("customer").select(
        F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias(KEY),
        F.lower("c_mktsegment").alias("label"),
        (F.col("c_nationkey") * 0.04).alias("confidence"),
        F.col("c_nationkey").alias("orders"),
        (F.col("c_custkey") % 3).alias("tier"),
    )
    return context.describe_accounts(scored, ["orders", "tier"])


_PAIR = """SELECT a.n AS first, b.n AS second, 'First account ' || a.n || ':' || chr(10) || a.t || chr(10)
    || 'Second account ' || b.n || ':' || chr(10) || b.t || chr(10)
    || 'Compare both: what they share, how they differ, and whether one owner is likely.' AS prompt"""


@query(
    "c8_comparison_text",
    f"""f AS (SELECT 'w' || c_custkey AS n, c_custkey, '  nation: ' || c_nationkey || chr(10) || '  segment: '
        || c_mktsegment AS t FROM customer)
    {_PAIR} FROM f a JOIN f b ON b.c_custkey = a.c_custkey + 1""",
)
def _(v: Views):
    key = F.col("c_custkey")
    account = lambda k: F.concat(F.lit("w"), k.cast("string"))
    known = v.table("customer").select(
        account(key).alias(KEY), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    pairs = v.table("customer").select(account(key).alias("first"), account(key + 1).alias("second"))
    return context.compare_accounts(pairs, known, ["nation", "segment"])


@query(
    "s14_sampled_contexts",
    f"""{CONTEXT} SELECT wallet_address, coalesce(total_transactions, 0) AS tx_count,
    {r('round(coalesce(total_eth_volume, 0), 2)', 'total_eth')}, coalesce(hours, '') AS active_hours,
    coalesce(b.n, 0) AS contracts FROM {_JOINED} LEFT JOIN (SELECT wallet_address, CAST(count(*) AS INT) AS n
    FROM best WHERE rank <= 5 GROUP BY 1) b USING (wallet_address)""",
    CONTEXT_VIEWS,
)
def _(v: Views):
    flat = context.flat_context(everything(v))
    saved = sinks.write_json(flat, scratch(v.spark, "contexts"))
    hours = F.array_join(F.transform("active_hours", lambda h: h.cast("string")), ",")
    return saved.select(
        KEY, "tx_count", "total_eth", hours.alias("active_hours"), F.size("top_contracts").alias("contracts")
    )


# ----------------------------------------------------- texts and lookups


def texts(v: Views) -> DataFrame:
    """Assistant turns as cached texts, each created in the hour of its turn."""
    turns = v.table("conversations").where(F.col("role") == "assistant")
    entries = store.text_entries(
        turns.select(
            F.concat(F.lit("w"), (F.col("conv_id") % 50).cast("string")).alias(KEY),
            F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.md5("text")).alias("narrative"),
            (F.col("conv_id") % 40).alias("_h"),
        ).drop("_h"),
        created_at="2024-01-30 00:00:00",
    )
    hour = F.split("narrative", "#")[0].cast("int") % 40
    shift = F.make_interval(hours=hour)
    return entries.withColumn("created_at", F.col("created_at") + shift).withColumn(
        "expires_at", F.col("expires_at") + shift
    )


ENTRIES = """entries AS (SELECT 'w' || (conv_id % 50) AS wallet_address,
    conv_id || '#' || turn || '#' || md5(text) AS narrative, -1 AS cluster_id,
    TIMESTAMP '2024-01-30' + to_hours(CAST(conv_id % 40 AS INT)) AS created_at,
    TIMESTAMP '2024-01-31' + to_hours(CAST(conv_id % 40 AS INT)) AS expires_at
    FROM conversations WHERE role = 'assistant')"""
NOW = "2024-01-31 12:00:00"


@query(
    "k1_purged_texts",
    f"""{ENTRIES} SELECT * FROM entries WHERE expires_at > TIMESTAMP '{NOW}'
    AND wallet_address NOT IN (SELECT 'w' || s_nationkey FROM supplier)""",
)
def _(v: Views):
    gone = v.table("supplier").select(F.concat(F.lit("w"), F.col("s_nationkey").cast("string")).alias(KEY))
    # The purged table is written whole; readers of the old one are not disturbed.
    path = scratch(v.spark, "texts")
    store.invalidate(store.unexpired(texts(v), NOW), gone).write.parquet(path)
    return v.spark.read.parquet(path)


@query(
    "k1_text_table",
    f"""{ENTRIES} SELECT * FROM entries WHERE expires_at > TIMESTAMP '{NOW}'
    AND (wallet_address NOT IN (SELECT 'w' || s_nationkey FROM supplier) OR hour(created_at) % 2 = 1)""",
)
def _(v: Views):
    path = scratch(v.spark, "texts")
    entries, odd = texts(v), F.hour("created_at") % 2 == 1
    # Texts that are flushed at once must not come back.
    batches.append_texts(entries, path)
    batches.flush_texts(v.spark, path)
    batches.append_texts(entries.where(~odd), path)
    gone = v.table("supplier").select(F.concat(F.lit("w"), F.col("s_nationkey").cast("string")).alias(KEY))
    batches.remove_texts(gone, path)
    batches.append_texts(entries.where(odd), path)
    batches.purge_texts(v.spark, path, NOW)
    return batches.read_texts(v.spark, path)


@query(
    "w8_current_texts",
    f"""{ENTRIES} SELECT wallet_address, narrative, cluster_id, created_at, expires_at FROM (
    SELECT *, row_number() OVER (PARTITION BY wallet_address ORDER BY created_at DESC, narrative DESC) AS rn
    FROM entries WHERE expires_at > TIMESTAMP '{NOW}') WHERE rn = 1""",
)
def _(v: Views):
    return store.current_texts(texts(v), NOW)


@query(
    "k2_feature_lookup",
    f"""{MATRIX} SELECT wallet_address, {', '.join(r(c, c) for c in FEATURES)} FROM feats
    WHERE wallet_address IN (SELECT wallet_address FROM wanted)""",
    f"{MATRIX_VIEWS} wanted",
)
def _(v: Views):
    rich = v.table("supplier").where(F.col("s_acctbal") > 5000)
    wanted = rich.select(F.concat(F.lit("w"), F.col("s_suppkey").cast("string")).alias(KEY))
    return store.lookup(matrix(v), wanted)
