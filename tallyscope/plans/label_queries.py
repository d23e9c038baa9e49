"""Rule labels, their resolution, and label assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators import clusters, labels
from tallyscope.plans.catalogue import query, r, scratch
from tallyscope.schemas import KEY, LABEL_PRIORITY
from tallyscope.sources import batches
from tallyscope.sources.views import Views, book

# Senders that count as protocols in the views.
PROTOCOLS = ["w3", "w7"]
EXCLUDED = "from_address NOT IN ('w3', 'w7')"

# Thresholds that select some, but not all, accounts of the views.
LIMITS = {
    "mev_bot": {"min_sandwich": 5, "min_arb": 3},
    "smart_money": {"min_eth": 3000.0, "min_tx_per_day": 1.0, "min_share": 0.20},
    "defi_farmer": {"min_tx": 50, "min_share": 0.25},
    "nft_trader": {"min_tx": 10, "min_share": 0.15},
    "airdrop_hunter": {"min_contracts": 20, "min_bridge": 3},
    "hodler": {"min_eth": 3000.0, "max_tx_per_day": 2.4},
}

STATS = f"""cs AS (SELECT from_address AS address, count(*) AS calls, count(DISTINCT to_address) AS callees,
    count(*) FILTER (k < 20) AS dex_calls, avg(CASE WHEN k < 20 THEN 1 ELSE 0 END) AS dex_share,
    avg(CASE WHEN k >= 30 AND k < 40 THEN 1 ELSE 0 END) AS nft_share,
    count(*) FILTER (k >= 40 AND k < 50) AS bridge_calls FROM ci WHERE {EXCLUDED} GROUP BY 1),
ss AS (SELECT from_address AS address, count(*) AS total_tx, sum(value_eth) AS total_eth,
    count(*) / count(DISTINCT CAST(block_timestamp AS DATE)) AS tx_per_day FROM tx WHERE {EXCLUDED} GROUP BY 1),
pb AS (SELECT from_address AS address, block_number, count(*) AS n, count(DISTINCT CASE
    WHEN CAST(substr(to_address, 2) AS INT) < 20 THEN to_address END) AS routers
    FROM tx WHERE {EXCLUDED} GROUP BY 1, 2),
bs AS (SELECT address, count(*) FILTER (n >= 2 AND routers >= 1) AS sandwich_blocks,
    count(*) FILTER (routers >= 2) AS arb_blocks FROM pb GROUP BY 1)"""

MEV = "sandwich_blocks >= 5 OR arb_blocks >= 3"
SMART = "total_eth >= 3000 AND tx_per_day >= 1 AND dex_share >= 0.2"
FARMER = "calls >= 50 AND dex_share >= 0.25"
NFT = "calls >= 10 AND nft_share >= 0.15"
HUNTER = "callees >= 20 AND bridge_calls >= 3"
WHALE = "total_eth >= 3000 AND tx_per_day <= 2.4"


def calls(v: Views) -> DataFrame:
    return labels.call_stats(v.ci, book("c"), PROTOCOLS)


def senders(v: Views) -> DataFrame:
    return labels.sender_stats(v.tx, PROTOCOLS)


def blocks(v: Views) -> DataFrame:
    return labels.block_stats(v.tx, book("w")["dex"], PROTOCOLS)


def named(label: str, source: str) -> str:
    return f"address, '{label}' AS label, '{source}' AS source"


@query(
    "l1_dex_heavy_calls",
    f"""{STATS} SELECT {named('defi_farmer', 'dex_heavy_heuristic_local')}, calls AS total_tx, dex_calls AS dex_tx,
    {r('dex_share', 'dex_ratio')} FROM cs WHERE {FARMER}""",
    "tx ci",
)
def _(v: Views):
    return labels.label_dex_heavy(calls(v), **LIMITS["defi_farmer"])


@query(
    "l1_dex_heavy_transactions",
    f"""d AS (SELECT from_address AS address, count(*) AS total_tx,
        count(*) FILTER (CAST(substr(to_address, 2) AS INT) < 20) AS dex_tx FROM tx WHERE {EXCLUDED}
        GROUP BY 1 HAVING count(*) >= 50)
    SELECT {named('defi_farmer', 'dex_heavy_heuristic')}, total_tx, dex_tx, {r('dex_tx / total_tx', 'dex_ratio')}
    FROM d WHERE dex_tx / total_tx >= 0.2 ORDER BY dex_tx / total_tx DESC, address LIMIT 20""",
    "tx",
)
def _(v: Views):
    return labels.label_dex_heavy_transactions(
        v.tx, book("w")["dex"], min_tx=50, min_share=0.2, limit=20, excluded=PROTOCOLS
    )


@query(
    "l2_mev_bots",
    f"{STATS} SELECT {named('mev_bot', 'mev_pattern_heuristic_local')} FROM bs WHERE {MEV}",
    "tx ci",
)
def _(v: Views):
    return labels.label_mev_bots(blocks(v), **LIMITS["mev_bot"])


def spelled(df: DataFrame) -> DataFrame:
    """Every third row with its addresses in capitals, as sources with checksummed addresses have them."""
    capital = F.pmod(F.crc32("transaction_hash"), F.lit(3)) == 0
    return df.withColumns({c: F.when(capital, F.upper(c)).otherwise(F.col(c)) for c in ("from_address", "to_address")})


TRACES = f"""tr AS (SELECT from_address AS address, count(*) AS trace_mev_tx FROM ci
    WHERE call_type = 'call' AND k < 20 AND {EXCLUDED} GROUP BY 1 HAVING count(*) >= 15)"""


@query("l3_trace_candidates", f"{TRACES} SELECT address, trace_mev_tx FROM tr", "ci")
def _(v: Views):
    return labels.trace_candidates(spelled(v.source_traces), book("c")["dex"], min_calls=15, excluded=PROTOCOLS)


@query(
    "l4_whales",
    f"""{STATS} SELECT {named('hodler', 'whale_heuristic_local')}, total_tx, {r('total_eth', 'total_eth')},
    {r('tx_per_day', 'tx_per_day')} FROM ss WHERE {WHALE}""",
    "tx ci",
)
def _(v: Views):
    return labels.label_whales(senders(v), **LIMITS["hodler"])


@query(
    "l4_top_whales",
    f"""{STATS} SELECT {named('hodler', 'whale_heuristic')}, total_tx, {r('total_eth', 'total_eth')},
    {r('tx_per_day', 'tx_per_day')} FROM ss WHERE {WHALE} ORDER BY total_eth DESC, address LIMIT 10""",
    "tx ci",
)
def _(v: Views):
    return labels.label_top_whales(senders(v), limit=10, **LIMITS["hodler"])


@query(
    "l5_nft_traders",
    f"{STATS} SELECT {named('nft_trader', 'nft_marketplace_heuristic_local')} FROM cs WHERE {NFT}",
    "tx ci",
)
def _(v: Views):
    return labels.label_nft_traders(calls(v), **LIMITS["nft_trader"])


@query(
    "l6_smart_money",
    f"""{STATS} SELECT {named('smart_money', 'smart_money_heuristic_local')} FROM ss JOIN cs USING (address)
    WHERE {SMART}""",
    "tx ci",
)
def _(v: Views):
    return labels.label_smart_money(senders(v), calls(v), **LIMITS["smart_money"])


@query(
    "l7_airdrop_hunters",
    f"{STATS} SELECT {named('airdrop_hunter', 'airdrop_hunter_heuristic_local')} FROM cs WHERE {HUNTER}",
    "tx ci",
)
def _(v: Views):
    return labels.label_airdrop_hunters(calls(v), **LIMITS["airdrop_hunter"])


_LABEL_CASE = f"""CASE WHEN {MEV} THEN 'mev_bot' WHEN {SMART} THEN 'smart_money' WHEN {FARMER} THEN 'defi_farmer'
    WHEN {NFT} THEN 'nft_trader' WHEN {HUNTER} THEN 'airdrop_hunter' WHEN {WHALE} THEN 'hodler'
    ELSE 'retail_trader' END"""
_SOURCE_CASE = "CASE label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in labels.SOURCES.items()) + " END"

BUILT = f"""{STATS},
chosen AS (SELECT wallet_address AS address, {_LABEL_CASE} AS label, ss.total_tx, total_eth, tx_per_day, calls,
    dex_calls, dex_share FROM active LEFT JOIN ss ON ss.address = wallet_address
    LEFT JOIN cs ON cs.address = wallet_address LEFT JOIN bs ON bs.address = wallet_address
    WHERE wallet_address NOT IN ('w3', 'w7'))"""


def built(v: Views) -> DataFrame:
    c = book("c")
    # The views call contracts c<k> and send transactions to w<k>.
    known = {name: [*c[name], *book("w")[name]] for name in c}
    return labels.build_labels(v.tx, v.ci, v.active, book=known, excluded=PROTOCOLS, limits=LIMITS)


@query(
    "l8_label_table",
    f"""{BUILT} SELECT address, label, {_SOURCE_CASE} AS source,
    CASE label WHEN 'defi_farmer' THEN calls WHEN 'hodler' THEN total_tx END AS total_tx,
    CASE label WHEN 'defi_farmer' THEN dex_calls END AS dex_tx,
    {r("CASE label WHEN 'defi_farmer' THEN dex_share END", 'dex_ratio')},
    {r("CASE label WHEN 'hodler' THEN total_eth END", 'total_eth')},
    {r("CASE label WHEN 'hodler' THEN tx_per_day END", 'tx_per_day')}, address AS wallet_address FROM chosen""",
    "tx ci active",
)
def _(v: Views):
    return built(v)


#: The warehouse rules see the last ten days of the month.
WINDOW = {"as_of": "2024-01-31", "days": 10}
RECENT = "block_timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS"


def _recent(sql: str) -> str:
    return sql.replace("FROM tx", "FROM rtx").replace("FROM ci", "FROM rci")


@query(
    "l9_warehouse_labels",
    f"""rtx AS (SELECT * FROM tx WHERE {RECENT}), rci AS (SELECT * FROM ci WHERE {RECENT}),
    {_recent(STATS)}, {_recent(TRACES)},
    mev AS (SELECT address FROM bs WHERE {MEV} UNION SELECT address FROM tr),
    all_labels AS (SELECT 0 AS p, {named('mev_bot', 'mev_pattern_heuristic')}, NULL AS total_tx, NULL AS dex_tx,
        NULL AS dex_ratio, NULL AS total_eth, NULL AS tx_per_day FROM mev
        UNION ALL SELECT 2, {named('defi_farmer', 'dex_heavy_heuristic')}, calls, dex_calls, dex_share, NULL, NULL
        FROM (SELECT from_address AS address, count(*) AS calls,
            count(*) FILTER (CAST(substr(to_address, 2) AS INT) < 20) AS dex_calls,
            avg(CASE WHEN CAST(substr(to_address, 2) AS INT) < 20 THEN 1 ELSE 0 END) AS dex_share
            FROM rtx WHERE {EXCLUDED} GROUP BY 1) WHERE calls >= 15 AND dex_share >= 0.25
        UNION ALL SELECT 5, {named('hodler', 'whale_heuristic')}, total_tx, NULL, NULL, total_eth, tx_per_day
        FROM ss WHERE {WHALE})
    SELECT address, label, source, total_tx, dex_tx, {r('dex_ratio', 'dex_ratio')}, {r('total_eth', 'total_eth')},
    {r('tx_per_day', 'tx_per_day')} FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY p) AS rn
    FROM all_labels) WHERE rn = 1""",
    "tx ci",
)
def _(v: Views):
    dex = book("c")["dex"]
    frames = [
        labels.label_mev_bots_with_traces(
            labels.block_stats(v.tx, book("w")["dex"], PROTOCOLS, **WINDOW),
            spelled(v.source_traces), dex, min_calls=15, excluded=PROTOCOLS, **WINDOW, **LIMITS["mev_bot"],
        ),
        labels.label_dex_heavy_transactions(
            v.tx, book("w")["dex"], min_tx=15, min_share=0.25, excluded=PROTOCOLS, **WINDOW
        ),
        labels.label_top_whales(labels.sender_stats(v.tx, PROTOCOLS, **WINDOW), **LIMITS["hodler"]),
    ]
    return labels.resolve_labels(frames, PROTOCOLS)


@query(
    "w7_priority_resolution",
    "s AS (SELECT 'w' || user_id AS address, CASE event_type WHEN 'signup' THEN 'hodler' WHEN 'view' THEN 'custom' "
    "WHEN 'click' THEN 'retail_trader' WHEN 'purchase' THEN 'nft_trader' ELSE 'airdrop_hunter' END AS label, "
    "event_type AS source FROM ev WHERE value > 150) "
    "SELECT address, label, source FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY CASE label "
    + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LABEL_PRIORITY))
    + " ELSE 99 END, source) AS rn FROM s) WHERE rn = 1",
    "ev",
)
def _(v: Views):
    kind = F.col("event_type")
    label = (
        F.when(kind == "signup", "hodler")
        .when(kind == "view", "custom")
        .when(kind == "click", "retail_trader")
        .when(kind == "purchase", "nft_trader")
        .otherwise("airdrop_hunter")
    )
    claims = v.events.where(F.col("value") > 150).select(
        F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("address"), label.alias("label"), kind.alias("source")
    )
    return labels.resolve_labels([claims], [])


def raw_assertions(v: Views) -> DataFrame:
    """Every event as a label assertion about its user."""
    return v.events.select(
        F.concat(F.lit("W"), F.col("user_id").cast("string")).alias("address"),
        F.col("event_type").alias("label"),
        F.lit(None).cast("string").alias("source"),
        (F.col("value") / 100).alias("confidence"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("evidence"),
        F.col("ts").alias("asserted_at"),
    )


def assertions(v: Views) -> DataFrame:
    return labels.assert_labels(raw_assertions(v))


@query(
    "l10_latest_assertion",
    f"""SELECT 'w' || user_id AS address, event_type AS label, 'agent_verified' AS source,
    {r('least(value / 100, 1)', 'confidence')}, 'event ' || event_id AS evidence, ts AS asserted_at,
    'w' || user_id AS wallet_address FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY ts DESC, event_type DESC) AS rn FROM ev) WHERE rn = 1""",
    "ev",
)
def _(v: Views):
    return labels.latest_labels(assertions(v))


@query(
    "l11_cluster_label",
    f"""SELECT 'v' || vec_id AS address, 'hodler' AS label, 'agent_cluster_label' AS source, {r('0.8', 'confidence')},
    'centroid review' AS evidence, TIMESTAMP '2024-02-01' AS asserted_at, 'v' || vec_id AS wallet_address
    FROM points WHERE cluster = 3""",
    "points",
)
def _(v: Views):
    members = v.points.select(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias(KEY), "cluster")
    return labels.label_cluster(
        members, 3, label="hodler", confidence=0.8, asserted_at="2024-02-01 00:00:00", evidence="centroid review"
    )


@query(
    "l10_appended_assertions",
    f"""SELECT 'w' || user_id AS address, event_type AS label, 'agent_verified' AS source,
    {r('least(value / 100, 1)', 'confidence')}, 'event ' || event_id AS evidence, ts AS asserted_at,
    'w' || user_id AS wallet_address FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY ts DESC, event_type DESC) AS rn FROM ev
    WHERE event_type = 'purchase' OR user_id % 7 <> 3) WHERE rn = 1""",
    "ev",
)
def _(v: Views):
    path = scratch(v.spark, "assertions")
    early, late = raw_assertions(v), F.col("label") == "purchase"
    batches.append_labels(early.where(~late), path)
    accounts = v.events.where(F.col("user_id") % 7 == 3).select(F.concat(F.lit("w"), F.col("user_id").cast("string")))
    batches.remove(accounts, path, "address")
    # What is appended after a removal stays.
    batches.append_labels(early.where(late), path)
    return batches.read_labels(v.spark, path)


@query(
    "l11_appended_cluster_labels",
    f"""SELECT 'v' || vec_id AS address, CASE WHEN cluster = 4 OR vec_id % 10 = 0 THEN 'mev_bot' ELSE 'hodler' END AS label,
    'agent_cluster_label' AS source, {r("CASE WHEN cluster = 4 OR vec_id % 10 = 0 THEN 1 ELSE 0.8 END", 'confidence')},
    '' AS evidence, CASE WHEN cluster = 4 OR vec_id % 10 = 0 THEN TIMESTAMP '2024-02-02'
    ELSE TIMESTAMP '2024-02-01' END AS asserted_at, 'v' || vec_id AS wallet_address
    FROM points WHERE cluster IN (3, 4)""",
    "points",
)
def _(v: Views):
    path = scratch(v.spark, "assertions")
    members = v.points.select(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias(KEY), "cluster", "vec_id")
    batches.append_cluster_label(
        members, 3, path, label="hodler", confidence=0.8, asserted_at="2024-02-01 00:00:00"
    )
    # A tenth of the members were in cluster 4 by a later run.
    moved = members.withColumn("cluster", F.when(F.col("cluster").isin(3) & (F.col("vec_id") % 10 == 0), 4).otherwise(F.col("cluster")))
    batches.append_cluster_label(
        moved, 4, path, label="mev_bot", confidence=1.5, asserted_at="2024-02-02 00:00:00"
    )
    return batches.read_labels(v.spark, path)


@query(
    "l12_label_encoding",
    "SELECT c_custkey, c_mktsegment AS label, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS label_id "
    "FROM customer",
)
def _(v: Views):
    rows = v.table("customer").select("c_custkey", F.col("c_mktsegment").alias("label"))
    return labels.encode_labels(rows)


# ------------------------------------------------- label reports (2.4)


@query("a11_label_distribution", f"{BUILT} SELECT label, count(*) AS n FROM chosen GROUP BY 1", "tx ci active")
def _(v: Views):
    return clusters.distribution(built(v), "label")


@query("a11_source_distribution", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def _(v: Views):
    return clusters.distribution(v.table("documents"), "source")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_MEMBERS = """j AS (SELECT CAST(c_nationkey % 6 - 1 AS VARCHAR) AS cluster,
    CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE 'unlabeled' END AS label FROM customer)"""


def _crosstab(v: Views, margins: bool) -> DataFrame:
    customers = v.table("customer")
    members = customers.select(
        F.col("c_custkey").alias(KEY), (F.col("c_nationkey") % 6 - 1).alias("cluster")
    )
    known = customers.where(F.col("c_acctbal") > 5000).select(
        F.col("c_custkey").alias("address"), F.col("c_mktsegment").alias("label")
    )
    return clusters.label_crosstab(members, known, _SEGMENTS, margins=margins)


def _columns(names: list[str]) -> str:
    return ", ".join(f"count(*) FILTER (label = '{n}') AS \"{n}\"" for n in names)


@query("a9_cluster_label_crosstab", f"{_MEMBERS} SELECT cluster, {_columns([*_SEGMENTS, 'unlabeled'])} FROM j GROUP BY 1")
def _(v: Views):
    return _crosstab(v, False)


@query(
    "a9_crosstab_with_margins",
    f"""{_MEMBERS} SELECT cluster, {_columns([*_SEGMENTS, 'unlabeled'])}, count(*) AS "All" FROM j GROUP BY 1
    UNION ALL SELECT 'All', {_columns([*_SEGMENTS, 'unlabeled'])}, count(*) FROM j""",
)
def _(v: Views):
    return _crosstab(v, True)
