"""The behavioural features: each of the twelve, both definitions, and their scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators import features, staging
from tallyscope.plans.catalogue import query, r
from tallyscope.plans.ledger_queries import RHYTHM, STAGE_CI, STAGE_TX, WINDOW
from tallyscope.schemas import FEATURES, KEY
from tallyscope.session import settle
from tallyscope.sources.views import Views, book

PARTS = {
    "f1": "tx_frequency_per_day",
    "f2": "activity_regularity",
    "f3": "hour_of_day_entropy",
    "f4": "weekend_vs_weekday_ratio",
    "f5": "avg_holding_duration_estimate",
    "f6": "gas_price_sensitivity",
    "f7": "is_contract",
    "f8": "dex_to_total_ratio",
    "f9": "lending_to_total_ratio",
    "f10": "counterparty_concentration",
    "f11": "value_velocity",
    "f12": "burst_score",
}

# One check per feature over the exploded ledger; each gives (wallet_address, x).
FEATURE_SQL = {
    "f1": """SELECT wallet_address, CASE WHEN max(block_timestamp) = min(block_timestamp) THEN count(*)
        ELSE count(*) / ((epoch_us(max(block_timestamp)) - epoch_us(min(block_timestamp))) / 86400e6) END AS x
        FROM led GROUP BY 1""",
    "f2": """SELECT wallet_address, coalesce(stddev_samp(n), 0) AS x FROM (
        SELECT wallet_address, CAST(block_timestamp AS DATE) AS d, count(*) AS n FROM led GROUP BY 1, 2) GROUP BY 1""",
    "f3": """SELECT wallet_address, -sum(p * log2(p)) AS x FROM (
        SELECT wallet_address, n / sum(n) OVER (PARTITION BY wallet_address) AS p FROM (
        SELECT wallet_address, hour(block_timestamp) AS h, count(*) AS n FROM led GROUP BY 1, 2)) GROUP BY 1""",
    "f4": """SELECT wallet_address, CASE WHEN wd = 0 THEN we ELSE we / wd END AS x FROM (
        SELECT wallet_address, count(*) FILTER (isodow(block_timestamp) >= 6) AS we,
        count(*) FILTER (isodow(block_timestamp) < 6) AS wd FROM led GROUP BY 1)""",
    "f5": """SELECT wallet_address, coalesce(avg(CASE WHEN inward AND NOT nxt
        THEN (epoch_us(nts) - epoch_us(block_timestamp)) / 3.6e9 END), 0) AS x FROM (
        SELECT wallet_address, block_timestamp, inward, lead(inward) OVER w AS nxt, lead(block_timestamp) OVER w AS nts
        FROM (SELECT *, to_address = wallet_address AS inward FROM led_tt)
        WINDOW w AS (PARTITION BY wallet_address, token_address
            ORDER BY block_timestamp, transaction_hash, inward DESC)) GROUP BY 1""",
    "f6": """SELECT wallet_address, CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(corr(n, g), 0) END AS x FROM (
        SELECT wallet_address, CAST(block_timestamp AS DATE) AS d, count(*) AS n, avg(gas_price) AS g
        FROM led GROUP BY 1, 2) GROUP BY 1""",
    "f7": """SELECT wallet_address, CAST(CAST(bool_or(length(method_id) > 2) AS INT) AS DOUBLE) AS x
        FROM led GROUP BY 1""",
    "f8": """SELECT wallet_address, avg(CASE WHEN k < 20 THEN 1 ELSE 0 END) AS x FROM led_ci GROUP BY 1""",
    "f9": """SELECT wallet_address, avg(CASE WHEN k >= 20 AND k < 30 THEN 1 ELSE 0 END) AS x
        FROM led_ci GROUP BY 1""",
    "f10": """SELECT wallet_address, sum(p * p) AS x FROM (
        SELECT wallet_address, n / sum(n) OVER (PARTITION BY wallet_address) AS p FROM (
        SELECT wallet_address, to_address, count(*) AS n FROM led GROUP BY 1, 2)) GROUP BY 1""",
    "f11": """SELECT wallet_address, CASE WHEN max(abs(run)) = 0 THEN 0
        ELSE CASE WHEN sum(sent) = 0 THEN sum(value_eth) ELSE sum(sent) END / max(abs(run)) END AS x FROM (
        SELECT wallet_address, value_eth, CASE WHEN from_address = wallet_address THEN value_eth ELSE 0 END AS sent,
        sum(CASE WHEN from_address = wallet_address THEN -value_eth ELSE value_eth END) OVER (
            PARTITION BY wallet_address ORDER BY block_timestamp, hash
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM led) GROUP BY 1""",
    "f12": """SELECT wallet_address, max(n) / avg(n) AS x FROM (
        SELECT wallet_address, date_trunc('hour', block_timestamp) AS h, count(*) AS n FROM led GROUP BY 1, 2)
        GROUP BY 1""",
}


def parts(v: Views, name: str) -> DataFrame:
    if name == "f5":
        return features.holding_duration(v.led_tt)
    if name in ("f8", "f9"):
        return features.protocol_ratios(v.led_ci, book("c")["dex"], book("c")["lending"])
    if name == "f10":
        return features.counterparty_concentration(v.led)
    if name == "f11":
        return features.value_velocity(v.led)
    return features.rhythm_features(v.led)


def _register(short: str, column: str) -> None:
    views = {"f5": "led_tt", "f8": "led_ci", "f9": "led_ci"}.get(short, "led")
    check = f"SELECT wallet_address, {r('x', column)} FROM ({FEATURE_SQL[short]})"

    @query(f"{short}_{column}_py", check, views)
    def _(v: Views):
        return parts(v, short).select(KEY, column)


for _short, _column in PARTS.items():
    _register(_short, _column)


# ------------------------------------------------- the mart's definitions

SQL_VARIANTS = {
    "f1": ("stx", "tx_count / nullif(days_since_first_tx, 0)"),
    "f2": ("stx", "active_days / nullif(days_since_first_tx, 0)"),
    "f3": ("he", "hour_of_day_entropy"),
    "f4": ("wk", "we / nullif(wd, 0)"),
    "f8": ("sci", "dex_interaction_count / nullif(contract_call_count, 0)"),
    "f9": ("sci", "lending_interaction_count / nullif(contract_call_count, 0)"),
    "f10": ("hhi", "counterparty_concentration"),
    "f11": ("stx", "(total_value_sent_eth + total_value_received_eth) / nullif(active_days, 0)"),
    "f12": ("bu", "burst_score"),
}


def _window_part(v: Views, short: str) -> DataFrame:
    if short in ("f1", "f2", "f11"):
        return staging.window_pace(staging.stage_transactions(v.source_transactions, **WINDOW))
    if short in ("f8", "f9"):
        return staging.call_shares(staging.stage_contract_calls(v.source_traces, **WINDOW, book=book("c")))
    if short == "f10":
        return staging.sent_concentration(v.source_transactions, **WINDOW)
    return staging.window_rhythm(v.source_transactions, **WINDOW)


def _register_window(short: str) -> None:
    source, expression = SQL_VARIANTS[short]
    column = PARTS[short]
    calls = source == "sci"
    start = STAGE_CI if calls else f"{STAGE_TX}, {RHYTHM}"
    check = f"{start} SELECT wallet_address, {r(expression, column)} FROM {source}"

    @query(f"{short}_{column}_sql", check, "ci" if calls else "src_tx")
    def _(v: Views):
        return _window_part(v, short).select(KEY, column)


for _short in SQL_VARIANTS:
    _register_window(_short)


@query(
    "f7_is_contract_sql",
    """SELECT wallet_address, c.address IS NOT NULL AS is_contract
    FROM active LEFT JOIN contracts c ON c.address = wallet_address""",
    "active contracts",
)
def _(v: Views):
    return staging.holds_code(v.active, v.contracts)


# --------------------------------------------------------- whole matrix

_NAMED = ", ".join(f"{s}x AS ({FEATURE_SQL[s]})" for s in FEATURE_SQL)
MATRIX = f"""{_NAMED}, feats AS (SELECT f1x.wallet_address, {', '.join(
    f'coalesce({s}x.x, 0) AS {c}' for s, c in PARTS.items())}
    FROM f1x {' '.join(f'LEFT JOIN {s}x ON {s}x.wallet_address = f1x.wallet_address' for s in PARTS if s != 'f1')})"""
MATRIX_VIEWS = "led led_tt led_ci"


def matrix(v: Views) -> DataFrame:
    """All features of the views; the flagship query."""
    return features.all_features(v.led, v.led_tt, v.led_ci, book("c")["dex"], book("c")["lending"])


@query("f13_all_features", f"{MATRIX} SELECT wallet_address, {', '.join(r(c, c) for c in FEATURES)} FROM feats", MATRIX_VIEWS)
def _(v: Views):
    return matrix(v)




@query(
    "f14_imputed",
    f"""g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders),
    m AS (SELECT median(o_totalprice) AS p, median(CAST(o_custkey AS DOUBLE)) AS c FROM g),
    s AS (SELECT o_orderstatus AS s FROM g WHERE o_orderstatus IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, o_orderstatus LIMIT 1)
    SELECT o_orderkey, {r('coalesce(o_totalprice, p)', 'o_totalprice')}, {r('coalesce(o_custkey, c)', 'o_custkey')},
    coalesce(o_orderstatus, s) AS o_orderstatus FROM g, m, s""",
)
def _(v: Views):
    key = F.col("o_orderkey")
    gaps = v.table("orders").select(
        "o_orderkey",
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 5 != 0, F.col("o_custkey")).cast("double").alias("o_custkey"),
        F.when(key % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    return features.impute(gaps, ["o_totalprice", "o_custkey"], ["o_orderstatus"])


@query(
    "f15_normalised",
    f"""{MATRIX} SELECT wallet_address, {', '.join(
        r(f'CASE WHEN stddev_samp({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () '
          f'ELSE 0 END', c) for c in FEATURES)} FROM feats""",
    MATRIX_VIEWS,
)
def _(v: Views):
    return features.standardise(settle(matrix(v)), FEATURES)




@query(
    "x7_min_max",
    f"""SELECT c_custkey, {r('(c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ())',
                             'c_acctbal')}, {r('0', 'constant')} FROM customer""",
)
def _(v: Views):
    rows = v.table("customer").select("c_custkey", "c_acctbal", F.lit(5.0).alias("constant"))
    return features.min_max(rows, ["c_acctbal", "constant"])


@query(
    "x7_min_max_features",
    f"""{MATRIX} SELECT wallet_address, {', '.join(
        r(f'CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / '
          f'(max({c}) OVER () - min({c}) OVER ()) ELSE 0 END', c) for c in FEATURES)} FROM feats""",
    MATRIX_VIEWS,
)
def _(v: Views):
    return features.min_max(settle(matrix(v)), FEATURES)


@query(
    "a8_feature_store_statistics",
    f"{MATRIX} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {r(f'min({c})', 'min')}, {r(f'max({c})', 'max')}, {r(f'avg({c})', 'mean')},
        {r(f'stddev_pop({c})', 'std')} FROM feats""" for c in FEATURES
    ),
    MATRIX_VIEWS,
)
def _(v: Views):
    return features.feature_stats(matrix(v), FEATURES)
