"""The list of registered queries and the shared parts of their check SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.session import checkpoint_root
from tallyscope.sources.views import RANGES, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

DIGITS = 6


def present(df: DataFrame) -> DataFrame:
    """Doubles rounded and instants without zone, so that engines compare equal."""
    shown = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # Adding zero turns -0.0 into 0.0.
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        shown.append(c.alias(f.name))
    return df.select(*shown)


def query(name: str, check: str | None = None, views: str = ""):
    """Register a query; ``check`` is its SQL over the named ``views``."""

    def add(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: present(build(Views(spark, folder)))
        if check is not None:
            CHECKS[name] = with_views(views, check)
        return build

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint location for a written table."""
    return f"{checkpoint_root(spark)}/tables/{name}-{uuid.uuid4().hex}"


# ----------------------------------------------------------- check views

_CATEGORY = "CASE " + " ".join(
    f"WHEN k >= {low} AND k < {high} THEN '{name}'" for name, (low, high) in RANGES.items()
) + " END"

VIEWS = {
    "ev": (
        "",
        "SELECT event_id, ts, user_id, event_type, value, "
        "CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    ),
    "tx": (
        "ev",
        """SELECT 'e' || event_id AS hash, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS block_number,
        ts AS block_timestamp, 'w' || user_id AS from_address, 'w' || k AS to_address, value AS value_eth,
        CAST(21000 AS DOUBLE) AS gas, CAST(20 + event_id % 81 AS DOUBLE) AS gas_price,
        CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS receipt_status,
        CASE WHEN event_type IN ('view', 'click') THEN '0x' ELSE '0xabcdef12' END AS method_id, event_id
        FROM ev""",
    ),
    "ci": (
        "ev",
        """SELECT 'e' || event_id AS transaction_hash, ts AS block_timestamp, 'w' || user_id AS from_address,
        'c' || k AS to_address, 'call' AS trace_type,
        CASE WHEN event_type = 'signup' THEN 'delegatecall' ELSE 'call' END AS call_type, value AS value_eth,
        CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS status, k, event_id FROM ev""",
    ),
    "tt": (
        "ev",
        """SELECT 'e' || event_id AS transaction_hash, ts AS block_timestamp,
        CASE WHEN event_type IN ('signup', 'view') THEN 'x' || k ELSE 'w' || user_id END AS from_address,
        CASE WHEN event_type IN ('signup', 'view') THEN 'w' || user_id ELSE 'x' || k END AS to_address,
        't' || (k % 10) AS token_address, value AS raw_value, k % 10 < 7 AS is_erc20, k % 10 >= 7 AS is_erc721,
        event_id FROM ev""",
    ),
    "src_tx": (
        "tx",
        "SELECT *, CAST(round(value_eth * 100) AS HUGEINT) * 10000000000000000 AS wei FROM tx",
    ),
    "src_tt": (
        "tt",
        """SELECT *, CASE WHEN event_id % 10 = 5 THEN NULL ELSE CAST(floor(raw_value) AS BIGINT) % 4 END AS amount
        FROM tt""",
    ),
    "nums": ("ev", "SELECT DISTINCT k FROM ev WHERE k IS NOT NULL"),
    "contracts": (
        "nums",
        """SELECT p || k AS address, k % 3 = 0 AS is_erc20, k % 3 = 1 AS is_erc721
        FROM nums, (VALUES ('c'), ('t'), ('w')) v(p)
        WHERE p = 'c' OR (p = 't' AND k < 8) OR (p = 'w' AND k % 10 = 0)""",
    ),
    "registry": (
        "nums",
        f"""SELECT 'c' || k AS address, 'Protocol ' || k || ' v' || CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS label,
        {_CATEGORY} AS category, k FROM nums WHERE k < 60""",
    ),
    "active": ("ev", "SELECT DISTINCT 'w' || user_id AS wallet_address FROM ev"),
    "led": (
        "tx active",
        """SELECT s.* FROM (SELECT from_address AS wallet_address, * FROM tx
        UNION ALL SELECT to_address AS wallet_address, * FROM tx) s JOIN active USING (wallet_address)""",
    ),
    "led_tt": (
        "tt active",
        """SELECT DISTINCT s.* FROM (SELECT from_address AS wallet_address, * FROM tt
        UNION ALL SELECT to_address AS wallet_address, * FROM tt) s JOIN active USING (wallet_address)""",
    ),
    "led_ci": (
        "ci active",
        """SELECT DISTINCT s.* FROM (SELECT from_address AS wallet_address, * FROM ci
        UNION ALL SELECT to_address AS wallet_address, * FROM ci) s JOIN active USING (wallet_address)""",
    ),
    "points": (
        "",
        """SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster
        FROM embeddings""",
    ),
    # One row per vector and dimension.
    "dims": (
        "points",
        "SELECT vec_id, cluster, unnest(vector) AS x, unnest(range(len(vector))) AS d FROM points",
    ),
    "wanted": ("", "SELECT 'w' || s_suppkey AS wallet_address FROM supplier WHERE s_acctbal > 5000"),
}


def with_views(names: str, body: str) -> str:
    """``body`` after the definitions of the named views and what they need.

    A body that does not start with SELECT goes on with further definitions.
    """
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0].split():
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        need(name)
    body = body.strip()
    if not ordered:
        return body if body.upper().startswith(("SELECT", "WITH")) else f"WITH {body}"
    text = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    glue = "\n" if body.upper().startswith("SELECT") else ",\n"
    return f"WITH {text}{glue}{body}"


def r(expression: str, name: str) -> str:
    """A rounded output column of a check."""
    return f"round(CAST({expression} AS DOUBLE), {DIGITS}) + 0.0 AS {name}"
