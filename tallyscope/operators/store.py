"""Keyed tables: feature upserts and lookups, and texts that expire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.groups import best_row, drop_keys, keep_keys
from tallyscope.schemas import FEATURES, KEY


def upsert(existing: DataFrame, new: DataFrame, key: str = KEY, columns: list[str] | None = None) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with the same key."""
    columns = columns or [KEY, *FEATURES]
    fresh = new.select(*columns)
    return drop_keys(existing.select(*columns), fresh.select(key), key).unionByName(fresh)


def storable_features(df: DataFrame) -> DataFrame:
    """Checked feature rows: every column must exist; gaps become 0."""
    missing = sorted({KEY, *FEATURES} - set(df.columns))
    if missing:
        raise ValueError(f"feature columns missing: {missing}")
    filled = [
        F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in FEATURES
    ]
    return df.select(KEY, *filled)


def lookup(features: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Feature rows of the wanted accounts; unknown accounts are left out."""
    if accounts is None:
        return features
    return keep_keys(features, accounts, KEY)


# ------------------------------------------------------- texts with expiry


def text_entries(
    texts: DataFrame, *, created_at: str, hours: int = 24, default_cluster: int = -1
) -> DataFrame:
    """Rows for the text table: each text expires ``hours`` after its creation."""
    created = F.lit(created_at).cast("timestamp")
    cluster = F.col("cluster_id") if "cluster_id" in texts.columns else F.lit(None).cast("int")
    return texts.select(
        KEY,
        "narrative",
        F.coalesce(cluster, F.lit(default_cluster)).cast("int").alias("cluster_id"),
        created.alias("created_at"),
        (created + F.expr(f"INTERVAL {int(hours)} HOURS")).alias("expires_at"),
    )


def unexpired(entries: DataFrame, as_of: str) -> DataFrame:
    """Entries still valid at ``as_of``; also the purge of the expired ones."""
    return entries.where(F.col("expires_at") > F.lit(as_of).cast("timestamp"))


def current_texts(entries: DataFrame, as_of: str) -> DataFrame:
    """The newest valid text of each account."""
    return best_row(unexpired(entries, as_of), [KEY], F.struct("created_at", "narrative"))


def invalidate(entries: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Entries without those of the given accounts; without accounts, none."""
    if accounts is None:
        return entries.limit(0)
    return drop_keys(entries, accounts, KEY)
