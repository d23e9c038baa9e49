"""Scalar column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS_PATTERN = "^0x[a-fA-F0-9]{40}$"

# Keywords that give a contract name its category, first match wins.
NAME_CATEGORIES = [
    ("dex", ["swap", "router", "pair", "pool", "amm", "dex"]),
    ("lending", ["lend", "borrow", "aave", "compound", "morpho", "comet"]),
    ("nft_marketplace", ["nft", "erc721", "seaport", "blur", "opensea"]),
    ("bridge", ["bridge", "gateway", "inbox", "l1", "l2"]),
    ("staking", ["stake", "staking", "lido", "reth", "sfrx"]),
    ("yield", ["vault", "strategy", "yearn", "harvest", "yield"]),
    ("token", ["erc20", "token"]),
    ("proxy", ["proxy", "upgradeable", "transparent"]),
]


def wei_to_eth(wei: Column) -> Column:
    return wei.cast("double") / F.lit(1e18)


def method_id(call_input: Column) -> Column:
    """The first ten characters of a call's input."""
    return F.substring(call_input, 1, 10)


def valid_address(address: Column) -> Column:
    return address.rlike(ADDRESS_PATTERN)


def in_window(ts: Column, as_of: str, days: int) -> Column:
    """Whether ``ts`` lies in the ``days`` days before ``as_of`` or later.

    The bound is a literal, so it reaches the scan as a pushed filter.
    """
    return ts >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")


def listed(value: Column, values: Sequence) -> Column:
    """``value``, which must be one of ``values``: a pivot would drop any other."""
    message = F.concat(F.lit("not among the listed values: "), F.coalesce(value.cast("string"), F.lit("NULL")))
    return F.when(value.isin(list(values)), value).otherwise(F.raise_error(message))


def number_or(value: Column, default: float = 0.0) -> Column:
    """``value`` as a double, ``default`` where it is missing or no number."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def category_from_name(name: Column) -> Column:
    text = F.lower(name)
    result = None
    for category, words in NAME_CATEGORIES:
        hit = text.rlike("|".join(words))
        result = F.when(hit, category) if result is None else result.when(hit, category)
    return result.otherwise("other")


def ratio_band(ratio: Column) -> Column:
    """How far a cluster mean stands from the global mean."""
    return (
        F.when(ratio > 2.0, "HIGH")
        .when(ratio > 1.3, "high")
        .when(ratio < 0.3, "LOW")
        .when(ratio < 0.7, "low")
        .otherwise("")
    )


def ratio_direction(ratio: Column) -> Column:
    return F.when(ratio > 1.3, "HIGH").when(ratio < 0.7, "LOW").otherwise("~avg")


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def share_where(condition: Column) -> Column:
    """Share of the group's rows that meet the condition."""
    return count_where(condition) / F.count(F.lit(1))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equally long double arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )
