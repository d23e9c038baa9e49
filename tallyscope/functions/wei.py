"""Exact sums of amounts in wei.

An amount is a ``decimal(38,0)``, so a sum of many needs more digits than one decimal
has. A row's amount is cut into parts of nine digits, whose sums are plain long sums
in the first, large aggregate (``part_sums``). The next aggregate joins them to two
limbs, whole units of 10**18 wei and wei below (``join_parts``), later ones add up
limbs (``add_limbs``), and the carry is settled at the end. A settled pair has its low
limb in 0 .. 10**18 - 1, so comparing pairs compares amounts.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 10**18
DIGITS = 9
PARTS = 5  # of a decimal with 38 digits

_WHOLE = "DECIMAL(38,0)"
_UNIT = f"CAST('{UNIT}' AS DECIMAL(19,0))"


def wei(df: DataFrame) -> Column:
    """The amount of a row: ``value`` in wei, or ``value_eth`` of an extract, which has whole units."""
    if "value" in df.columns:
        return F.col("value").cast("decimal(38,0)")
    # A double has no more than 18 digits behind the point, which the product keeps.
    return (F.col("value_eth").cast("decimal(38,18)") * F.lit(UNIT).cast("decimal(19,0)")).cast("decimal(38,0)")


def with_parts(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add the parts of each row's amount, lowest first, and give their names; all NULL without an amount."""
    names = [f"_part{k}" for k in range(PARTS)]
    # Through text: dividing decimals of 38 digits costs many times as much.
    # The sign goes there too, as the absolute value of a decimal is rounded to 34 digits.
    padded = F.lpad(F.translate(F.col("_wei").cast("string"), "-", ""), DIGITS * PARTS, "0")
    sign = F.when(F.col("_wei") < 0, F.lit(-1)).otherwise(F.lit(1))
    rows = df.withColumn("_wei", wei(df)).withColumns({"_text": padded, "_sign": sign})
    cut = {n: F.substring("_text", DIGITS * (PARTS - 1 - k) + 1, DIGITS).cast("int") * F.col("_sign") for k, n in enumerate(names)}
    return rows.withColumns(cut).drop("_text", "_sign", "_wei"), names


def part_sums(parts: list[str], name: str, where: Column | None = None) -> list[Column]:
    """Aggregates of the parts of rows ``where`` it holds, for groups of up to 9 * 10**9 rows."""
    chosen = [F.col(p) if where is None else F.when(where, F.col(p)) for p in parts]
    return [F.sum(c.cast("bigint")).alias(f"{name}_{k}") for k, c in enumerate(chosen)]


def join_parts(name: str) -> list[Column]:
    """Aggregates that add up part sums of an earlier aggregate as two limbs; NULL without amounts."""
    part = [f"CAST({name}_{k} AS {_WHOLE})" for k in range(PARTS)]
    low = f"CAST({part[0]} + {part[1]} * 1000000000 AS {_WHOLE})"
    high = f"CAST({part[2]} + {part[3]} * 1000000000 + {part[4]} * {_UNIT} AS {_WHOLE})"
    return [F.expr(f"CAST(sum({limb}) AS {_WHOLE})").alias(f"{name}_{end}") for limb, end in ((high, "high"), (low, "low"))]


def add_limbs(name: str) -> list[Column]:
    """Aggregates that add up the limbs of an earlier aggregate."""
    return [F.sum(f"{name}_{end}").cast("decimal(38,0)").alias(f"{name}_{end}") for end in ("high", "low")]


def total(*names: str) -> Column:
    """The settled sum of the limb columns of these names; NULL limbs count as zero."""
    high, low = (
        f"CAST({' + '.join(f'coalesce({n}_{end}, CAST(0 AS {_WHOLE}))' for n in names)} AS {_WHOLE})" for end in ("high", "low")
    )
    rest = f"pmod({low}, {_UNIT})"
    carry = f"CAST(({low} - {rest}) / {_UNIT} AS {_WHOLE})"
    return F.expr(f"struct(CAST({high} + {carry} AS {_WHOLE}) AS high, CAST({rest} AS DECIMAL(18,0)) AS low)")


def in_units(pair: str) -> Column:
    """A column with a settled pair in units of 10**18 wei, as a double."""
    return F.expr(f"CAST({pair}.high AS DOUBLE) + CAST({pair}.low AS DOUBLE) / 1e18D")


def units(amount: Column) -> Column:
    """A single amount in units of 10**18 wei, as a double."""
    return amount.cast("double") / F.lit(float(UNIT))


def pair_of(number: float | int | str) -> Column:
    """A number of units as a settled pair, for comparisons."""
    high, low = divmod(int(Decimal(str(number)).scaleb(18).to_integral_value()), UNIT)
    return F.struct(F.lit(Decimal(high)).cast("decimal(38,0)").alias("high"), F.lit(Decimal(low)).cast("decimal(18,0)").alias("low"))
