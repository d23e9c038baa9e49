"""Distribution measures from group counts.

All take the counts ``c`` of the categories of a group and need only sums, so a
plain two-level aggregate computes them without a window over the group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy_from_sums(total: Column, c_log_c: Column, log_total: Column) -> Column:
    """``log N - sum(c log c) / N``; rounding noise below zero becomes zero."""
    return F.greatest(log_total - c_log_c / total, F.lit(0.0))


def concentration(count: Column) -> Column:
    """Herfindahl index: sum of squared shares."""
    c = count.cast("double")
    return F.try_divide(F.sum(c * c), F.sum(c) * F.sum(c))
