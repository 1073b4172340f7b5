"""Exact ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: str, whole: str) -> Column:
    """SQL expression ``part`` as a percentage of ``whole``: exact, half away from zero, two decimals.

    Doubles misround halves (23 of 160 is 14.375 and must give 14.38), so the division is
    done in decimals. A zero whole gives NULL instead of an error.
    """
    ratio = f"CAST({part} AS decimal(20,0)) / nullif(CAST({whole} AS decimal(20,0)), 0)"
    return F.expr(f"CAST(round({ratio} * 100, 2) AS decimal(20,2))")


def count_where(condition: str, weight: str = "1L") -> Column:
    """Sum of ``weight`` over the rows that meet the condition, 0 when none does."""
    return F.expr(f"sum(if({condition}, {weight}, 0L))")
