"""Exact money arithmetic: decimals inside, half-even rounding at fixed places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendshift.schemas import MONEY, TOTAL

DAYS_PER_MONTH = "30.4"
QUANTITY_GROWTH_PERCENT = 10


def total(column: Column) -> Column:
    """Sum of a money column, zero for an empty group."""
    return F.coalesce(F.sum(column), F.lit(0)).cast(TOTAL)


def rounded(column: Column, places: int) -> Column:
    return F.bround(column, places)


def percent_change(current: Column, expected: Column) -> Column:
    """Change in percent at three decimals; null when nothing was expected."""
    change = (current - expected) * F.lit(100) / expected
    return F.when(expected > 0, rounded(change, 3))


def unit_cost(cost: Column, quantity: Column) -> Column:
    """Cost per unit at eight decimals; null without a positive quantity."""
    return F.when(quantity > 0, rounded(cost / quantity, 8))


def is_quantity_driven(quantity_percent_change: Column) -> Column:
    return F.coalesce(quantity_percent_change >= QUANTITY_GROWTH_PERCENT, F.lit(True))


def net_of_credits(cost: Column, credits: Column) -> Column:
    """Effective cost of a line whose credits are booked as negative amounts."""
    return rounded(cost + credits, 6).cast(MONEY)


def daily_delta(change: Column, days: int) -> Column:
    return rounded(change / F.lit(max(days, 1)), 4)


def monthly_impact(change: Column, days: int) -> Column:
    per_month = change * F.lit(DAYS_PER_MONTH).cast("decimal(3,1)") / F.lit(max(days, 1))
    return rounded(per_month, 2)
