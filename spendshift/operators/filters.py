"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendshift.periods import Period, in_any

DEFAULT_CHARGES = ("usage", "purchase", "adjustment")


def scope(
    costs: DataFrame,
    *,
    periods: Sequence[Period] = (),
    providers: Sequence[str] = (),
    accounts: Sequence[str] = (),
    charges: Sequence[str] = DEFAULT_CHARGES,
) -> DataFrame:
    """Rows in the investigated scope; an empty list puts no restriction."""
    if periods:
        costs = costs.filter(in_any(list(periods), F.col("usage_date")))
    if providers:
        costs = costs.filter(F.col("provider").isin(list(providers)))
    named_accounts = [account for account in accounts if account]
    if named_accounts:
        costs = costs.filter(F.col("billing_account_id").isin(named_accounts))
    if charges:
        costs = costs.filter(F.col("charge_category").isin(list(charges)))
    return costs


def with_window(costs: DataFrame, current: Period, baseline: Period) -> DataFrame:
    """Keep rows of either period, labelled; a day in both counts as current."""
    day = F.col("usage_date")
    label = F.when(current.contains(day), "current").when(baseline.contains(day), "baseline")
    return costs.filter(in_any([current, baseline], day)).withColumn("window", label)


def is_material(min_change: float = 5.0, min_percent: float = 20.0) -> Column:
    """An increase large enough in money and, unless new, in percent."""
    percent = F.col("percent_change")
    return (F.col("absolute_change") >= F.lit(str(min_change)).cast("decimal(18,6)")) & (
        F.col("is_new") | percent.isNull() | (percent >= F.lit(str(min_percent)).cast("decimal(18,6)"))
    )


def inventory_matching(
    inventory: DataFrame, resource_id: str | None = None, resource_type: str | None = None, limit: int = 100
) -> DataFrame:
    """Inventory by exact id and by type substring, first rows by source order."""
    if resource_id:
        inventory = inventory.filter(F.col("resource_id") == resource_id)
    if resource_type:
        inventory = inventory.filter(
            F.contains(F.lower("resource_type"), F.lit(resource_type.lower()))
        )
    return inventory.orderBy("seq", "provider", "resource_id").limit(limit)


def audit_in_window(
    audit: DataFrame, period: Period, resource_id: str | None = None, limit: int = 100
) -> DataFrame:
    """Audit events of a period, optionally touching one resource."""
    events = audit.filter(period.contains(F.to_date("event_time")))
    if resource_id:
        events = events.filter(F.array_contains("resource_ids", resource_id))
    return events.orderBy("seq", "provider", "event_id").limit(limit)


def metrics_for(metrics: DataFrame, resource_ids: Sequence[str]) -> DataFrame:
    return metrics.filter(F.col("resource_id").isin(list(resource_ids)))


def only_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in the key table."""
    return rows.join(keys.select(*on), list(on), "left_semi")


def only_candidates(candidates: DataFrame, candidate_ids: Sequence[str]) -> DataFrame:
    """Allowlist of candidate ids; an empty list allows all."""
    wanted = [value for value in candidate_ids if value]
    return candidates.filter(F.col("candidate_id").isin(wanted)) if wanted else candidates
