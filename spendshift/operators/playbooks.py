"""Matching candidates to playbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendshift.functions.classify import contains_any, has_owner
from spendshift.functions.money import is_quantity_driven
from spendshift.operators.evidence import CANDIDATE, first_inventory
from spendshift.sources.reference_tables import FALLBACK_CAP, FALLBACK_CATEGORY, FALLBACK_WORDING

SPEC_PATTERNS = ["metric_names", "audit_event_patterns", "low_utilization_metrics", "low_utilization_threshold"]


def metric_hits(series: DataFrame, specs: DataFrame) -> DataFrame:
    """Per candidate and playbook: is a watched metric present, is one at idle level."""
    crossed = series.join(specs.select("provider", F.col("seq").alias("spec_seq"), *SPEC_PATTERNS), "provider")
    idle = contains_any(F.col("metric_name"), F.col("low_utilization_metrics")) & (
        F.col("current_average") <= F.col("low_utilization_threshold").cast("decimal(20,6)")
    )
    return crossed.groupBy(*CANDIDATE, "spec_seq").agg(
        F.max(contains_any(F.col("metric_name"), F.col("metric_names"))).alias("metric_hit"),
        F.max(idle).alias("low_utilization"),
    )


def audit_hits(events: DataFrame, specs: DataFrame) -> DataFrame:
    """Per candidate and playbook: did an event of a watched name happen."""
    names = events.select(*CANDIDATE, "event_name").distinct()
    crossed = names.join(specs.select("provider", F.col("seq").alias("spec_seq"), *SPEC_PATTERNS), "provider")
    watched = contains_any(F.col("event_name"), F.col("audit_event_patterns"))
    return crossed.filter(watched).select(*CANDIDATE, "spec_seq").distinct().withColumn(
        "audit_hit", F.lit(True)
    )


def with_ownership(candidates: DataFrame, inventory: DataFrame) -> DataFrame:
    """Inventory type and tags of each candidate, and whether anyone owns it."""
    listed = first_inventory(candidates, inventory).select(
        *CANDIDATE, F.col("resource_type").alias("inventory_type"), F.col("tags").alias("inventory_tags"),
    )
    return candidates.join(listed, CANDIDATE, "left").withColumn(
        "has_owner", has_owner(F.col("tags"), F.col("inventory_tags"))
    )


def match_scores(
    candidates: DataFrame,
    specs: DataFrame,
    inventory: DataFrame,
    series: DataFrame,
    events: DataFrame,
) -> DataFrame:
    """Every playbook that applies to a candidate, with its specificity score."""
    named = specs.select(
        "provider", *[F.col(c).alias(f"spec_{c}") for c in specs.columns if c != "provider"]
    )
    pairs = (
        with_ownership(candidates, inventory)
        .join(named, "provider")
        .join(metric_hits(series, specs), [*CANDIDATE, "spec_seq"], "left")
        .join(audit_hits(events, specs), [*CANDIDATE, "spec_seq"], "left")
    )
    quantity_driven = is_quantity_driven(F.col("quantity_percent_change"))
    service = contains_any(F.col("service_name"), F.col("spec_service_patterns")) | contains_any(
        F.col("service_category"), F.col("spec_service_patterns")
    )
    sku = F.exists("sku_ids", lambda s: contains_any(s, F.col("spec_sku_patterns")))
    kind = contains_any(F.col("inventory_type"), F.col("spec_resource_type_patterns"))
    idle = F.coalesce("low_utilization", F.lit(False))

    def listed(column: str) -> Column:
        return F.size(f"spec_{column}") > 0

    # (asked for, satisfied, points)
    demands = [
        (listed("service_patterns"), service, 3),
        (listed("sku_patterns"), sku, 3),
        (listed("resource_type_patterns"), kind, 2),
        (F.col("spec_requires_new_spend"), F.col("is_new"), 1),
        (F.col("spec_requires_rate_change"), ~quantity_driven, 3),
        (
            F.col("spec_requires_quantity_growth") & ~F.col("spec_requires_rate_change"),
            quantity_driven,
            0,
        ),
        (F.col("spec_requires_missing_owner"), ~F.col("has_owner"), 2),
        (listed("low_utilization_metrics"), idle, 2),
    ]
    bonuses = [
        (listed("metric_names") & F.coalesce("metric_hit", F.lit(False)), 1),
        (listed("audit_event_patterns") & F.coalesce("audit_hit", F.lit(False)), 2),
    ]
    applies, score = F.lit(True), F.lit(0)
    for asked, satisfied, points in demands:
        applies = applies & (~asked | satisfied)
        score = score + F.when(asked & satisfied, points).otherwise(0)
    for hit, points in bonuses:
        score = score + F.when(hit, points).otherwise(0)
    return pairs.filter(applies).withColumn("score", score)


def best_playbooks(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Highest score, then lower priority number, then declaration order; else the fallback."""
    per = Window.partitionBy(*CANDIDATE).orderBy(
        F.col("score").desc(), "spec_priority", "spec_seq"
    )
    fields = [
        "category", "risk", "rule_type", "max_confidence", "root_cause", "recommendation",
        "metric_names", "audit_event_patterns",
    ]
    best = (
        scores.withColumn("__n", F.row_number().over(per))
        .filter("__n = 1")
        .select(*CANDIDATE, "score", *[F.col(f"spec_{name}").alias(name) for name in fields])
    )
    root_cause, recommendation = FALLBACK_WORDING
    fallback = {
        "category": F.lit(FALLBACK_CATEGORY), "risk": F.lit("low"), "rule_type": F.lit("cost_driver"),
        "max_confidence": F.lit(FALLBACK_CAP), "root_cause": F.lit(root_cause),
        "recommendation": F.lit(recommendation),
        "metric_names": F.array().cast("array<string>"),
        "audit_event_patterns": F.array().cast("array<string>"),
    }
    chosen = candidates.select(*CANDIDATE).join(best, CANDIDATE, "left")
    chosen = chosen.withColumn("is_fallback", F.col("category").isNull())
    for name, value in fallback.items():
        chosen = chosen.withColumn(name, F.coalesce(F.col(name), value))
    return chosen


def confidence(kinds: Column, untrusted: Column, is_new: Column, cap: Column) -> Column:
    """Base 0.30 plus weights of the evidence kinds present, clamped to [0.05, cap]."""
    score = F.lit("0.30").cast("decimal(4,2)")
    weights = {
        "usage": "0.10", "metric": "0.15", "audit": "0.20", "inventory": "0.10", "recommendation": "0.10",
        "freshness": "-0.10",
    }
    for kind, weight in weights.items():
        score = score + F.when(
            F.array_contains(kinds, kind), F.lit(weight).cast("decimal(4,2)")
        ).otherwise(F.lit("0").cast("decimal(4,2)"))
    zero = F.lit("0").cast("decimal(4,2)")
    score = score + F.when(is_new, F.lit("0.05").cast("decimal(4,2)")).otherwise(zero)
    score = score - F.when(untrusted, F.lit("0.05").cast("decimal(4,2)")).otherwise(zero)
    return F.greatest(F.lit("0.05").cast("decimal(4,2)"), F.least(score, cap.cast("decimal(4,2)")))
