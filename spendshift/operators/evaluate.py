"""Scoring findings against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_K = 3


def first_matches(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """Best rank of a finding with the expected provider, category and (if named) resource."""
    named = expected.select(
        "scenario_id", "provider", "category", F.col("resource_id").alias("wanted_resource")
    )
    hits = findings.join(named, ["scenario_id", "provider", "category"]).filter(
        F.col("wanted_resource").isNull() | F.array_contains("affected_resources", F.col("wanted_resource"))
    )
    return hits.groupBy("scenario_id").agg(F.min("rank").alias("rank"))


def _failure(when: Column, text: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(text))


def score_scenarios(expected: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per scenario with its failures.

    ``findings`` are ranked and carry kinds and rule ids; ``runs`` has per scenario the
    warnings, the error-issue count and whether the money reconciled.
    """
    per_run = findings.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.avg(F.when((F.col("evidence_count") > 0) & F.col("rule_id").isNotNull(), 1.0).otherwise(0.0)).alias("support"),
        F.collect_set(F.when(F.col("rank") <= TOP_K, F.col("category"))).alias("top_categories"),
    )
    matched = first_matches(findings, expected)
    own = findings.select(
        "scenario_id", "rank", "actual_cost_increase", "confidence", "evidence_count", "kinds", "rule_id",
        F.col("risk").alias("found_risk"), "requires_human_approval",
    )
    joined = (
        expected.join(runs, "scenario_id", "left")
        .join(per_run, "scenario_id", "left")
        .join(matched, "scenario_id", "left")
        .join(own, ["scenario_id", "rank"], "left")
    )
    wants = F.col("expect_findings")
    found = wants & F.col("rank").isNotNull()
    cost = F.coalesce(F.col("cost_increase"), F.col("actual_cost_increase").cast("double"))
    error = F.abs(F.col("actual_cost_increase").cast("double") - cost)
    missing_kinds = F.size(F.array_except("required_evidence_sources", "kinds")) > 0
    missing_rules = F.size("required_rule_ids") > 0
    missing_rules = missing_rules & ~F.coalesce(F.array_contains("required_rule_ids", F.col("rule_id")), F.lit(False))
    said = F.transform("warnings", lambda w: F.lower(w))
    unsaid = F.exists(
        "expect_warnings_containing", lambda p: ~F.exists(said, lambda w: F.contains(w, F.lower(p)))
    )
    failures = F.array_compact(
        F.array(
            _failure(unsaid, "expected warning missing"),
            _failure(F.arrays_overlap("forbidden_categories", "top_categories"), "forbidden category in the top"),
            _failure(F.col("error_issues") > 0, "validation errors"),
            _failure(~wants & (F.coalesce("finding_count", F.lit(0)) > 0), "findings where none were expected"),
            _failure(wants & F.col("rank").isNull(), "expected cause not found"),
            _failure(found & (F.col("rank") > TOP_K), "expected cause ranked too low"),
            _failure(
                found & (error > F.greatest(F.coalesce("cost_tolerance", F.lit(0.02)) * F.abs(cost), F.lit(0.01))),
                "cost differs",
            ),
            _failure(found & (F.col("confidence").cast("double") < F.coalesce("min_confidence", F.lit(0.0))), "confidence too low"),
            _failure(found & (F.col("confidence").cast("double") > F.col("max_confidence")), "confidence too high"),
            _failure(found & (F.col("evidence_count") < F.coalesce("min_evidence", F.lit(1))), "too little evidence"),
            _failure(found & missing_kinds, "evidence sources missing"),
            _failure(found & missing_rules, "rule citations missing"),
            _failure(found & (F.col("expect_risk") != F.col("found_risk")), "risk differs"),
            _failure(found & ~F.col("requires_human_approval"), "no human approval required"),
            _failure(
                found & F.col("expect_reconciled") & ~F.coalesce("within_tolerance", F.lit(False)),
                "money does not reconcile",
            ),
        )
    )
    return joined.select(
        "scenario_id",
        F.when(found, F.col("rank")).alias("rank"),
        F.when(found, F.bround(error, 4)).alias("cost_error"),
        F.coalesce(F.bround(F.col("support"), 4), F.lit(1.0)).alias("supported_claim_ratio"),
        F.coalesce("error_issues", F.lit(0)).alias("unsupported_claims"),
        failures.alias("failures"),
        (F.size(failures) == 0).alias("passed"),
    )


def evaluation_summary(scored: DataFrame) -> DataFrame:
    """Totals over the scored scenarios; rates over the scenarios they apply to."""

    def rate(value: Column) -> Column:
        return F.bround(F.avg(value.cast("decimal(18,8)")), 4).cast("double")

    ranked = F.when(F.col("rank").isNotNull(), F.when(F.col("rank") <= TOP_K, 1).otherwise(0))
    close = F.when(F.col("cost_error").isNotNull(), F.when(F.col("cost_error") <= 0.02, 1).otherwise(0))
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("passed"), 1)).alias("passed"),
        F.coalesce(rate(ranked), F.lit(1.0)).alias("top_k_rate"),
        F.coalesce(rate(close), F.lit(1.0)).alias("attribution_accuracy"),
        F.coalesce(rate(F.col("supported_claim_ratio")), F.lit(1.0)).alias("supported_claim_ratio"),
        F.coalesce(rate(F.col("unsupported_claims")), F.lit(0.0)).alias("unsupported_claim_rate"),
    )
