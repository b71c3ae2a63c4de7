"""The whole investigation (C7): comparison, evidence, findings, validation, report tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendshift.operators import compare, coverage, evidence, filters, findings, playbooks
from spendshift.operators.compare import Thresholds
from spendshift.operators.rules import freshness_gaps, knowledge_provenance
from spendshift.periods import Period
from spendshift.schemas import PROVIDERS
from spendshift.session import prepare, settle, stored


@dataclass(frozen=True)
class Request:
    current: Period
    baseline: Period
    as_of: object  # a date: the day rule reviews are judged on
    providers: Sequence[str] = PROVIDERS
    accounts: Sequence[str] = ()
    thresholds: Thresholds = field(default_factory=Thresholds)
    candidate_ids: Sequence[str] = ()


@dataclass(frozen=True)
class Tables:
    """Input tables; metric points are one row per point (see ``metric_points_of``)."""

    costs: DataFrame
    inventory: DataFrame
    points: DataFrame
    audit: DataFrame
    recommendations: DataFrame
    provenance: DataFrame
    rules: DataFrame
    playbooks: DataFrame


def _as_of(request: Request) -> Column:
    return F.lit(request.as_of).cast("date")


def scoped_costs(request: Request, tables: Tables) -> DataFrame:
    return filters.scope(
        tables.costs,
        periods=[request.current, request.baseline],
        providers=request.providers,
        accounts=request.accounts,
    )


def gaps_of(request: Request, tables: Tables) -> DataFrame:
    """How far each provider's data falls short of the period end."""
    covered = coverage.provider_coverage(tables.provenance).select("provider", "data_through")
    asked = covered.withColumn("period_end", F.lit(request.current.end))
    return freshness_gaps(asked, tables.rules, _as_of(request))


def case_files(request: Request, tables: Tables, candidates: DataFrame) -> dict[str, DataFrame]:
    """Playbook scores, choices and evidence of already selected candidates."""
    series = stored(
        evidence.candidate_series(candidates, tables.points, request.current, request.baseline)
    )
    events = stored(
        evidence.leading_events(candidates, tables.audit, request.current)
    )
    scores = playbooks.match_scores(candidates, tables.playbooks, tables.inventory, series, events)
    chosen = stored(playbooks.best_playbooks(candidates, scores))
    specs = chosen.select(*evidence.CANDIDATE, "metric_names", "audit_event_patterns")
    place = candidates.select(*evidence.CANDIDATE, "kept_position")
    gaps = settle(gaps_of(request, tables))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(place, evidence.CANDIDATE)

    own_inventory = evidence.first_inventory(candidates, tables.inventory)
    own_advice = evidence.first_recommendations(candidates, tables.recommendations)
    rows = evidence.assemble(
        [
            evidence.cost_evidence(candidates),
            evidence.usage_evidence(candidates),
            evidence.inventory_evidence(placed(own_inventory)),
            evidence.metric_evidence(placed(evidence.chosen_metrics(series, specs))),
            evidence.audit_evidence(placed(evidence.chosen_events(events, specs))),
            evidence.recommendation_evidence(placed(own_advice)),
            evidence.freshness_evidence(candidates, gaps),
        ],
        tables.provenance,
    )
    return {"series": series, "events": events, "scores": scores, "chosen": chosen, "evidence": rows, "gaps": gaps}


def investigate(
    spark: SparkSession, request: Request, tables: Tables
) -> dict[str, DataFrame]:
    """All report tables. The few candidates, evidence rows and findings are checkpointed once."""
    prepare(spark)

    costs = scoped_costs(request, tables)
    changes = compare.compare_keys(costs, request.current, request.baseline)
    candidates = stored(
        compare.candidates(costs, request.current, request.baseline, request.thresholds, changes)
    )
    wanted = filters.only_candidates(candidates, request.candidate_ids)
    providers = settle(
        compare.provider_comparison(
            changes, candidates, request.current, request.baseline, request.thresholds
        )
    )
    overall = compare.overall_comparison(providers, request.thresholds.tolerance)
    files = case_files(request, tables, wanted)
    chosen, rows, gaps = files["chosen"], settle(files["evidence"]), files["gaps"]
    claimed = settle(
        findings.build_findings(wanted, chosen, rows, tables.rules, gaps, request.current, _as_of(request))
    )
    in_period = tables.costs.filter(
        F.col("usage_date").between(request.current.start, request.current.end)
        | F.col("usage_date").between(request.baseline.start, request.baseline.end)
    )
    available = settle(
        coverage.available_source_types(
            coverage.present_kinds(
                {
                    "cost": changes, "inventory": tables.inventory, "metrics": tables.points,
                    "audit": tables.audit, "recommendations": tables.recommendations,
                }
            )
        )
    )
    published, dropped, issues = findings.validate(
        claimed, findings.known_resources(in_period, tables.inventory), candidates, available
    )
    ranked = settle(findings.rank_findings(published))
    issues = settle(issues)
    reconciliation = findings.reconcile_findings(ranked, overall, request.thresholds.tolerance)
    support = findings.support_figures(ranked, issues)
    covered = coverage.provider_coverage(tables.provenance)
    citations = ranked.filter(F.col("rule_id").isNotNull()).select(
        "rule_id", "rule_reviewed_at", F.col("rule_is_stale").alias("is_stale")
    )
    return {
        "candidates": candidates,
        "providers": providers,
        "overall": overall,
        "daily_current": compare.daily_totals(costs, request.current),
        "daily_baseline": compare.daily_totals(costs, request.baseline),
        "plan": coverage.plan_rows(wanted, request.providers),
        "playbooks": chosen,
        "evidence": rows,
        "claimed": claimed,
        "findings": ranked,
        "dropped": dropped,
        "issues": issues,
        "reconciliation": reconciliation,
        "support": support,
        "header": findings.report_header(ranked, reconciliation, support),
        "statuses": coverage.provider_statuses(ranked, covered, request.providers),
        "freshness": gaps,
        "warnings": report_warnings(gaps, available, reconciliation),
        "knowledge": knowledge_provenance(citations),
    }


def report_warnings(gaps: DataFrame, available: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """Report-level warnings: short data, missing cause sources, unattributed change."""
    late = F.when(
        F.col("beyond_expected"),
        F.concat(F.lit(" (about "), F.format_number("expected_delay_hours", 0), F.lit("h is usual)")),
    ).otherwise(F.lit(""))
    short = gaps.filter("is_incomplete").select(
        "provider",
        F.concat(
            F.col("provider"), F.lit(" data is complete only through "),
            F.date_format("data_through", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(", "),
            F.col("gap_hours").cast("string"), F.lit("h before the period ends"), late,
            F.lit("; the missing days are unavailable data, not zero usage"),
        ).alias("warning"),
    )
    missing = findings.missing_cause_sources(F.col("source_types"))
    silent = available.withColumn("__missing", missing).filter(F.size("__missing") > 0).select(
        "provider",
        F.concat(
            F.lit("no "), F.array_join("__missing", ", "),
            F.lit(" data was supplied, so a change can be measured but its cause cannot be confirmed"),
        ).alias("warning"),
    )
    unattributed = reconciliation.filter(~F.col("within_tolerance")).select(
        F.lit(None).cast("string").alias("provider"),
        F.concat(
            F.format_number("unattributed_change", 2), F.lit(" of the change is not attributed to a finding")
        ).alias("warning"),
    )
    return short.unionByName(silent).unionByName(unattributed)
