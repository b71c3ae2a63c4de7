"""Findings, their validation, ranking and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendshift.functions.money import is_quantity_driven, monthly_impact, rounded
from spendshift.functions.text import fill_template
from spendshift.operators.compare import reconcile
from spendshift.operators.evidence import CANDIDATE
from spendshift.operators.playbooks import confidence
from spendshift.operators.rules import select_rules
from spendshift.periods import Period
from spendshift.schemas import TOTAL
from spendshift.session import settle
from spendshift.sources.reference_tables import FALLBACK_CATEGORY

# Kinds that corroborate a high confidence, and kinds that can show a cause.
CORROBORATING = ["metric", "audit", "recommendation"]
CAUSE_SOURCES = ["metric", "audit", "inventory", "recommendation"]

UNSUPPORTED_ADVICE = (
    "Review the resource or service by hand, or supply metrics, audit events, inventory or "
    "recommendations for the same period: a cost export shows the change but not its cause."
)
CLAIM_CAP = 0.8


def _cap(column: Column, value: str) -> Column:
    return F.least(column, F.lit(value).cast("decimal(6,3)"))


def _spike_text() -> Column:
    return F.coalesce(F.col("first_spike_date").cast("string"), F.lit("the start of the period"))


def _placeholders() -> dict[str, Column]:
    key = F.col("key")
    return {
        "key": key,
        "resource": F.coalesce("resource_name", "resource_id", "key"),
        "resource_id": F.coalesce(F.col("resource_id"), key),
        "service": F.coalesce("service_name", F.lit("the service")),
        "region": F.coalesce("region_id", F.lit("an unknown region")),
        "spike_date": _spike_text(),
        "increase": F.concat(F.format_number("absolute_change", 2), F.lit(" "), F.col("currency")),
        "provider": F.upper("provider"),
    }


def evidence_summary(evidence: DataFrame, *extra: str) -> DataFrame:
    return evidence.groupBy(*CANDIDATE, *extra).agg(
        F.array_sort(F.collect_set("source_type")).alias("kinds"),
        F.max("contains_untrusted_text").alias("untrusted"),
        F.count(F.lit(1)).alias("evidence_count"),
        F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"),
        F.array_sort(
            F.collect_list(F.when(F.coalesce("query_reference", F.lit("")) == "", F.col("evidence_id")))
        ).alias("untraceable"),
    )


def rule_questions(candidates: DataFrame, current: Period) -> DataFrame:
    """The rule question of each candidate: its category on the day it first spiked."""
    return candidates.withColumn("service", F.col("service_name")).withColumn(
        "usage_date", F.coalesce("first_spike_date", F.lit(current.end))
    )


def build_findings(
    candidates: DataFrame,
    chosen: DataFrame,
    evidence: DataFrame,
    rules: DataFrame,
    gaps: DataFrame,
    current: Period,
    as_of: Column,
) -> DataFrame:
    """One finding per candidate: playbook, rule citation, confidence with its caps, texts."""
    incomplete = gaps.select("provider", F.col("is_incomplete").alias("incomplete"))
    asked = rule_questions(candidates.join(chosen, CANDIDATE), current)
    answered = select_rules(asked, rules, as_of)
    joined = (
        answered.join(evidence_summary(evidence), CANDIDATE, "left")
        .join(F.broadcast(incomplete), "provider", "left")
        .withColumn("incomplete", F.coalesce("incomplete", F.lit(False)))
        .withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
        .withColumn("untrusted", F.coalesce("untrusted", F.lit(False)))
        .withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
    )
    return finish_findings(joined, current)


def finish_findings(joined: DataFrame, current: Period) -> DataFrame:
    """Score, cap and word candidates that carry a playbook, a rule answer and evidence."""
    score = confidence(F.col("kinds"), F.col("untrusted"), F.col("is_new"), F.col("max_confidence"))
    score = score.cast("decimal(6,3)")
    weak_rule = F.coalesce("is_stale", F.lit(False)) | F.col("is_undated")
    flat_usage = ~is_quantity_driven(F.col("quantity_percent_change")) & (
        F.col("category") != "pricing_change"
    )
    capped = F.when(~F.col("found"), _cap(score, "0.45")).when(weak_rule, _cap(score, "0.6")).otherwise(score)
    capped = F.when(flat_usage, _cap(capped, "0.7")).otherwise(capped)
    warnings = F.concat(
        "rule_warnings",
        F.array_compact(
            F.array(
                F.when(~F.col("found"), "no dated billing rule applies, so the reading is provisional"),
                F.when(flat_usage, "usage did not grow with cost; a rate or discount change may be part of it"),
                F.when(F.col("incomplete"), "provider data for the end of the period is incomplete"),
            )
        ),
    )
    change = F.col("absolute_change")
    listed = F.when(
        F.col("resource_id").isNotNull(), F.array("resource_id")
    ).otherwise(F.array().cast("array<string>"))
    # Several claims may be made on one candidate.
    ties = ["claim_id"] if "claim_id" in joined.columns else []
    per = Window.partitionBy("provider").orderBy("kept_position", *ties)
    count = F.row_number().over(per).cast("string")
    number = F.when(F.length(count) < 2, F.lpad(count, 2, "0")).otherwise(count)
    texts = _placeholders()
    return joined.select(
        F.concat(F.upper("provider"), F.lit("-F"), number).alias("finding_id"),
        "provider",
        "candidate_id",
        "kept_position",
        "category",
        fill_template(F.col("root_cause"), texts).alias("suspected_root_cause"),
        fill_template(F.col("recommendation"), texts).alias("recommendation"),
        listed.alias("affected_resources"),
        "service_name",
        "region_id",
        "currency",
        capped.alias("confidence"),
        rounded(change, 2).cast(TOTAL).alias("actual_cost_increase"),
        monthly_impact(change, current.days).alias("estimated_monthly_impact"),
        "risk",
        (F.col("is_fallback") | ~F.col("found") | weak_rule | F.col("incomplete")).alias("is_uncertain"),
        F.lit(True).alias("requires_human_approval"),
        warnings.alias("warnings"),
        "kinds",
        "untrusted",
        "evidence_count",
        "evidence_ids",
        "untraceable",
        F.when(F.col("found"), F.col("rule_id")).alias("rule_id"),
        F.coalesce("is_stale", F.lit(False)).alias("rule_is_stale"),
        "rule_valid_from",
        "rule_reviewed_at",
        "rule_source_url",
        F.col("usage_date").alias("rule_selected_for"),
    )


# ------------------------------------------------------------------ recording chosen evidence


def refused_claims(claims: DataFrame, evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """Claims that cite nothing, cite unknown evidence, or name an unknown candidate."""
    cited = claims.select("claim_id", "provider", F.explode("evidence_ids").alias("evidence_id"))
    unknown = (
        cited.join(evidence.select("provider", "evidence_id"), ["provider", "evidence_id"], "left_anti")
        .groupBy("claim_id")
        .agg(F.array_sort(F.collect_set("evidence_id")).alias("unknown_ids"))
    )
    known = candidates.select(*CANDIDATE).withColumn("__known", F.lit(True))
    judged = claims.join(unknown, "claim_id", "left").join(known, CANDIDATE, "left")
    reason = (
        F.when(F.col("__known").isNull(), "unknown_candidate")
        .when(F.col("unknown_ids").isNotNull(), "unknown_evidence")
        .when(F.size("evidence_ids") == 0, "no_evidence")
    )
    return judged.withColumn("reason", reason).filter("reason is not null").select(
        "claim_id", "provider", "candidate_id", "reason",
        F.coalesce("unknown_ids", F.array().cast("array<string>")).alias("unknown_ids"),
    )


def record_claims(
    claims: DataFrame,
    candidates: DataFrame,
    chosen: DataFrame,
    evidence: DataFrame,
    rules: DataFrame,
    gaps: DataFrame,
    current: Period,
    as_of: Column,
) -> DataFrame:
    """Findings from accepted claims; a category of the claimant's own is capped lower."""
    refused = refused_claims(claims, evidence, candidates).select("claim_id")
    accepted = claims.join(refused, "claim_id", "left_anti")
    named = accepted.select(
        "claim_id", *CANDIDATE, F.nullif("category", F.lit("")).alias("own_category"),
        F.nullif(F.trim("suspected_root_cause"), F.lit("")).alias("own_cause"),
        F.nullif(F.trim("recommendation"), F.lit("")).alias("own_advice"), F.col("risk").alias("own_risk"),
        "evidence_ids",
    )
    own = F.coalesce(F.col("own_category") != F.col("category"), F.lit(False))
    merged = (
        candidates.join(chosen, CANDIDATE)
        .join(named.drop("evidence_ids"), CANDIDATE)
        .withColumn("__own", own)
        .withColumn("max_confidence", F.when(F.col("__own"), F.least("max_confidence", F.lit(CLAIM_CAP)))
                    .otherwise(F.col("max_confidence")))
        .withColumn("risk", F.when(F.col("__own"), F.col("own_risk")).otherwise(F.col("risk")))
        .withColumn("category", F.when(F.col("__own"), F.col("own_category")).otherwise(F.col("category")))
        .withColumn("is_fallback", F.col("is_fallback") & ~F.col("__own"))
        .withColumn("root_cause", F.coalesce("own_cause", "root_cause"))
        .withColumn("recommendation", F.coalesce("own_advice", "recommendation"))
    )
    cited = named.select("claim_id", *CANDIDATE, F.explode("evidence_ids").alias("evidence_id"))
    pool = evidence.drop("candidate_id")
    summary = evidence_summary(cited.join(pool, ["provider", "evidence_id"]), "claim_id")
    incomplete = gaps.select("provider", F.col("is_incomplete").alias("incomplete"))
    answered = select_rules(rule_questions(merged, current), rules, as_of)
    joined = answered.join(summary, [*CANDIDATE, "claim_id"]).join(F.broadcast(incomplete), "provider", "left").withColumn(
        "incomplete", F.coalesce("incomplete", F.lit(False))
    )
    return finish_findings(joined, current)


# ------------------------------------------------------------------ validation


def known_resources(costs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Resource ids seen in cost rows or inventory, per provider (not yet distinct)."""
    ids = costs.filter(F.coalesce("resource_id", F.lit("")) != "").select("provider", "resource_id")
    return ids.unionByName(inventory.select("provider", "resource_id"))


def unknown_resources(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Listed resources not known to the provider; a provider without known ids is not checked."""
    listed = findings.select("finding_id", "provider", F.explode("affected_resources").alias("resource_id"))
    wanted = listed.select("provider", "resource_id").distinct().withColumn("__wanted", F.lit(True))
    # One pass over the known ids: per provider those that are wanted, and a null for all others.
    seen = known.join(wanted, ["provider", "resource_id"], "left").select(
        "provider", F.when(F.col("__wanted"), F.col("resource_id")).alias("resource_id")
    )
    seen = settle(seen.distinct())
    present = seen.filter(F.col("resource_id").isNotNull())
    checked = seen.select("provider").distinct()
    return (
        listed.join(checked, "provider", "left_semi")
        .filter(~F.startswith(F.col("resource_id"), F.concat(F.col("provider"), F.lit(":"))))
        .join(present, ["provider", "resource_id"], "left_anti")
    )


def missing_cause_sources(available: Column) -> Column:
    """All four cause sources when none of them is available; else an empty list."""
    four = F.array(*[F.lit(name) for name in CAUSE_SOURCES])
    none = F.array().cast("array<string>")
    return F.when(F.arrays_overlap(available, four), none).otherwise(four)


def _issue(findings: DataFrame, order: int, when: Column, code: str, severity: str, detail: Column) -> DataFrame:
    return findings.filter(when).select(
        "finding_id", "provider", F.lit(order).alias("check"), F.lit(code).alias("code"),
        F.lit(severity).alias("severity"), detail.alias("detail"),
    )


def validate(
    findings: DataFrame,
    known: DataFrame | None = None,
    candidates: DataFrame | None = None,
    available: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run the nine checks; returns (published, dropped, issues).

    ``available`` has one row per provider with the list ``source_types``.
    """
    work = findings
    # Check 3 needs the unknown resources, check 4 the measured change, check 9 the sources.
    if known is not None:
        bad = unknown_resources(findings, known).groupBy("finding_id").agg(
            F.array_sort(F.collect_set("resource_id")).alias("unknown_ids")
        )
        work = work.join(bad, "finding_id", "left")
    else:
        work = work.withColumn("unknown_ids", F.lit(None).cast("array<string>"))
    if candidates is not None:
        measured = candidates.select(
            "candidate_id", F.col("absolute_change").alias("measured"), F.lit(True).alias("is_known")
        )
        work = work.join(measured, "candidate_id", "left")
    else:
        work = work.withColumn("measured", F.lit(None).cast(TOTAL)).withColumn(
            "is_known", F.lit(None).cast("boolean")
        )
    if available is not None:
        absent = available.select("provider", missing_cause_sources(F.col("source_types")).alias("missing"))
        work = work.join(F.broadcast(absent), "provider", "left")
    else:
        work = work.withColumn("missing", F.lit(None).cast("array<string>"))
    work = work.withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))

    work = settle(work)

    has_unknown = F.coalesce(F.size("unknown_ids") > 0, F.lit(False))
    no_evidence = F.col("evidence_count") == 0
    untraceable = F.coalesce(F.size("untraceable") > 0, F.lit(False))
    drift = F.abs(F.col("actual_cost_increase") - F.col("measured"))
    one = F.lit(1).cast(TOTAL)
    allowed = F.greatest(
        F.greatest(F.abs("measured"), one) * F.lit("0.01").cast("decimal(3,2)"),
        F.lit("0.02").cast("decimal(3,2)"),
    )
    drifted = F.coalesce(drift > allowed, F.lit(False))
    not_compared = F.col("is_known").isNull() & (F.coalesce("candidate_id", F.lit("")) != "")
    no_rule = F.col("rule_id").isNull()
    stale = ~no_rule & F.col("rule_is_stale")
    undated = ~no_rule & F.col("rule_valid_from").isNull()
    retroactive = ~no_rule & F.coalesce(F.col("rule_selected_for") < F.col("rule_valid_from"), F.lit(False))
    no_source = ~no_rule & (F.coalesce("rule_source_url", F.lit("")) == "")

    work = work.withColumn(
        "affected_resources",
        F.when(has_unknown, F.array_except("affected_resources", "unknown_ids")).otherwise(
            F.col("affected_resources")
        ),
    )
    before = F.col("confidence")
    capped = F.when(has_unknown, _cap(before, "0.4")).otherwise(before)
    capped = F.when(no_rule, _cap(capped, "0.45")).otherwise(capped)
    capped = F.when(stale | undated, _cap(capped, "0.6")).otherwise(capped)
    work = work.withColumn("capped", capped)
    corroborated = F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in CORROBORATING]))
    thin = (F.col("capped") >= F.lit("0.8").cast("decimal(3,2)")) & (
        (F.col("evidence_count") < 3) | ~corroborated
    )
    no_cause = F.size("missing") > 0
    renamed = no_cause & (F.col("category") != FALLBACK_CATEGORY)
    missing_text = F.array_join("missing", ", ")
    target = F.coalesce(
        F.try_element_at("affected_resources", F.lit(1)), F.nullif("service_name", F.lit("")), F.col("category")
    )

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    rule_id = F.col("rule_id")
    checks = [
        (1, no_evidence, "missing_evidence", "error", text("the finding carries no evidence")),
        (2, ~no_evidence & untraceable, "evidence_without_provenance", "warning",
         text("evidence without a query reference: ", F.array_join("untraceable", ", "))),
        (3, has_unknown, "unsupported_resource_id", "error",
         text("resources not in the provider's data: ", F.array_join("unknown_ids", ", "))),
        (4, drifted, "cost_attribution_mismatch", "error",
         text("claimed ", F.format_number("actual_cost_increase", 2), " but measured ",
              F.format_number("measured", 2), "; the measured value is published")),
        (4, not_compared, "unknown_candidate", "warning",
         text("candidate ", F.col("candidate_id"), " is not in the comparison")),
        (5, no_rule, "missing_rule_citation", "warning", text("no dated billing rule is cited")),
        (5, stale, "stale_billing_knowledge", "warning",
         text("rule ", rule_id, " was last reviewed ", F.coalesce(F.col("rule_reviewed_at").cast("string"), F.lit("never")))),
        (5, undated, "rule_missing_effective_date", "warning", text("rule ", rule_id, " has no effective date")),
        (5, retroactive, "rule_applied_retroactively", "error",
         text("rule ", rule_id, " starts after the day it was selected for")),
        (5, no_source, "rule_without_source", "error", text("rule ", rule_id, " has no source url")),
        (6, thin, "insufficient_corroboration", "warning",
         text("high confidence needs metric, audit or recommendation evidence")),
        (7, F.col("untrusted"), "untrusted_text_in_evidence", "info",
         text("evidence quotes provider-controlled text, scrubbed and treated as data")),
        (9, renamed, "cause_unsupported_by_available_sources", "warning",
         text("category ", F.col("category"), " names a cause, but no ", missing_text, " data was supplied")),
    ]
    issues = [_issue(work, order, when, code, severity, detail) for order, when, code, severity, detail in checks]
    order = F.struct("provider", (-F.col("actual_cost_increase")).alias("impact"), "kept_position")
    listed = work.select(
        "finding_id", "provider", order.alias("seq"), F.explode("affected_resources").alias("resource_id")
    )
    issues.append(
        _issue(duplicate_claims(listed), 8, F.lit(True), "duplicate_resource_attribution", "info",
               text("resource ", F.col("resource_id"), " is also attributed to ", F.col("claimed_by")))
    )
    final = F.when(thin, _cap(F.col("capped"), "0.7")).otherwise(F.col("capped"))
    final = F.when(no_cause, _cap(final, "0.4")).otherwise(final)
    note = text("no ", missing_text, " data was supplied for ", target, ", so the cause is unconfirmed")
    done = (
        work.withColumn("final_confidence", final)
        .withColumn(
            "final_uncertain",
            F.col("is_uncertain") | has_unknown | drifted | no_rule | stale | undated | no_cause,
        )
        .withColumn("final_increase", F.when(drifted, rounded(F.col("measured"), 2).cast(TOTAL))
                    .otherwise(F.col("actual_cost_increase")))
        .withColumn("final_cause", F.when(renamed, text(
            target, " costs clearly more, but the supplied data cannot show why; the increase is "
            "measured, its mechanism is not")).otherwise(F.col("suspected_root_cause")))
        .withColumn("final_advice", F.when(renamed, F.lit(UNSUPPORTED_ADVICE)).otherwise(F.col("recommendation")))
        .withColumn("final_category", F.when(renamed, F.lit(FALLBACK_CATEGORY)).otherwise(F.col("category")))
        .withColumn("final_warnings", F.when(no_cause, F.concat("warnings", F.array(note))).otherwise(F.col("warnings")))
        .withColumn("is_dropped", no_evidence | retroactive)
    )
    replaced = {
        "confidence": "final_confidence", "is_uncertain": "final_uncertain",
        "actual_cost_increase": "final_increase", "suspected_root_cause": "final_cause",
        "recommendation": "final_advice", "category": "final_category", "warnings": "final_warnings",
    }
    columns = [F.col(replaced.get(name, name)).alias(name) for name in findings.columns]
    published = done.filter(~F.col("is_dropped")).select(*columns)
    dropped = done.filter("is_dropped").select(*columns)
    return published, dropped, reduce(DataFrame.unionByName, issues)


def duplicate_claims(listed: DataFrame) -> DataFrame:
    """Rows (finding_id, provider, seq, resource_id) whose resource an earlier finding claimed."""
    first = listed.groupBy("resource_id").agg(F.min(F.struct("seq", "finding_id")).alias("__first"))
    return (
        listed.join(first, "resource_id")
        .filter(F.col("__first.finding_id") != F.col("finding_id"))
        .select("finding_id", "provider", "resource_id", F.col("__first.finding_id").alias("claimed_by"))
    )


# ------------------------------------------------------------------ ranking and reporting


def ranking() -> list[Column]:
    """Certain findings first, then by impact, then by confidence."""
    return [
        F.col("is_uncertain"), F.col("actual_cost_increase").desc(), F.col("confidence").desc(),
        F.col("provider"), F.col("kept_position"),
    ]


def rank_findings(findings: DataFrame) -> DataFrame:
    """Number the findings of one investigation (few rows by construction)."""
    order = Window.partitionBy(F.lit(1)).orderBy(*ranking())
    return findings.withColumn("rank", F.row_number().over(order))


def worker_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("provider", F.col("actual_cost_increase").desc(), "kept_position")


def headline(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*ranking()).limit(1)


def reconcile_findings(findings: DataFrame, overall: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Published increases against the measured change of the whole comparison."""
    attributed = findings.agg(
        F.coalesce(F.sum("actual_cost_increase"), F.lit(0)).cast(TOTAL).alias("attributed_change")
    )
    measured = overall.select("total_absolute_change", "total_percent_change")
    return reconcile(measured.crossJoin(attributed), tolerance, "total_absolute_change")


def support_figures(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """Share of findings with evidence and a rule, and the number of error issues."""
    supported = F.when((F.col("evidence_count") > 0) & F.col("rule_id").isNotNull(), 1).otherwise(0)
    ratio = findings.agg(
        F.coalesce(F.bround(F.avg(supported.cast("decimal(10,8)")), 4), F.lit(1)).cast("double")
        .alias("supported_claim_ratio"),
        F.count(F.lit(1)).alias("finding_count"),
    )
    errors = issues.agg(F.count(F.when(F.col("severity") == "error", 1)).alias("unsupported_claims"))
    return ratio.crossJoin(errors)


def report_header(ranked: DataFrame, reconciliation: DataFrame, support: DataFrame) -> DataFrame:
    """One row: measured change, share explained, and the three leading causes."""
    top = ranked.filter(F.col("rank") <= 3).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "provider", "category"))),
            lambda r: F.concat_ws(" ", r["provider"], r["category"]),
        ).alias("top_causes")
    )
    share = F.when(
        F.col("total_absolute_change") != 0,
        F.bround(F.col("attributed_change") * 100 / F.col("total_absolute_change"), 0),
    ).otherwise(F.lit(0))
    return reconciliation.crossJoin(support).crossJoin(top).withColumn(
        "explained_percent", share.cast("double")
    )


def first_citations(citations: DataFrame) -> DataFrame:
    """One citation per provider and rule, the first by order."""
    per = Window.partitionBy("provider", "rule_id").orderBy("seq")
    return citations.withColumn("__n", F.row_number().over(per)).filter("__n = 1").drop("__n")


def distinct_sources(sources: DataFrame) -> DataFrame:
    """One source per (provider, source, data_through), the first by order."""
    key = ["provider", "source", "data_through"]
    others = [name for name in sources.columns if name not in (*key, "seq")]
    first = sources.groupBy(*key).agg(F.min(F.struct("seq", *others)).alias("__first"))
    return first.select(*key, *[F.col(f"__first.`{name}`").alias(name) for name in ("seq", *others)]).select(*sources.columns)
