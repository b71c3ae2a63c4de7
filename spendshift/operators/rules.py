"""Date-aware billing rule selection.

The rules of one (provider, rule type) are gathered into one array and joined to the
questions; scoring, fallback and the choice by date are array expressions on the row,
so any number of questions is answered without shuffling them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendshift.functions.parsing import end_of_day

REVIEW_MAX_AGE_DAYS = 180
DEFAULT_DELAY_HOURS = 48.0


def effective_on(valid_from: Column, valid_to: Column, day: Column) -> Column:
    """An undated rule is never effective."""
    return F.coalesce((valid_from <= day) & (valid_to.isNull() | (day <= valid_to)), F.lit(False))


def is_stale(reviewed_at: Column, as_of: Column, max_age: int = REVIEW_MAX_AGE_DAYS) -> Column:
    return F.coalesce(F.datediff(as_of, reviewed_at) > max_age, F.lit(True))


def _score(rule: Column, service: Column, category: Column) -> Column:
    """3 for the category, 2 for the service name, 1 for a service pattern or a generic answer."""
    has_category = F.coalesce(category, F.lit("")) != ""
    has_service = F.coalesce(service, F.lit("")) != ""
    lowered = F.lower(service)

    def overlaps(pattern: Column) -> Column:
        other = F.lower(pattern)
        return F.contains(lowered, other) | F.contains(other, lowered)

    exact = F.coalesce(F.lower(rule["service"]) == lowered, F.lit(False))
    return (
        F.when(has_category & F.array_contains(rule["matches_categories"], category), 3)
        .when(has_service & exact, 2)
        .when(has_service & F.exists(rule["matches_services"], overlaps), 1)
        .when(has_service | has_category, 0)
        .when(_is_generic(rule), 1)
        .otherwise(0)
    )


def _is_generic(rule: Column) -> Column:
    return (F.size(rule["matches_services"]) == 0) & (F.size(rule["matches_categories"]) == 0)


def rule_lists(rules: DataFrame) -> DataFrame:
    """One row per (provider, rule type) with its rules in load order."""
    fields = [name for name in rules.columns if name not in ("provider", "rule_type", "seq")]
    entry = F.struct(F.col("seq"), *[F.col(name) for name in fields])
    return rules.groupBy("provider", "rule_type").agg(
        F.array_sort(F.collect_list(entry)).alias("rules")
    )


def _latest(rules: Column) -> Column:
    """Rule with the greatest valid_from, nulls lowest, ties to load order."""
    keyed = F.transform(
        rules,
        lambda r: F.struct(
            F.coalesce(r["valid_from"], F.lit("0001-01-01").cast("date")).alias("start"),
            (-r["seq"]).alias("order"),
            r.alias("rule"),
        ),
    )
    return F.array_max(keyed)["rule"]


def _nearest(rules: Column) -> Column:
    keyed = F.transform(
        rules,
        lambda r: F.struct(
            F.coalesce(r["valid_from"], F.lit("9999-12-31").cast("date")).alias("start"),
            r["seq"].alias("order"),
            r.alias("rule"),
        ),
    )
    return F.array_min(keyed)["rule"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _choice(rules: Column, service: Column, category: Column, day: Column) -> Column:
    """The chosen rule and how it was found, as one struct."""

    def with_scores(scored: Column) -> Column:
        best = F.coalesce(F.array_max(F.transform(scored, lambda s: s["score"])), F.lit(0))
        return _let(best, lambda top: _let(pool_of(scored, top), lambda pool: answer(pool, top)))

    def pool_of(scored: Column, top: Column) -> Column:
        kept = F.filter(
            scored,
            lambda s: F.when(top > 0, s["score"] == top).otherwise(_is_generic(s["rule"])),
        )
        return F.transform(kept, lambda s: s["rule"])

    def answer(pool: Column, top: Column) -> Column:
        split = F.struct(
            F.filter(pool, lambda r: effective_on(r["valid_from"], r["valid_to"], day)).alias("effective"),
            F.filter(pool, lambda r: r["valid_from"].isNull()).alias("undated"),
        )

        def pick(parts: Column) -> Column:
            rule = (
                F.when(F.size(pool) == 0, None)
                .when(day.isNull(), _latest(pool))
                .when(F.size(parts["effective"]) > 0, _latest(parts["effective"]))
                .when(F.size(parts["undated"]) > 0, F.element_at(parts["undated"], 1))
            )
            return F.struct(
                rule.alias("rule"),
                (F.size(pool) > 0).alias("has_pool"),
                ((top == 0) & (F.size(pool) > 0)).alias("used_generic"),
                (day.isNotNull() & (F.size(parts["effective"]) == 0)).alias("not_effective"),
                F.when(F.size(pool) > 0, _nearest(pool)["id"]).alias("nearest_id"),
            )

        return _let(split, pick)

    scored = F.transform(
        rules, lambda r: F.struct(_score(r, service, category).alias("score"), r.alias("rule"))
    )
    return _let(scored, with_scores)


def select_rules(
    questions: DataFrame, rules: DataFrame, as_of: Column, max_age: int = REVIEW_MAX_AGE_DAYS
) -> DataFrame:
    """Answer every question row (provider, rule_type, service, category, usage_date)."""
    asked = questions.join(rule_lists(rules), ["provider", "rule_type"], "left")
    none = F.filter("rules", lambda r: F.lit(False))
    choice = _choice(
        F.coalesce(F.col("rules"), none), F.col("service"), F.col("category"), F.col("usage_date")
    )
    picked = (
        asked.withColumn("__choice", choice)
        .withColumn("__rule", F.col("__choice.rule"))
        .withColumn("__has_pool", F.coalesce("__choice.has_pool", F.lit(False)))
        .withColumn("found", F.col("__rule.id").isNotNull())
        .withColumn("used_generic", F.coalesce("__choice.used_generic", F.lit(False)))
        .withColumn("is_stale", F.when(F.col("found"), is_stale(F.col("__rule.reviewed_at"), as_of, max_age)))
        .withColumn("is_undated", F.col("found") & F.col("__choice.not_effective"))
        .withColumn("nearest_rule_id", F.when(~F.col("found"), F.col("__choice.nearest_id")))
    )
    return _with_answer(picked, max_age)


def _with_answer(picked: DataFrame, max_age: int) -> DataFrame:
    rule = F.col("__rule")
    what = F.concat_ws(
        " ", F.col("rule_type"), F.lit("rule for"), F.col("provider"),
        F.concat(F.lit("service="), F.coalesce("service", F.lit("-"))),
        F.concat(F.lit("category="), F.coalesce("category", F.lit("-"))),
    )
    no_rule = ~F.col("__has_pool")
    warnings = F.array_compact(
        F.array(
            F.when(no_rule, F.concat(F.lit("there is no "), what)),
            F.when(
                F.col("used_generic"),
                F.concat(F.lit("there is no specific "), what, F.lit("; the generic rule is used")),
            ),
            F.when(
                F.col("is_undated"),
                F.concat(F.lit("rule "), rule["id"], F.lit(" has no effective date, so confidence is limited")),
            ),
            F.when(
                ~no_rule & ~F.col("found"),
                F.concat(
                    F.lit("no rule is effective on "), F.col("usage_date").cast("string"),
                    F.lit("; the nearest one, "), F.col("nearest_rule_id"),
                    F.lit(", is not applied retroactively"),
                ),
            ),
            F.when(
                F.col("is_stale"),
                F.concat(F.lit("the review of rule "), rule["id"], F.lit(f" is older than {max_age} days")),
            ),
            F.when(
                rule["confidence"] == "deprecated", F.concat(F.lit("rule "), rule["id"], F.lit(" is deprecated"))
            ),
        )
    )
    kept = [c for c in picked.columns if not c.startswith("__") and c != "rules"]
    return picked.select(
        *kept,
        rule["id"].alias("rule_id"),
        rule["service"].alias("rule_service"),
        rule["valid_from"].alias("rule_valid_from"),
        rule["valid_to"].alias("rule_valid_to"),
        rule["reviewed_at"].alias("rule_reviewed_at"),
        rule["source_url"].alias("rule_source_url"),
        rule["confidence"].alias("rule_confidence"),
        rule["cost_drivers"].alias("rule_cost_drivers"),
        rule["investigation_checks"].alias("rule_investigation_checks"),
        rule["data"].alias("rule_data"),
        warnings.alias("rule_warnings"),
    )


def rules_of_type(
    questions: DataFrame, rules: DataFrame, rule_type: str, as_of: Column
) -> DataFrame:
    """Lookups with a fixed rule type; question columns that are absent count as not asked."""
    for name, kind in (("service", "string"), ("category", "string"), ("usage_date", "date")):
        if name not in questions.columns:
            questions = questions.withColumn(name, F.lit(None).cast(kind))
    return select_rules(questions.withColumn("rule_type", F.lit(rule_type)), rules, as_of)


def focus_rules(questions: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """The rule of each asked specification version; an unknown version has no rule id."""
    versions = rules.filter(F.col("rule_type") == "focus_version").select(
        F.get_json_object("data", "$.version").alias("version"),
        F.col("id").alias("rule_id"),
        is_stale(F.col("reviewed_at"), as_of).alias("is_stale"),
    )
    return questions.join(versions, "version", "left")


def known_billing_changes(ranges: DataFrame, rules: DataFrame) -> DataFrame:
    """Billing changes that start inside each (provider, start, end) range; all for an open range."""
    events = rules.filter(F.col("rule_type") == "billing_change").select(
        "provider", F.col("id").alias("rule_id"), "valid_from", F.col("seq").alias("rule_seq")
    )
    inside = F.col("valid_from").between(F.col("start"), F.col("end"))
    open_range = F.col("start").isNull() | F.col("end").isNull()
    return ranges.join(events, "provider").filter(open_range | inside)


def knowledge_provenance(citations: DataFrame) -> DataFrame:
    """Which rules a report relied on, how old their reviews are, and which are stale."""
    per_rule = citations.groupBy("rule_id").agg(
        F.min("rule_reviewed_at").alias("first_review"),
        F.max("rule_reviewed_at").alias("last_review"),
        F.max("is_stale").alias("stale"),
    )
    return per_rule.agg(
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
        F.min("first_review").alias("oldest_review_date"),
        F.max("last_review").alias("newest_review_date"),
        F.array_sort(F.collect_set(F.when(F.col("stale"), F.col("rule_id")))).alias("stale_rule_ids"),
    )


def freshness_gaps(coverage: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Hours by which each provider's data stops short of the asked period end.

    ``coverage`` has provider, data_through and period_end (a date).
    """
    asked = rules_of_type(
        coverage.withColumn("usage_date", F.col("period_end")), rules, "data_freshness", as_of
    )
    documented = F.get_json_object("rule_data", "$.expected_delay_hours").cast("double")
    seconds = F.unix_timestamp(end_of_day(F.col("period_end"))) - F.unix_timestamp("data_through")
    gap = F.greatest(seconds, F.lit(0))
    return (
        asked.withColumn("expected_delay_hours", F.coalesce(documented, F.lit(DEFAULT_DELAY_HOURS)))
        .withColumn("gap_hours", F.bround(gap.cast("decimal(20,0)") / 3600, 1).cast("double"))
        .withColumn("is_incomplete", gap > 0)
        .withColumn("beyond_expected", F.col("gap_hours") > F.col("expected_delay_hours"))
        .select(
            *coverage.columns, "rule_id", "expected_delay_hours", "gap_hours", "is_incomplete",
            "beyond_expected",
        )
    )
