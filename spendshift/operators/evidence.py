"""Evidence for candidates.

Candidates are few per provider; whether they are broadcast to the metric, audit, inventory
and recommendation tables is left to Spark, which knows their size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendshift.functions.classify import contains_any, provenance_reference
from spendshift.functions.parsing import end_of_day
from spendshift.functions.text import normalised_tags, scrub, scrub_tags
from spendshift.periods import Period

MAX_METRICS = 3
MAX_AUDIT = 3
MAX_RECOMMENDATIONS = 2
CANDIDATE = ["provider", "candidate_id"]
KINDS = ["cost", "usage", "inventory", "metric", "audit", "recommendation", "freshness"]
EVIDENCE_COLUMNS = [
    "provider", "candidate_id", "kept_position", "source_type", "kind_order", "item_order", "source_id",
    "statement", "numeric_value", "numeric_unit", "observed_at", "contains_untrusted_text",
]


def _resource_candidates(candidates: DataFrame, *extra: str) -> DataFrame:
    """The candidates that name a resource."""
    return candidates.filter(F.col("resource_id").isNotNull()).select(*CANDIDATE, "resource_id", *extra)


# ------------------------------------------------------------------ joins


def first_inventory(candidates: DataFrame, inventory: DataFrame) -> DataFrame:
    """The first inventory row of each candidate's resource."""
    matched = inventory.join(_resource_candidates(candidates), ["provider", "resource_id"])
    per = Window.partitionBy(*CANDIDATE).orderBy("seq")
    return matched.withColumn("__n", F.row_number().over(per)).filter("__n = 1").drop("__n")


def metric_points_of(metrics: DataFrame) -> DataFrame:
    """Series with nested points as one row per point."""
    return metrics.withColumn("__p", F.explode("points")).select(
        *[c for c in metrics.columns if c != "points"],
        F.to_date("__p.timestamp").alias("point_date"),
        F.col("__p.value").cast("decimal(30,6)").alias("value"),
    )


SERIES = ["provider", "resource_id", "metric_name", "unit", "statistic"]


def metric_windows(points: DataFrame, current: Period, baseline: Period) -> DataFrame:
    """Total, average, peak and point count of every series in both periods."""
    day, value = F.col("point_date"), F.col("value")
    aggregates = [F.min("seq").alias("seq")]
    for name, period in (("current", current), ("baseline", baseline)):
        inside = F.when(period.contains(day), value)
        aggregates += [
            F.sum(inside).alias(f"{name}_sum"),
            F.max(inside).alias(f"{name}_peak"),
            F.count(inside).alias(f"{name}_points"),
        ]
    sums = points.groupBy(*SERIES).agg(*aggregates)
    zero = F.lit(0).cast("decimal(30,6)")
    out = sums
    for name in ("current", "baseline"):
        total = F.coalesce(F.col(f"{name}_sum").cast("decimal(30,6)"), zero)
        out = (
            out.withColumn(f"{name}_total", total)
            .withColumn(
                f"{name}_average",
                F.when(F.col(f"{name}_points") > 0, total / F.col(f"{name}_points")).otherwise(zero)
                .cast("decimal(38,10)"),
            )
            .withColumn(f"{name}_max", F.coalesce(F.col(f"{name}_peak"), zero))
            .drop(f"{name}_sum", f"{name}_peak")
        )
    return out


def with_metric_change(windows: DataFrame) -> DataFrame:
    """Percent change of the average at one decimal; null without baseline activity."""
    current, baseline = F.col("current_average"), F.col("baseline_average")
    ratio = (current - baseline).cast("decimal(28,10)") * 100 / baseline.cast("decimal(26,10)")
    return windows.withColumn(
        "average_percent_change", F.when(baseline > 0, F.bround(ratio, 1))
    )


def candidate_series(
    candidates: DataFrame, points: DataFrame, current: Period, baseline: Period
) -> DataFrame:
    """Metric windows of the candidates' resources."""
    own = points.join(_resource_candidates(candidates), ["provider", "resource_id"], "left_semi")
    windows = metric_windows(own, current, baseline)
    return windows.join(_resource_candidates(candidates), ["provider", "resource_id"])


def candidate_events(candidates: DataFrame, audit: DataFrame, current: Period) -> DataFrame:
    """Audit events of the current period in each candidate's scope.

    A resource candidate takes the events that list its resource; a service candidate
    takes all events of its provider.
    """
    inside = audit.filter(current.contains(F.to_date("event_time")))
    touched = inside.withColumn("resource_id", F.explode(F.array_distinct("resource_ids")))
    by_resource = touched.join(_resource_candidates(candidates), ["provider", "resource_id"])
    services = candidates.filter(F.col("resource_id").isNull()).select(*CANDIDATE)
    by_service = inside.join(services, "provider")
    columns = [*audit.columns, "candidate_id"]
    return by_resource.select(*columns).unionByName(by_service.select(*columns))


def _first_of_name(events: DataFrame, *scope: str, limit: int) -> DataFrame:
    per = Window.partitionBy(*scope, "event_name").orderBy("event_time", "seq", "event_id")
    return events.withColumn("__n", F.row_number().over(per)).filter(F.col("__n") <= limit).drop("__n")


def leading_events(
    candidates: DataFrame, audit: DataFrame, current: Period, limit: int = MAX_AUDIT
) -> DataFrame:
    """The first events of every name in each candidate's scope: enough to match and to cite.

    A service candidate's scope is its provider, so those events are cut once per provider
    and only what is left meets the candidates.
    """
    inside = audit.filter(current.contains(F.to_date("event_time")))
    touched = inside.withColumn("resource_id", F.explode(F.array_distinct("resource_ids")))
    by_resource = _first_of_name(
        touched.join(_resource_candidates(candidates), ["provider", "resource_id"]), *CANDIDATE, limit=limit
    )
    services = candidates.filter(F.col("resource_id").isNull()).select(*CANDIDATE)
    by_service = _first_of_name(inside, "provider", limit=limit).join(services, "provider")
    columns = [*audit.columns, "candidate_id"]
    return by_resource.select(*columns).unionByName(by_service.select(*columns))


def first_recommendations(candidates: DataFrame, recommendations: DataFrame) -> DataFrame:
    matched = recommendations.join(_resource_candidates(candidates), ["provider", "resource_id"])
    per = Window.partitionBy(*CANDIDATE).orderBy("seq", "recommendation_id")
    return matched.withColumn("item_order", F.row_number().over(per)).filter(
        F.col("item_order") <= MAX_RECOMMENDATIONS
    )


# ------------------------------------------------------------------ evidence choice


def chosen_metrics(series: DataFrame, specs: DataFrame) -> DataFrame:
    """Up to three series per candidate: those the playbook names, else all of them."""
    named = series.join(specs, CANDIDATE).withColumn(
        "__wanted", (F.size("metric_names") == 0) | contains_any(F.col("metric_name"), F.col("metric_names"))
    )
    per = Window.partitionBy(*CANDIDATE)
    in_order = per.orderBy("seq", "metric_name", "unit", "statistic")
    kept = named.withColumn("__any", F.max("__wanted").over(per)).filter(
        F.col("__wanted") | ~F.col("__any")
    )
    return kept.withColumn("item_order", F.row_number().over(in_order)).filter(
        F.col("item_order") <= MAX_METRICS
    )


def chosen_events(events: DataFrame, specs: DataFrame) -> DataFrame:
    """Up to three events per candidate by time, with a name the playbook watches."""
    named = events.join(specs, CANDIDATE).filter(
        (F.size("audit_event_patterns") == 0)
        | contains_any(F.col("event_name"), F.col("audit_event_patterns"))
    )
    per = Window.partitionBy(*CANDIDATE).orderBy("event_time", "seq", "event_id")
    return named.withColumn("item_order", F.row_number().over(per)).filter(
        F.col("item_order") <= MAX_AUDIT
    )


# ------------------------------------------------------------------ evidence rows


def _number(value: Column, places: int = 2) -> Column:
    return F.format_number(value, places)


def _signed_percent(value: Column) -> Column:
    rounded = F.bround(value, 1)
    return F.concat(F.when(rounded >= 0, "+").otherwise(""), rounded.cast("string"), F.lit("%"))


def _rows(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    defaults = {
        "item_order": F.lit(1),
        "numeric_value": F.lit(None),
        "numeric_unit": F.lit(None),
        "observed_at": F.lit(None),
        "contains_untrusted_text": F.lit(False),
    }
    filled = {**defaults, **columns}
    kinds = {
        "item_order": "int", "numeric_value": "double", "numeric_unit": "string",
        "observed_at": "timestamp", "contains_untrusted_text": "boolean", "statement": "string",
        "source_id": "string",
    }
    return df.select(
        *CANDIDATE,
        "kept_position",
        F.lit(kind).alias("source_type"),
        F.lit(KINDS.index(kind)).alias("kind_order"),
        *[filled[name].cast(kinds[name]).alias(name) for name in (
            "item_order", "source_id", "statement", "numeric_value", "numeric_unit", "observed_at",
            "contains_untrusted_text",
        )],
    )


def cost_evidence(candidates: DataFrame) -> DataFrame:
    moved = F.when(F.col("percent_change").isNull(), F.lit("no spend in the baseline")).otherwise(
        F.concat(_signed_percent(F.col("percent_change")), F.lit(" against the length-adjusted baseline"))
    )
    statement = F.concat(
        F.lit("Effective cost of "), F.col("key"), F.lit(" went from "),
        _number(F.col("expected_baseline_cost")), F.lit(" to "), _number(F.col("current_cost")),
        F.lit(" "), F.col("currency"), F.lit(" ("), moved, F.lit(")."),
    )
    return _rows(
        candidates, "cost", source_id=F.col("key"), statement=statement,
        numeric_value=F.col("absolute_change"), numeric_unit=F.col("currency"),
    )


def usage_evidence(candidates: DataFrame) -> DataFrame:
    """Skipped when neither period has usage."""
    used = candidates.filter((F.col("current_quantity") > 0) | (F.col("baseline_quantity") > 0))
    moved = F.when(F.col("quantity_percent_change").isNull(), F.lit("new usage")).otherwise(
        _signed_percent(F.col("quantity_percent_change"))
    )
    unit_note = F.when(
        F.col("unit_cost_baseline").isNotNull() & F.col("unit_cost_current").isNotNull(),
        F.concat(
            F.lit(" Cost per unit went from "), _number(F.col("unit_cost_baseline"), 6), F.lit(" to "),
            _number(F.col("unit_cost_current"), 6), F.lit(" "), F.col("currency"), F.lit("."),
        ),
    ).otherwise(F.lit(""))
    statement = F.concat(
        F.lit("Usage of "), F.col("key"), F.lit(" went from "), _number(F.col("baseline_quantity")),
        F.lit(" to "), _number(F.col("current_quantity")), F.lit(" ("), moved, F.lit(")."), unit_note,
    )
    return _rows(
        used, "usage", source_id=F.col("key"), statement=statement,
        numeric_value=F.col("current_quantity") - F.col("baseline_quantity"),
        numeric_unit=F.lit("usage units"),
    )


def inventory_evidence(rows: DataFrame) -> DataFrame:
    tag_text, tag_flag = scrub_tags(normalised_tags(F.col("tags")))
    name, name_flag = scrub(F.coalesce("resource_name", "resource_id"), 120)
    created = F.coalesce(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("unknown"))
    statement = F.concat(
        F.lit("Inventory lists "), F.col("resource_type"), F.lit(" "), name, F.lit(" in "),
        F.coalesce("region_id", F.lit("an unknown region")), F.lit(", state "), F.col("state"),
        F.lit(", created "), created, F.lit(", tags: "), tag_text, F.lit("."),
    )
    return _rows(
        rows, "inventory", source_id=F.col("resource_id"), statement=statement,
        contains_untrusted_text=tag_flag | name_flag,
    )


def metric_evidence(rows: DataFrame) -> DataFrame:
    changed = with_metric_change(rows)
    moved = F.when(F.col("average_percent_change").isNull(), F.lit("no baseline activity")).otherwise(
        _signed_percent(F.col("average_percent_change"))
    )
    statement = F.concat(
        F.col("metric_name"), F.lit(" ("), F.col("statistic"), F.lit(", "), F.col("unit"),
        F.lit(") averaged "), _number(F.col("baseline_average")), F.lit(" a day in the baseline and "),
        _number(F.col("current_average")), F.lit(" in the current period ("), moved,
        F.lit("), with a peak of "), _number(F.col("current_max")), F.lit("."),
    )
    return _rows(
        changed, "metric", item_order=F.col("item_order"), statement=statement,
        source_id=F.concat_ws(":", "resource_id", "metric_name"),
        numeric_value=F.bround(F.col("current_average"), 4), numeric_unit=F.col("unit"),
    )


def audit_evidence(rows: DataFrame) -> DataFrame:
    summary, summary_flag = scrub(F.col("summary"), 240)
    actor, actor_flag = scrub(F.coalesce(F.nullif("actor", F.lit("")), F.lit("unknown")), 120)
    place, place_flag = scrub(F.col("source_location"), 60)
    has_ip = F.coalesce(F.col("source_ip"), F.lit("")) != ""
    has_place = has_ip & (F.coalesce(F.col("source_location"), F.lit("")) != "")
    origin = F.when(has_place, F.concat(F.lit(" from "), F.col("source_ip"), F.lit(" ("), place, F.lit(")"))) \
        .when(has_ip, F.concat(F.lit(" from "), F.col("source_ip"))).otherwise(F.lit(""))
    statement = F.concat(
        F.col("source"), F.lit(" logged "), F.col("event_name"), F.lit(" at "),
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" by "), actor, origin,
        F.lit(". Reported detail: "), F.coalesce(F.nullif(summary, F.lit("")), F.lit("none")),
    )
    return _rows(
        rows, "audit", item_order=F.col("item_order"), source_id=F.col("event_id"), statement=statement,
        observed_at=F.col("event_time"),
        contains_untrusted_text=summary_flag | actor_flag | (has_place & place_flag),
    )


def recommendation_evidence(rows: DataFrame) -> DataFrame:
    description, flagged = scrub(F.col("description"), 240)
    statement = F.concat(
        F.col("source"), F.lit(" recommends ("), F.col("category"), F.lit("): "), description,
        F.lit(" Estimated monthly saving "), _number(F.col("estimated_monthly_savings")), F.lit(" "),
        F.col("currency"), F.lit("."),
    )
    return _rows(
        rows, "recommendation", item_order=F.col("item_order"), source_id=F.col("recommendation_id"),
        statement=statement, numeric_value=F.col("estimated_monthly_savings"),
        numeric_unit=F.col("currency"), contains_untrusted_text=flagged,
    )


def freshness_evidence(candidates: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row per candidate of a provider whose data stops short of the period."""
    short = candidates.join(F.broadcast(gaps.filter("is_incomplete")), "provider")
    statement = F.concat(
        F.lit("Cost data is complete only through "),
        F.date_format("data_through", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" while the period ends "),
        F.date_format(end_of_day(F.col("period_end")), "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("; the usual delay is about "), F.format_number("expected_delay_hours", 0),
        F.lit("h, so the missing days are unavailable data and not zero usage."),
    )
    return _rows(
        short, "freshness", source_id=F.concat(F.col("provider"), F.lit(":data_through")), statement=statement
    )


def assemble(parts: list[DataFrame], provenance: DataFrame) -> DataFrame:
    """Union the kinds, attach provenance per (provider, kind) and number the evidence."""
    rows = reduce(DataFrame.unionByName, parts)
    source_kind = {
        "cost": "cost", "usage": "cost", "freshness": "cost", "inventory": "inventory",
        "metric": "metrics", "audit": "audit", "recommendation": "recommendations",
    }
    lookup = F.create_map(*[F.lit(item) for pair in source_kind.items() for item in pair])
    sources = provenance.select(
        "provider",
        F.col("kind").alias("source_kind"),
        F.col("observed_at").alias("__observed_at"),
        "data_through",
        "origin",
        provenance_reference(F.col("query_reference"), F.col("provider"), F.col("source")).alias(
            "query_reference"
        ),
    )
    joined = rows.withColumn("source_kind", F.element_at(lookup, F.col("source_type"))).join(
        F.broadcast(sources), ["provider", "source_kind"], "left"
    )
    numbered = number_evidence(joined)
    return numbered.withColumn("observed_at", F.coalesce("observed_at", "__observed_at")).drop(
        "__observed_at", "source_kind"
    )


def number_evidence(rows: DataFrame) -> DataFrame:
    """Citable ids per provider in assembly order."""
    per = Window.partitionBy("provider").orderBy("kept_position", "kind_order", "item_order")
    number = F.row_number().over(per).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return rows.withColumn("evidence_id", F.concat(F.upper("provider"), F.lit("-E"), padded))
