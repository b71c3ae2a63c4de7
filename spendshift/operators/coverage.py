"""Provenance, coverage and planning tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendshift.functions.classify import provenance_reference
from spendshift.functions.parsing import end_of_day, lenient_timestamp, written_hour
from spendshift.schemas import PROVIDERS

KINDS = ("cost", "metrics", "audit", "inventory", "recommendations")
FOCUS_VERSION = "1.4"

# Export schema versions the readers understand, per provider.
SUPPORTED_VERSIONS = {
    "aws": ["1", "1.0", "2.0"],
    "azure": ["1", "1.0", "2023-11-01"],
    "gcp": ["1", "1.0"],
}

# The evidence types each source kind can back.
KIND_TYPES = {
    "cost": ["cost", "usage"],
    "inventory": ["inventory"],
    "metrics": ["metric"],
    "audit": ["audit"],
    "recommendations": ["recommendation"],
}
# Origins from least to most verified.
ORIGINS = ["upload", "fixture", "live"]


# ------------------------------------------------------------------ provenance


def with_all_kinds(provenance: DataFrame, boundary: Column, origin: str = "upload") -> DataFrame:
    """A provenance row for every provider and kind; absent ones are dated at the boundary."""
    providers = provenance.select("provider").distinct()
    grid = providers.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in KINDS])))
    joined = grid.join(provenance.withColumn("is_present", F.lit(True)), ["provider", "kind"], "left")
    for name in ("observed_at", "retrieved_at", "data_through"):
        joined = joined.withColumn(name, F.coalesce(F.col(name), boundary))
    return (
        joined.withColumn("is_present", F.coalesce("is_present", F.lit(False)))
        .withColumn("source", F.coalesce("source", F.concat_ws("-", F.lit("absent"), "kind")))
        .withColumn("schema_version", F.coalesce("schema_version", F.lit("1")))
        .withColumn("origin", F.coalesce("origin", F.lit(origin)))
    )


def freshness_table(provenance: DataFrame) -> DataFrame:
    """What each source covers, with a reference that can be cited."""
    return provenance.select(
        "provider", "kind", "source", "observed_at", "retrieved_at", "data_through", "origin",
        (F.col("origin") == "fixture").alias("is_fixture"), "schema_version",
        provenance_reference(F.col("query_reference"), F.col("provider"), F.col("source")).alias(
            "query_reference"
        ),
    )


def provider_coverage(provenance: DataFrame) -> DataFrame:
    """Earliest data_through and least-verified origin per provider."""
    rank = F.array_position(F.array(*[F.lit(o) for o in ORIGINS]), F.col("origin"))
    return provenance.groupBy("provider").agg(
        F.min("data_through").alias("data_through"),
        F.min_by("origin", F.when(rank > 0, rank)).alias("origin"),
    ).withColumn("origin", F.coalesce("origin", F.lit("fixture")))


def unsupported_sources(sources: DataFrame) -> DataFrame:
    """Sources whose (provider, schema_version) no reader understands; they are quarantined."""
    supported = F.create_map(
        *[item for p, vs in SUPPORTED_VERSIONS.items()
          for item in (F.lit(p), F.array(*[F.lit(v) for v in vs]))]
    )
    known = F.array_contains(F.try_element_at(supported, F.col("provider")), F.col("schema_version"))
    return sources.filter(~F.coalesce(known, F.lit(False)))


def require_focus_version(version: str) -> str:
    if version != FOCUS_VERSION:
        raise ValueError(f"unsupported FOCUS version {version!r}; supported: {FOCUS_VERSION}")
    return version


def available_source_types(kinds: DataFrame) -> DataFrame:
    """Evidence types per provider from its non-empty (provider, kind) pairs."""
    lookup = F.create_map(
        *[item for k, types in KIND_TYPES.items() for item in (F.lit(k), F.array(*[F.lit(t) for t in types]))]
    )
    exploded = kinds.select(
        "provider", F.explode(F.try_element_at(lookup, F.col("kind"))).alias("source_type")
    )
    return exploded.groupBy("provider").agg(
        F.array_sort(F.collect_set("source_type")).alias("source_types")
    )


def present_kinds(tables: dict[str, DataFrame]) -> DataFrame:
    """The (provider, kind) pairs that have at least one row."""
    parts = [
        df.select("provider").distinct().withColumn("kind", F.lit(kind)) for kind, df in tables.items()
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


# ------------------------------------------------------------------ data through


def aws_data_through(rows: DataFrame) -> DataFrame:
    """Coverage of an hourly export: a last day with fewer than 24 start hours is partial.

    ``rows`` has usage_date and the native ``start_text``; asked before the daily rollup.
    """
    hours = rows.filter(F.col("usage_date").isNotNull()).groupBy("usage_date").agg(
        F.countDistinct(
            F.when(lenient_timestamp(F.col("start_text")).isNotNull(), written_hour(F.col("start_text")))
        ).alias("hours")
    )
    # One row per day of the export: latest two days and the last day's hours.
    ends = hours.agg(
        F.max("usage_date").alias("last_date"),
        F.max_by("hours", "usage_date").alias("last_hours"),
        F.sort_array(F.collect_set("usage_date"), asc=False).alias("__days"),
    )
    earlier = F.try_element_at("__days", F.lit(2))
    return ends.select(
        "last_date",
        "last_hours",
        (F.col("last_hours") < 24).alias("is_partial"),
        end_of_day(
            F.when(F.col("last_hours") < 24, F.coalesce(earlier, F.col("last_date"))).otherwise(
                F.col("last_date")
            )
        ).alias("data_through"),
    )


def gcp_data_through(rows: DataFrame) -> DataFrame:
    """Coverage from usage end times: the last day must reach midnight less one second.

    ``rows`` has usage_date and the native ``end_text``.
    """
    stamp = lenient_timestamp(F.col("end_text"))
    days = rows.filter(F.col("usage_date").isNotNull()).groupBy("usage_date").agg(F.max(stamp).alias("end"))
    per_day = days.agg(
        F.max("usage_date").alias("last_date"),
        F.sort_array(F.collect_set("usage_date"), asc=False).alias("__days"),
        F.max("end").alias("latest_end"),
    )
    earlier = F.try_element_at("__days", F.lit(2))
    in_reach = F.when(F.to_date("latest_end") >= F.col("last_date"), F.col("latest_end"))
    seconds = F.unix_timestamp(in_reach) - F.unix_timestamp(F.to_timestamp("last_date"))
    partial = F.coalesce(seconds < 24 * 3600 - 1, F.lit(False))
    boundary = F.when(earlier.isNotNull(), end_of_day(earlier)).otherwise(in_reach)
    return per_day.select(
        "last_date",
        in_reach.alias("latest_end"),
        partial.alias("is_partial"),
        F.when(partial, boundary).otherwise(end_of_day(F.col("last_date"))).alias("data_through"),
    )


def azure_data_through(rows: DataFrame) -> DataFrame:
    """Daily grain carries no intraday sign, so the last day counts as complete."""
    return rows.agg(F.max("usage_date").alias("last_date")).select(
        "last_date",
        F.lit(False).alias("is_partial"),
        end_of_day(F.col("last_date")).alias("data_through"),
        F.lit("daily grain only; the last day is taken as complete").alias("note"),
    )


# ------------------------------------------------------------------ currency


def currencies(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct currencies per group and whether they mix; none at all means USD."""
    filled = F.when(F.col("currency") != "", F.col("currency"))
    grouped = costs.groupBy(*by) if by else costs.groupBy()
    found = grouped.agg(F.array_sort(F.collect_set(filled)).alias("currencies"))
    return found.withColumn("is_mixed", F.size("currencies") > 1).withColumn(
        "currency", F.coalesce(F.try_element_at("currencies", F.lit(1)), F.lit("USD"))
    )


def require_single_currency(costs: DataFrame) -> str:
    row = currencies(costs).first()
    if row.is_mixed:
        raise ValueError(f"mixed currencies: {', '.join(row.currencies)}")
    return row.currency


# ------------------------------------------------------------------ dataset summaries


def dataset_summary(sources: DataFrame) -> DataFrame:
    """Per dataset: providers, records, period of the cost rows only, earliest coverage."""
    is_cost = F.col("kind") == "cost"
    return sources.groupBy("dataset_id").agg(
        F.array_sort(F.collect_set(F.when(is_cost, F.col("provider")))).alias("providers"),
        F.coalesce(F.sum("stored_rows"), F.lit(0)).alias("record_count"),
        F.min(F.when(is_cost, F.col("period_start"))).alias("period_start"),
        F.max(F.when(is_cost, F.col("period_end"))).alias("period_end"),
        F.min("data_through").alias("data_through"),
    )


def suggested_periods(summaries: DataFrame) -> DataFrame:
    """Split the covered span in half; the later half is the current period."""
    span = F.datediff("period_end", "period_start") + 1
    half = F.floor(span / 2).cast("int")
    single = span < 2
    baseline_end = F.when(single, F.col("period_start")).otherwise(
        F.date_add("period_start", half - 1)
    )
    return summaries.filter(F.col("period_start").isNotNull() & F.col("period_end").isNotNull()).select(
        *summaries.columns,
        F.col("period_start").alias("baseline_start"),
        baseline_end.alias("baseline_end"),
        F.when(single, F.col("period_start")).otherwise(F.date_add(baseline_end, 1)).alias("current_start"),
        F.col("period_end").alias("current_end"),
    )


# ------------------------------------------------------------------ plan and status rows


def plan_rows(candidates: DataFrame, providers: Sequence[str] = PROVIDERS) -> DataFrame:
    """One task per provider: services to look at, keys that must be explained, candidate ids."""
    spark = candidates.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in providers])).alias("provider"))
    in_order = F.array_sort(F.collect_list(F.struct("kept_position", "key", "candidate_id")))
    tasks = candidates.groupBy("provider").agg(
        F.array_sort(F.collect_set("service_name")).alias("focus_areas"), in_order.alias("__c")
    )
    none = F.array().cast("array<string>")
    return wanted.join(tasks, "provider", "left").select(
        "provider",
        F.coalesce("focus_areas", none).alias("focus_areas"),
        F.coalesce(F.slice(F.col("__c.key"), 1, 3), none).alias("must_explain"),
        F.coalesce(F.col("__c.candidate_id"), none).alias("candidate_ids"),
        F.greatest(F.coalesce(F.size("__c"), F.lit(0)), F.lit(1)).cast("bigint").alias("max_findings"),
        F.coalesce(F.size("__c") > 0, F.lit(False)).alias("has_work"),
    )


def provider_statuses(
    findings: DataFrame, coverage: DataFrame, providers: Sequence[str] = PROVIDERS
) -> DataFrame:
    """One row per requested provider; one without data is kept as skipped."""
    spark = findings.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in providers])).alias("provider"))
    counts = findings.groupBy("provider").agg(F.count(F.lit(1)).alias("finding_count"))
    return (
        wanted.join(coverage, "provider", "left")
        .join(counts, "provider", "left")
        .select(
            "provider",
            F.when(F.col("data_through").isNull(), "skipped").otherwise("ok").alias("status"),
            F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
            "data_through",
            "origin",
        )
    )
