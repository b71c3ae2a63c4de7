"""Period comparison.

The main pass sums both periods per key in one aggregation whose buffers are fixed
width, so it combines map-side and a hot key never lands whole in one task. Only the
few kept candidates (a proven bound) are then described from the cost rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendshift.functions.classify import DIMENSIONS, dimension_key, service_category
from spendshift.functions.money import percent_change, rounded, total, unit_cost
from spendshift.operators.filters import is_material, with_window
from spendshift.operators.ordering import with_position
from spendshift.periods import Period
from spendshift.schemas import TOTAL
from spendshift.session import settle, stored

KEY = ["provider", "dimension", "key"]


@dataclass(frozen=True)
class Thresholds:
    min_change: float = 5.0
    min_percent: float = 20.0
    tolerance: float = 0.05
    max_candidates: int = 8

    def __post_init__(self) -> None:
        if self.max_candidates < 1:
            raise ValueError("max_candidates must be 1 or more")


# ------------------------------------------------------------------ keys


def with_partition_key(windowed: DataFrame) -> DataFrame:
    """One key per row: the resource when there is one, else the service."""
    has_resource = F.coalesce(F.col("resource_id"), F.lit("")) != ""
    return windowed.withColumn(
        "dimension", F.when(has_resource, "resource").otherwise("service")
    ).withColumn("key", F.when(has_resource, F.col("resource_id")).otherwise(F.col("service_name")))


def with_dimension_keys(windowed: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """One row per requested dimension; rows without a key in a dimension drop out of it."""
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), dimension_key(d).alias("key")) for d in dimensions]
    )
    exploded = windowed.withColumn("__pair", F.explode(pairs))
    return (
        exploded.withColumn("dimension", F.col("__pair.dimension"))
        .withColumn("key", F.col("__pair.key"))
        .drop("__pair")
        .filter(F.col("key").isNotNull())
    )


# ------------------------------------------------------------------ totals and changes


def key_totals(keyed: DataFrame) -> DataFrame:
    """Both periods' cost and quantity per key, and where the key was first seen."""
    current = F.col("window") == "current"

    def windowed_sum(value: str, is_current: bool) -> Column:
        return total(F.when(current if is_current else ~current, F.col(value)))

    return keyed.groupBy(*KEY).agg(
        windowed_sum("effective_cost", True).alias("current_cost"),
        windowed_sum("effective_cost", False).alias("baseline_cost"),
        windowed_sum("usage_quantity", True).alias("current_quantity"),
        windowed_sum("usage_quantity", False).alias("baseline_quantity"),
        F.min("seq").alias("first_seq"),
    )


def length_adjusted(amount: Column, current: Period, baseline: Period) -> Column:
    """A baseline amount scaled to the length of the current period."""
    return amount * F.lit(current.days) / F.lit(baseline.days)


def with_changes(totals: DataFrame, current: Period, baseline: Period) -> DataFrame:
    """Expected cost, change, percent, averages, unit costs and the new-spend flag."""
    cost, base = F.col("current_cost"), F.col("baseline_cost")
    quantity, base_quantity = F.col("current_quantity"), F.col("baseline_quantity")
    expected = rounded(length_adjusted(base, current, baseline), 6).cast(TOTAL)
    return (
        totals.withColumn("expected_baseline_cost", expected)
        .withColumn("absolute_change", (cost - F.col("expected_baseline_cost")).cast(TOTAL))
        .withColumn("percent_change", percent_change(cost, F.col("expected_baseline_cost")))
        .withColumn("baseline_daily_average", rounded(base / F.lit(baseline.days), 6))
        .withColumn("current_daily_average", rounded(cost / F.lit(current.days), 6))
        .withColumn(
            "quantity_percent_change",
            percent_change(
                (quantity * F.lit(baseline.days)).cast("decimal(24,6)"),
                (base_quantity * F.lit(current.days)).cast("decimal(24,6)"),
            ),
        )
        .withColumn("unit_cost_baseline", unit_cost(base, base_quantity))
        .withColumn("unit_cost_current", unit_cost(cost, quantity))
        .withColumn("is_new", (base <= 0) & (cost > 0))
        .withColumn("raw_delta", (cost - base).cast(TOTAL))
    )


def rank_order() -> list[Column]:
    """Largest raw increase first, ties to the key seen first."""
    return [F.col("raw_delta").desc(), F.col("first_seq"), F.col("dimension"), F.col("key")]


# ------------------------------------------------------------------ description of keys

# First seen per key, by column; the currency is the one last seen.
FIRST_SEEN = {
    "account": "billing_account_id", "region": "region_id", "resource": "resource_id", "resource_name": "resource_name",
}
LISTED = ("service", "sku", "day", "tag")
FACTS = (*LISTED, *FIRST_SEEN, "currency")


def first_seen(keyed: DataFrame, kinds: Sequence[str] = FACTS) -> DataFrame:
    """One row per key with the attributes that are a single first or last value."""

    def filled(name: str) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.struct("seq", name))

    picks = [F.min(filled(column))[column].alias(column) for kind, column in FIRST_SEEN.items() if kind in kinds]
    if "currency" in kinds:
        picks.append(F.coalesce(F.max(filled("currency"))["currency"], F.lit("USD")).alias("currency"))
    return keyed.groupBy(*KEY).agg(*picks) if picks else keyed.select(*KEY).distinct()


def key_facts(keyed: DataFrame, kinds: Sequence[str] = LISTED) -> DataFrame:
    """Distinct services, SKUs, current days and tags per key, with their cost and first sight.

    Only attributes of which a key has several are listed; one map-side combined shuffle
    serves them all.
    """
    current = F.col("window") == "current"
    values = {
        "service": F.col("service_name"),
        "sku": F.col("sku_id"),
        "day": F.when(current, F.date_format("usage_date", "yyyy-MM-dd")),
    }

    def fact(kind: str, name: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("fact"), name.alias("name"), value.alias("value"))

    no_name = F.lit(None).cast("string")
    plain = [fact(kind, no_name, values[kind]) for kind in kinds if kind in values]
    lists = []
    if plain:
        lists.append(F.filter(F.array(*plain), lambda f: F.coalesce(f["value"], F.lit("")) != ""))
    if "tag" in kinds:
        tags = F.transform(F.map_entries("tags"), lambda e: fact("tag", e["key"], e["value"]))
        lists.append(F.filter(F.coalesce(tags, F.array()), lambda f: f["value"].isNotNull()))
    exploded = keyed.select(
        *KEY, "seq", F.when(current, F.col("effective_cost")).alias("cost"), F.explode(F.concat(*lists)).alias("f")
    )
    return exploded.groupBy(*KEY, "f.fact", "f.name", "f.value").agg(
        total(F.col("cost")).alias("cost"), F.min("seq").alias("first_seq")
    )


def describe_facts(facts: DataFrame) -> DataFrame:
    """One row per key: dominant service, SKUs, tags, daily costs."""
    value, kind = F.col("value"), F.col("fact")
    per_name = facts.groupBy(*KEY, "fact", "name").agg(
        F.min(F.struct("first_seq", "value")).alias("first"),
        F.max(F.struct("cost", (-F.col("first_seq")).alias("early"), "value")).alias("top"),
        F.collect_set(F.when(kind == "sku", value)).alias("skus"),
        # At most one entry per day of the current period.
        F.collect_list(F.when(kind == "day", F.struct(value.alias("day"), "cost"))).alias("days"),
    )

    def pick(name: str, column: Column) -> Column:
        return F.max(F.when(F.col("fact") == name, column))

    first = F.col("first.value")
    top_service = F.when(F.col("top.cost") > 0, F.col("top.value")).otherwise(first)
    tag = F.when(F.col("fact") == "tag", F.struct(F.col("name").alias("key"), first.alias("value")))
    return per_name.groupBy(*KEY).agg(
        pick("service", top_service).alias("service_name"),
        pick("sku", F.col("skus")).alias("sku_ids"),
        pick("day", F.col("days")).alias("days"),
        F.map_from_entries(F.array_sort(F.collect_list(tag))).alias("tags"),
    )


def describe_keys(keyed: DataFrame, kinds: Sequence[str] = FACTS) -> DataFrame:
    """One row per key with the wanted kinds of attributes."""
    rows = first_seen(keyed, kinds)
    listed = [kind for kind in LISTED if kind in kinds]
    if not listed:
        return rows
    told = rows.join(describe_facts(key_facts(keyed, listed)), KEY, "left")
    return (
        told.withColumn("sku_ids", F.array_sort(F.coalesce("sku_ids", F.array().cast("array<string>"))))
        .withColumn("days", F.coalesce("days", F.array().cast(told.schema["days"].dataType)))
        .withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))
        .withColumn("service_category", service_category(F.col("service_name")))
    )


def first_spike(baseline: Period) -> Column:
    """First current day above one and a half times the key's baseline daily average."""

    # Compared as day cost * days * 2 > baseline * 3, so the average is never rounded.
    def above(day: Column) -> Column:
        return (day["cost"] * baseline.days * 2 > F.col("baseline_cost") * 3) & (
            day["cost"] > F.lit("0.01").cast("decimal(3,2)")
        )

    return F.array_min(F.transform(F.filter("days", above), lambda d: d["day"])).cast("date")


def describe(
    keyed: DataFrame, changes: DataFrame, baseline: Period, kinds: Sequence[str] = FACTS
) -> DataFrame:
    """Attach names, first-seen attributes, SKUs, tags, currency and spike date to changes."""
    described = changes.join(describe_keys(keyed, kinds), KEY, "left")
    return described.withColumn("first_spike_date", first_spike(baseline)).drop("days")


# ------------------------------------------------------------------ candidates


def material_candidates(
    changes: DataFrame, thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """The first few material increases per provider, with their rank among all keys.

    Each key is placed among the sorted places of the kept candidates, the keys of each
    interval are counted, and a running sum over the intervals gives the ranks: no row is
    multiplied and no provider's keys are sorted.
    """
    per_provider = Window.partitionBy("provider").orderBy(*rank_order())
    kept = (
        changes.filter(is_material(thresholds.min_change, thresholds.min_percent))
        .withColumn("kept_position", F.row_number().over(per_provider))
        .filter(F.col("kept_position") <= thresholds.max_candidates)
    )
    place = F.struct(
        (-F.col("raw_delta")).alias("d"), F.col("first_seq").alias("s"), F.col("dimension").alias("m"),
        F.col("key").alias("k"),
    )
    marks = kept.groupBy("provider").agg(F.array_sort(F.collect_list(place)).alias("__marks"))
    passed = F.size(F.filter("__marks", lambda mark: mark <= F.col("__place"))).cast("bigint")
    counted = (
        changes.select("provider", place.alias("__place")).join(marks, "provider")
        .groupBy("provider", passed.alias("__at")).agg(F.count(F.lit(1)).alias("__keys"))
    )
    slots = kept.select(
        "provider", (F.col("kept_position") - 1).cast("bigint").alias("__at"), F.lit(0).cast("bigint").alias("__keys"), "kept_position"
    )
    running = Window.partitionBy("provider").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    ahead = (
        slots.unionByName(counted, allowMissingColumns=True).withColumn("position", F.sum("__keys").over(running))
        .filter(F.col("kept_position").isNotNull()).select("provider", "kept_position", "position")
    )
    return kept.join(ahead, ["provider", "kept_position"]).withColumn(
        "candidate_id", _numbered_id(F.concat(F.col("provider"), F.lit("-cand-")))
    )


def _numbered_id(prefix: Column) -> Column:
    text = F.col("position").cast("string")
    return F.concat(prefix, F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text))


def compare_keys(costs: DataFrame, current: Period, baseline: Period) -> DataFrame:
    """Changes of every candidate key of every provider.

    The totals are computed once: selection, ranks and provider totals all read them.
    """
    keyed = with_partition_key(with_window(costs, current, baseline))
    return with_changes(settle(key_totals(keyed)), current, baseline)


def candidates(
    costs: DataFrame,
    current: Period,
    baseline: Period,
    thresholds: Thresholds = Thresholds(),
    changes: DataFrame | None = None,
) -> DataFrame:
    """Material candidates, fully described (the flagship comparison)."""
    if changes is None:
        changes = compare_keys(costs, current, baseline)
    kept = stored(material_candidates(changes, thresholds))
    keyed = with_partition_key(with_window(costs, current, baseline))
    own_rows = keyed.join(kept.select(*KEY), KEY, "left_semi")
    return describe(own_rows, kept, baseline)


def provider_comparison(
    changes: DataFrame,
    candidate_rows: DataFrame,
    current: Period,
    baseline: Period,
    thresholds: Thresholds = Thresholds(),
) -> DataFrame:
    """Per provider: totals over all keys, and how much of the change the candidates cover."""
    sums = changes.groupBy("provider").agg(
        total(F.col("current_cost")).alias("current_cost"),
        total(F.col("baseline_cost")).alias("baseline_cost"),
    )
    expected = rounded(length_adjusted(F.col("baseline_cost"), current, baseline), 6).cast(TOTAL)
    measured = (
        sums.withColumn("expected_baseline_cost", expected)
        .withColumn("absolute_change", (F.col("current_cost") - F.col("expected_baseline_cost")).cast(TOTAL))
        .withColumn("percent_change", percent_change(F.col("current_cost"), F.col("expected_baseline_cost")))
    )
    covered = candidate_rows.groupBy("provider").agg(
        total(F.col("absolute_change")).alias("attributed_change"),
        F.count(F.lit(1)).alias("candidate_count"),
    )
    joined = (
        measured.join(F.broadcast(covered), "provider", "left")
        .withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
        .withColumn("attributed_change", F.coalesce("attributed_change", F.lit(0).cast(TOTAL)))
    )
    return reconcile(joined, thresholds.tolerance)


def reconcile(df: DataFrame, tolerance: float, change: str = "absolute_change") -> DataFrame:
    """Add the unattributed remainder and whether it is within tolerance."""
    measured = F.col(change)
    allowed = F.greatest(F.abs(measured), F.lit(1).cast(TOTAL)) * F.lit(str(tolerance)).cast("decimal(6,4)")
    return df.withColumn(
        "unattributed_change", (measured - F.col("attributed_change")).cast(TOTAL)
    ).withColumn("within_tolerance", F.abs(F.col("unattributed_change")) <= allowed)


def overall_comparison(providers: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """One row over all providers, summed after the providers' own rounding."""
    sums = providers.agg(
        total(F.col("current_cost")).alias("total_current_cost"),
        total(F.col("baseline_cost")).alias("total_baseline_cost"),
        total(F.col("expected_baseline_cost")).alias("total_expected_cost"),
        total(F.col("attributed_change")).alias("attributed_change"),
    )
    change = (F.col("total_current_cost") - F.col("total_expected_cost")).cast(TOTAL)
    measured = sums.withColumn("total_absolute_change", change).withColumn(
        "total_percent_change", percent_change(F.col("total_current_cost"), F.col("total_expected_cost"))
    )
    return reconcile(measured, tolerance, "total_absolute_change")


def total_costs(costs: DataFrame) -> DataFrame:
    """Both measures of all rows, from one scan."""
    both = costs.agg(total(F.col("effective_cost")).alias("effective"), total(F.col("billed_cost")).alias("billed"))
    return both.unpivot([], ["effective", "billed"], "measure", "total_cost")


def total_cost(costs: DataFrame, use_effective: bool = True) -> DataFrame:
    column = "effective_cost" if use_effective else "billed_cost"
    return costs.agg(total(F.col(column)).alias("total_cost"))


# ------------------------------------------------------------------ breakdowns and daily series


def group_changes(
    costs: DataFrame, current: Period, baseline: Period, dimensions: Sequence[str] = DIMENSIONS
) -> DataFrame:
    """Changes of every group of every requested dimension."""
    keyed = with_dimension_keys(with_window(costs, current, baseline), dimensions)
    return with_changes(key_totals(keyed), current, baseline)


def with_group_ids(changes: DataFrame) -> DataFrame:
    """Number all groups of a dimension by raw increase."""
    numbered = with_position(changes, ["provider", "dimension"], rank_order())
    prefix = F.concat(F.col("provider"), F.lit("-"), F.col("dimension"), F.lit("-"))
    return numbered.withColumn("candidate_id", _numbered_id(prefix))


def breakdown(
    costs: DataFrame,
    current: Period,
    baseline: Period,
    group_by: str = "service",
    limit: int = 25,
) -> DataFrame:
    """Largest raw increases per provider for one dimension; unknown names mean service."""
    dimension = group_by if group_by in DIMENSIONS else "service"
    keyed = with_dimension_keys(with_window(costs, current, baseline), [dimension])
    changes = with_changes(key_totals(keyed), current, baseline)
    per_provider = Window.partitionBy("provider").orderBy(*rank_order())
    kept = (
        changes.withColumn("__rank", F.row_number().over(per_provider))
        .filter(F.col("__rank") <= limit)
        .withColumn("position", (F.col("__rank") - 1).cast("bigint"))
        .drop("__rank")
    )
    prefix = F.concat(F.col("provider"), F.lit("-"), F.col("dimension"), F.lit("-"))
    kept = settle(kept.withColumn("candidate_id", _numbered_id(prefix)))
    own_rows = keyed.join(kept.select(*KEY), KEY, "left_semi")
    return describe(own_rows, kept, baseline)


def daily_totals(costs: DataFrame, period: Period) -> DataFrame:
    """Billed and effective cost of every provider on every day, zero-filled."""
    # One scan: days outside the period fold into one row per provider, which names the provider.
    day = F.when(period.contains(F.col("usage_date")), F.col("usage_date"))
    sums = settle(
        costs.groupBy("provider", day.alias("usage_date")).agg(
            total(F.col("billed_cost")).alias("billed_cost"),
            total(F.col("effective_cost")).alias("effective_cost"),
        )
    )
    providers = sums.select("provider").distinct()
    calendar = providers.withColumn(
        "usage_date", F.explode(F.sequence(F.lit(period.start), F.lit(period.end)))
    )
    zero = F.lit(0).cast(TOTAL)
    return (
        calendar.join(sums, ["provider", "usage_date"], "left")
        .withColumn("billed_cost", F.coalesce("billed_cost", zero))
        .withColumn("effective_cost", F.coalesce("effective_cost", zero))
    )
