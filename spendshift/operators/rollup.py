"""Row quarantine and the daily rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendshift.functions.classify import resource_key
from spendshift.operators.ordering import with_position
from spendshift.schemas import COST, MONEY

ROLLUP_KEYS = [
    "provider", "billing_account_id", "usage_date", "service_name", "sku_id", "region_id", "resource_id",
    "charge_category", "currency",
]
_FIRST_ROW = ["service_category", "charge_description", "usage_unit"]
_FIRST_FILLED = ["resource_name", "commitment_discount_id"]


def rejection_reason() -> Column:
    """Why a row cannot carry a comparison; null for a usable row."""
    no_service = F.coalesce(F.nullif("service_name", F.lit("unknown")), F.lit("")) == ""
    empty = (F.col("billed_cost") == 0) & (F.col("effective_cost") == 0) & (F.col("usage_quantity") == 0)
    return (
        F.when(F.col("usage_date").isNull(), "bad_date")
        .when(no_service, "missing_service")
        .when(empty, "empty_row")
    )


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (usable rows, rejected rows with a reason code and no values)."""
    judged = rows.withColumn("code", rejection_reason())
    position = [c for c in ("source_file", "line", "position", "row_number", "seq") if c in rows.columns]
    return judged.filter("code is null").drop("code"), judged.filter("code is not null").select(
        *position, "provider", "code"
    )


def daily_rollup(costs: DataFrame) -> DataFrame:
    """Collapse rows to one per day, key and tag set; money and quantity are summed exactly.

    One aggregation: a task folds its own rows of a key, first values included, before the
    shuffle, so a hot key arrives as one row per task.
    """
    tag_set = F.sort_array(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>"))))
    filled = [
        F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("seq", c))).alias(f"__{c}")
        for c in _FIRST_FILLED
    ]
    coarse = costs.withColumn("tag_set", tag_set).groupBy(*ROLLUP_KEYS, "tag_set").agg(
        *[F.sum(c).cast(MONEY).alias(c) for c in ("usage_quantity", "billed_cost", "effective_cost")],
        # The number by itself, so that a reader of nothing else leaves the first row's texts out of the shuffle.
        F.min(F.struct("seq")).alias("first_seq"),
        F.min(F.struct("seq", *_FIRST_ROW)).alias("first"),
        *filled,
        # Unlike units share a row when all keys agree; the flag says so.
        (F.min("usage_unit") != F.max("usage_unit")).alias("mixed_units"),
    )
    rolled = (
        coarse.withColumn("tags", F.map_from_entries("tag_set"))
        .withColumn("seq", F.col("first_seq.seq"))
        .withColumn("source_record_id", F.lit(None).cast("string"))
    )
    for name in _FIRST_ROW:
        rolled = rolled.withColumn(name, F.col(f"first.{name}"))
    for name in _FIRST_FILLED:
        rolled = rolled.withColumn(name, F.col(f"__{name}.{name}"))
    return rolled.select(*COST.names, "mixed_units")


def with_record_ids(rolled: DataFrame, renumber: bool = False) -> DataFrame:
    """Number the rolled-up rows in (day, service, resource) order; with ``renumber`` that number is their ``seq`` from here on."""
    keyed = rolled.withColumn("resource_key", resource_key(F.col("resource_id"), F.col("service_name")))
    tie_breaks = ["seq", "provider", "billing_account_id", "sku_id", "region_id", "charge_category", "currency"]
    order = [F.col(c) for c in ("usage_date", "service_name", "resource_key", *tie_breaks)]
    order.append(F.sort_array(F.map_entries("tags")))
    numbered = with_position(keyed, [], order)
    number = F.col("position").cast("string")
    padded = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)
    told = numbered.withColumn(
        "source_record_id", F.concat(F.lit("upload-"), F.col("usage_date").cast("string"), F.lit("-"), padded)
    )
    return (told.withColumn("seq", F.col("position").cast("bigint")) if renumber else told).drop("resource_key", "position")
