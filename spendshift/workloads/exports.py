"""Native exports written from the derived cost rows, so the readers scan real files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendshift.session import scratch_path, with_once
from spendshift.workloads.views import cost_rows, data_stamp

_paths: dict[tuple, str] = {}

# Exports are large texts that repeat themselves. They are written compressed, in files of so many rows, each read by one task.
FILE_ROWS = 250_000
PACKED = {"compression": "lz4", "maxRecordsPerFile": FILE_ROWS}


def forget_written() -> None:
    """Drop the written exports, so the next query writes them anew."""
    _paths.clear()


def _written(spark: SparkSession, sf: str, name: str, write) -> str:
    key = (spark.sparkContext.applicationId, sf, data_stamp(spark, sf), name)
    if key not in _paths:
        path = scratch_path(spark, name)
        write(path)
        _paths[key] = path
    return _paths[key]


def _own(spark, sf, provider: str) -> DataFrame:
    return cost_rows(spark, sf).filter(F.col("provider") == provider)


def stamp(hour=None):
    hour = F.lpad(((F.col("seq") % 24) if hour is None else hour).cast("string"), 2, "0")
    return F.concat(F.col("usage_date").cast("string"), F.lit("T"), hour, F.lit(":00:00Z"))


def aws_rows(spark, sf) -> DataFrame:
    kinds = F.when(F.col("charge_category") == "usage", "Usage").when(
        F.col("charge_category") == "adjustment", "EdpDiscount"
    ).otherwise("Refund")
    even = F.col("seq") % 2 == 0
    same = F.col("effective_cost") == F.col("billed_cost")
    return _own(spark, sf, "aws").select(
        F.col("source_record_id").alias("identity_line_item_id"),
        F.lit("").alias("bill_payer_account_id"),
        F.col("billing_account_id").alias("line_item_usage_account_id"),
        stamp().alias("line_item_usage_start_date"),
        kinds.alias("line_item_line_item_type"),
        F.when(even, "AmazonOther").otherwise(F.col("service_name")).alias("line_item_product_code"),
        F.when(even, F.col("service_name")).alias("product_servicename"),
        F.col("region_id").alias("product_region_code"),
        F.col("resource_id").alias("line_item_resource_id"),
        F.col("resource_name").alias("resource_tags_user_name"),
        F.col("sku_id").alias("line_item_usage_type"),
        F.col("charge_description").alias("line_item_line_item_description"),
        F.col("usage_quantity").cast("string").alias("line_item_usage_amount"),
        F.lit("unit").alias("pricing_unit"),
        F.col("billed_cost").cast("string").alias("line_item_unblended_cost"),
        F.when(~same, F.col("effective_cost").cast("string")).alias("line_item_net_amortized_cost"),
        F.col("currency").alias("line_item_currency_code"),
        F.to_json("tags").alias("resource_tags"),
        F.col("commitment_discount_id").alias("savings_plan_savings_plan_a_r_n"),
    )


def aws_csv(spark, sf) -> str:
    def write(path):
        aws_rows(spark, sf).write.options(**PACKED).option("header", True).option("escape", '"').csv(path)

    return _written(spark, sf, "aws-csv", write)


def aws_json_lines(spark, sf) -> str:
    """One small document per line; rows under ``rows`` or ``items``, with a stray non-object."""
    entry = F.to_json(F.struct("*"))

    def write(path):
        document = F.concat(
            F.when(F.col("line_item_usage_account_id") == "acct-1", F.lit('{"items":[')).otherwise(F.lit('{"rows":["stray",')),
            entry, F.lit("]}"),
        )
        aws_rows(spark, sf).select(document.alias("value")).write.options(**PACKED).text(path)

    return _written(spark, sf, "aws-json", write)


AZURE_NAMES = [
    "UsageDate", "Cost", "AmortizedCost", "UsageQuantity", "MeterCategory", "Meter", "ResourceId",
    "ResourceLocation", "SubscriptionId", "UnitOfMeasure", "Currency", "ChargeType", "Tags", "ReservationId",
]


def azure_json_lines(spark, sf) -> str:
    """One query result per line; every other one lists its columns in the opposite order."""
    kinds = F.when(F.col("charge_category") == "usage", "Usage").when(
        F.col("charge_category") == "adjustment", "Adjustment"
    ).otherwise("Refund")
    raw = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    numbers = [F.date_format("usage_date", "yyyyMMdd"), raw(F.col("billed_cost")), raw(F.col("effective_cost")), raw(F.col("usage_quantity"))]
    texts = [
        F.col("service_name"), F.col("sku_id"), F.col("resource_id"), F.col("region_id"), F.col("billing_account_id"),
        F.lit("unit"), F.col("currency"), kinds, F.to_json("tags"), F.col("commitment_discount_id"),
    ]
    columns = json.dumps([{"name": name, "type": "String"} for name in AZURE_NAMES])
    reverse = json.dumps([{"name": name, "type": "String"} for name in AZURE_NAMES[::-1]])
    even = F.col("seq") % 2 == 0

    def write(path):
        # The texts of a row are written to JSON once, with a bracket at each end.
        ordered = F.to_json(F.when(even, F.array(*texts)).otherwise(F.array(*texts[::-1])))
        rows = with_once(_own(spark, sf, "azure"), "texts", ordered)
        inner = F.expr("substring(texts, 2, length(texts) - 2)")
        line = F.concat(
            F.lit('{"properties":{"columns":'), F.when(even, columns).otherwise(reverse), F.lit(',"rows":[['),
            F.when(even, F.concat_ws(",", *numbers, inner)).otherwise(F.concat_ws(",", inner, *numbers[::-1])), F.lit("]]}}"),
        )
        rows.select(line.alias("value")).write.options(**PACKED).text(path)

    return _written(spark, sf, "azure-json", write)


def gcp_rows(spark, sf) -> DataFrame:
    labels = F.transform(
        F.array_sort(F.map_entries("tags")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))
    )
    sign = F.when(F.col("charge_category") == "credit", F.lit(-1)).otherwise(F.lit(1))
    return _own(spark, sf, "gcp").select(
        F.col("billing_account_id"),
        F.col("service_name").alias("service.description"),
        F.col("sku_id").alias("sku.id"),
        F.col("charge_description").alias("sku.description"),
        stamp().alias("usage_start_time"),
        stamp(F.lit(14)).alias("usage_end_time"),
        F.col("region_id").alias("location.location"),
        F.col("resource_id").alias("resource.name"),
        F.lit("").alias("resource.global_name"),
        F.col("usage_quantity").cast("string").alias("usage.amount"),
        F.lit("unit").alias("usage.unit"),
        (F.col("billed_cost") * sign).cast("decimal(18,6)").cast("string").alias("cost"),
        F.col("currency"),
        (F.col("effective_cost") - F.col("billed_cost")).cast("decimal(18,6)").cast("string").alias("credits.amount"),
        F.col("commitment_discount_id").alias("credits.name"),
        F.to_json(labels).alias("labels"),
    )


def gcp_csv(spark, sf) -> str:
    def write(path):
        gcp_rows(spark, sf).write.options(**PACKED).option("header", True).option("escape", '"').csv(path)

    return _written(spark, sf, "gcp-csv", write)


def evidence_items(spark, sf, kind: str, frame: DataFrame) -> str:
    """``{"items": [...]}`` documents with one item per line; ``frame`` has the column ``item``."""

    def write(path):
        frame.select(F.concat(F.lit('{"items":['), F.col("item"), F.lit("]}")).alias("value")).write.options(**PACKED).text(path)

    return _written(spark, sf, f"items-{kind}", write)
