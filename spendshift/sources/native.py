"""Native billing exports to cost rows.

Readers keep every native value as text, so nothing is inferred; one ``select`` per
provider turns the text into the fixed cost schema. Columns that are absent read as null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendshift.functions import parsing as P
from spendshift.functions.classify import (
    AWS_CHARGE_TYPES,
    AZURE_CHARGE_TYPES,
    charge_category,
    charge_category_by_sign,
    service_category,
)
from spendshift.functions.money import net_of_credits
from spendshift.operators.coverage import FOCUS_VERSION, require_focus_version
from spendshift.periods import Period, in_any
from spendshift.schemas import COST
from spendshift.session import settle, with_once
from spendshift.sources.json_elements import LARGE_FILE
from spendshift.sources.landing import first_lines, json_lists, json_values, row_order, small

AWS_COLUMNS = [
    "identity_line_item_id", "bill_payer_account_id", "line_item_usage_account_id",
    "line_item_usage_start_date", "line_item_line_item_type", "line_item_product_code",
    "product_servicename", "product_region_code", "line_item_resource_id", "resource_tags_user_name",
    "line_item_usage_type", "product_sku", "line_item_line_item_description", "line_item_usage_amount",
    "pricing_unit", "line_item_unblended_cost", "line_item_net_amortized_cost",
    "line_item_currency_code", "resource_tags", "savings_plan_savings_plan_a_r_n",
]
GCP_COLUMNS = [
    "billing_account_id", "service.description", "sku.id", "sku.description", "usage_start_time",
    "usage_end_time", "project.id", "location.location", "resource.name", "resource.global_name",
    "usage.amount", "usage.unit", "cost", "currency", "credits.amount", "credits.name", "labels",
]


def _texts(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType(), True) for name in names])


def _col(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


# ------------------------------------------------------------------ readers


def _places(names: Column, columns: Sequence[str]) -> Column:
    """Where each wanted column stands among the names (from 0, -1: nowhere); of equal names the last counts."""
    turned = F.reverse(names)
    found = [F.array_position(turned, name) for name in columns]
    return F.array(*[F.when(at > 0, F.size(names) - at).otherwise(-1).cast("int") for at in found])


def _split_table(lines: DataFrame) -> DataFrame:
    """Per split of a file: its filled lines, the number of its first one, and lines with an open quote."""
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return settle(
        lines.groupBy("source_file", "split").agg(
            F.count(F.lit(1)).alias("lines"), F.min("row").alias("first_row"),
            F.max((odd % 2).cast("int")).alias("odd"),
        )
    )


def _joined_lines(lines: DataFrame) -> DataFrame:
    """Records of files with line breaks inside quotes: lines are joined until their quotes are even.

    A file is worked through in one task here; the parity of a line follows from all lines before it.
    """
    in_file = Window.partitionBy("source_file").orderBy("split", "row")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = F.coalesce(F.sum(quotes).over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = lines.withColumn("starts", (before % 2 == 0).cast("int"))
    told = told.withColumn("record", F.sum("starts").over(in_file))
    pieces = F.sort_array(F.collect_list(F.struct("split", "row", "value")))
    records = told.groupBy("source_file", "record").agg(pieces.alias("pieces")).select(
        "source_file", F.col("pieces")[0]["split"].alias("split"), F.col("pieces")[0]["row"].alias("row"),
        F.array_join(F.transform("pieces", lambda piece: piece["value"]), "\n").alias("value"),
    )
    return records.filter(F.trim("value") != "").withColumn("row_number", F.row_number().over(in_file).cast("bigint") - 1)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of CSV rows as text, by each file's own header, with file, order and row number.

    One plan for any number of files and headers: the lines are scanned once, joined with a table of
    splits (where each wanted column stands in the file's header, how many lines come before), and
    parsed by position. No list of files or headers goes through the driver. Files with line
    breaks inside quotes take a second branch that joins their lines.
    """
    texts = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split")
    )
    numbered = lambda lines: lines.withColumn("row", F.monotonically_increasing_id())
    lines = numbered(texts.filter(F.trim("value") != ""))
    splits = _split_table(lines)
    headers = first_lines(lines, splits).select("source_file", F.regexp_replace("value", "^\ufeff", "").alias("header"))
    files = splits.groupBy("source_file").agg((F.max("odd") > 0).alias("open"))
    files = settle(files.join(headers, "source_file").select("source_file", "header", "open"))
    told = files.agg(F.max(F.size(F.split("header", ","))).alias("width"), F.coalesce(F.max("open"), F.lit(False)).alias("open")).first()
    generic = ", ".join(f"c{n} string" for n in range(told["width"] or 1))

    def fields(text: str) -> Column:
        parsed = F.from_csv(text, generic, {"escape": '"'})
        return F.transform(F.array(parsed), lambda row: F.array(*[row[f"c{n}"] for n in range(told["width"] or 1)]))[0]

    # Headers are few beside the files: each is parsed once.
    headers = files.select("header").distinct().select("header", _places(fields("header"), columns).alias("places"))
    placed = files.join(headers, "header").select("source_file", "open", "places")
    in_order = Window.partitionBy("source_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counted = splits.withColumn("before", F.coalesce(F.sum("lines").over(in_order), F.lit(0)))
    starts = settle(
        counted.join(placed, "source_file").select("source_file", "split", (F.col("before") - F.col("first_row")).alias("shift"), "open", "places")
    )
    rows = lines.join(small(starts), ["source_file", "split"]).filter(~F.col("open")).select(
        "value", "source_file", "split", "row", (F.col("row") + F.col("shift")).alias("row_number"), "places"
    )
    if told["open"]:
        few = small(settle(placed.filter("open").select("source_file", "places")))
        whole = _joined_lines(numbered(texts.join(few.select("source_file"), "source_file"))).join(few, "source_file")
        rows = rows.unionByName(whole.select(*rows.columns))
    # Row 0 is the header.
    data = with_once(rows.filter("row_number > 0"), "fields", fields("value"))
    return data.select(
        *[F.get("fields", F.col("places")[n]).alias(name) for n, name in enumerate(columns)], "source_file",
        row_order("split", "row").alias("seq"), "row_number",
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    names = [F.col(f"`{name}`") for name in rows.columns]
    told = rows.select(*names, F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("__row"))
    return told.select(*names, "source_file", row_order("__row").alias("seq"), (F.col("__row") + 1).alias("row_number"))


def read_json_rows(spark: SparkSession, path: str, columns: Sequence[str], large: int = LARGE_FILE) -> DataFrame:
    """Rows of ``{"rows": []}``, ``{"items": []}`` or bare-array values; non-objects drop out.

    A list in a file of more than ``large`` bytes is read by several tasks.
    """
    lists = json_lists(spark, path, large)
    values = json_values(spark, path, lists)
    held = F.from_json("value", "struct<rows:array<string>,items:array<string>>")
    listed = with_once(values, "held", held)
    filled = F.when(F.size("held.rows") > 0, F.col("held.rows")).when(F.size("held.items") > 0, F.col("held.items"))
    bare = F.col("held.rows").isNull() & F.col("held.items").isNull()
    entries = (
        F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>"))
        .when(bare, F.array("value")).otherwise(filled)
    )
    exploded = listed.select("source_file", "line", F.posexplode(entries).alias("position", "entry"))
    if lists is not None:
        exploded = exploded.unionByName(lists)
    objects = exploded.filter(F.startswith(F.ltrim(F.col("entry")), F.lit("{")))
    parsed = with_once(objects, "r", F.from_json("entry", _texts(columns)))
    return parsed.select(
        *[F.col(f"r.`{name}`").alias(name) for name in columns],
        "source_file", "line", "position", row_order("line", "position").alias("seq"),
    )


def read_azure(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Cost Management query results: column names and positional values per row."""
    fields = T.StructType(
        [
            T.StructField("columns", T.ArrayType(_texts(["name", "type"]))),
            T.StructField("rows", T.ArrayType(T.StringType())),
        ]
    )
    schema = T.StructType([T.StructField("properties", fields), *fields.fields])
    documents = with_once(json_values(spark, path), "d", F.from_json("value", schema))
    both = documents.select(
        "source_file",
        "line",
        F.coalesce("d.properties.columns", "d.columns").alias("columns"),
        F.coalesce("d.properties.rows", "d.rows").alias("rows"),
    )
    entries = both.select(
        "source_file", "line",
        F.col("columns.name").alias("names"),
        F.posexplode("rows").alias("position", "entry"),
    )
    return with_once(entries, "values", F.from_json("entry", "array<string>")).select(
        "source_file", "line", "position", "names", "values", row_order("line", "position").alias("seq"),
    )


def file_position(rows: DataFrame) -> Column:
    """File name and place in it: the same after every read of the same file, and unique in a folder."""
    parts = [F.substring_index("source_file", "/", -1)]
    parts += [F.col(name).cast("string") for name in ("line", "position", "row_number") if name in rows.columns]
    return F.concat_ws("-", *parts)


# ------------------------------------------------------------------ normalisation


AZURE_COLUMNS = [
    "UsageDate", "Cost", "CostUSD", "AmortizedCost", "UsageQuantity", "MeterCategory", "ServiceName", "Meter", "MeterSubCategory", "ResourceId",
    "ResourceLocation", "SubscriptionId", "UnitOfMeasure", "Currency", "ChargeType", "Tags", "ReservationId",
]


def _rows(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    position = [name for name in ("seq", "source_file", "line", "position", "row_number") if name in rows.columns]
    named = rows.select(*[c.alias(name) for name, c in columns.items()], *position)
    full = named.withColumn("service_category", service_category(F.col("service_name")))
    extra = [name for name in ("start_text", "end_text", *position) if name not in COST.names]
    # The order of landed rows is a struct until the rollup numbers its rows.
    return full.select(*[F.col(f.name) if f.name == "seq" else F.col(f.name).cast(f.dataType).alias(f.name) for f in COST.fields], *extra)


def aws_costs(rows: DataFrame) -> DataFrame:
    """Data Exports / CUR 2.0 rows to cost rows."""

    def c(name: str) -> Column:
        return _col(rows, name)

    resource = P.first_filled(c("line_item_resource_id"))
    unblended = P.amount(c("line_item_unblended_cost"))
    columns = {
        "provider": F.lit("aws"),
        "billing_account_id": P.first_filled(
            c("line_item_usage_account_id"), c("bill_payer_account_id"), default="unknown"
        ),
        "usage_date": P.flexible_date(c("line_item_usage_start_date")),
        "service_name": P.first_filled(
            c("product_servicename"), c("line_item_product_code"), default="unknown"
        ),
        "charge_category": charge_category(c("line_item_line_item_type"), AWS_CHARGE_TYPES),
        "charge_description": F.coalesce(c("line_item_line_item_description"), F.lit("")),
        "region_id": P.first_filled(c("product_region_code")),
        "resource_id": resource,
        "resource_name": P.first_filled(c("resource_tags_user_name"), P.resource_name_from_id(resource)),
        "sku_id": P.first_filled(c("line_item_usage_type"), c("product_sku")),
        "usage_quantity": P.amount(c("line_item_usage_amount")),
        "usage_unit": P.first_filled(c("pricing_unit"), default="unit"),
        "billed_cost": unblended,
        "effective_cost": P.amount(c("line_item_net_amortized_cost"), unblended),
        "currency": P.first_filled(c("line_item_currency_code"), default="USD"),
        "tags": P.tags(c("resource_tags")),
        "commitment_discount_id": P.first_filled(c("savings_plan_savings_plan_a_r_n")),
        "source_record_id": P.first_filled(
            c("identity_line_item_id"), F.concat(F.lit("aws-row-"), file_position(rows))
        ),
        "start_text": c("line_item_usage_start_date"),
        "end_text": F.lit(None).cast("string"),
    }
    return _rows(rows, columns)


def azure_costs(rows: DataFrame) -> DataFrame:
    """Cost Management rows to cost rows; the column names decide, not their order."""

    # Each wanted value is looked up by its name once a row.
    places = [F.array_position("names", name).cast("int") for name in AZURE_COLUMNS]
    picked = F.array(*[F.try_element_at("values", F.nullif(place, F.lit(0))) for place in places])
    rows = with_once(rows, "picked", picked)

    def c(name: str) -> Column:
        return F.get("picked", F.lit(AZURE_COLUMNS.index(name)))

    resource = P.first_filled(c("ResourceId"))
    cost = P.amount(c("Cost"), P.amount(c("CostUSD")))
    columns = {
        "provider": F.lit("azure"),
        "billing_account_id": P.first_filled(c("SubscriptionId"), default="unknown"),
        "usage_date": P.flexible_date(c("UsageDate")),
        "service_name": P.first_filled(c("MeterCategory"), c("ServiceName"), default="unknown"),
        "charge_category": charge_category(c("ChargeType"), AZURE_CHARGE_TYPES),
        "charge_description": P.first_filled(c("Meter"), c("MeterSubCategory"), default=""),
        "region_id": P.first_filled(c("ResourceLocation")),
        "resource_id": resource,
        "resource_name": P.resource_name_from_id(resource),
        "sku_id": P.first_filled(c("Meter")),
        "usage_quantity": P.amount(c("UsageQuantity")),
        "usage_unit": P.first_filled(c("UnitOfMeasure"), default="unit"),
        "billed_cost": cost,
        "effective_cost": P.amount(c("AmortizedCost"), cost),
        "currency": P.first_filled(c("Currency"), default="USD"),
        "tags": P.tags(c("Tags")),
        "commitment_discount_id": P.first_filled(c("ReservationId")),
        "source_record_id": F.concat(F.lit("azure-row-"), file_position(rows)),
        "start_text": c("UsageDate"),
        "end_text": F.lit(None).cast("string"),
    }
    return _rows(rows, columns)


def gcp_costs(rows: DataFrame) -> DataFrame:
    """BigQuery billing export rows (dotted column names) to cost rows; credits are added."""

    def c(name: str) -> Column:
        return _col(rows, name)

    resource = P.first_filled(c("resource.global_name"), c("resource.name"))
    cost = P.amount(c("cost"))
    columns = {
        "provider": F.lit("gcp"),
        "billing_account_id": P.first_filled(c("billing_account_id"), default="unknown"),
        "usage_date": P.flexible_date(c("usage_start_time")),
        "service_name": P.first_filled(c("service.description"), default="unknown"),
        "charge_category": charge_category_by_sign(cost),
        "charge_description": F.coalesce(c("sku.description"), F.lit("")),
        "region_id": P.first_filled(c("location.location")),
        "resource_id": resource,
        "resource_name": P.resource_name_from_id(resource),
        "sku_id": P.first_filled(c("sku.id"), c("sku.description")),
        "usage_quantity": P.amount(c("usage.amount")),
        "usage_unit": P.first_filled(c("usage.unit"), default="unit"),
        "billed_cost": cost,
        "effective_cost": net_of_credits(cost, P.amount(c("credits.amount"))),
        "currency": P.first_filled(c("currency"), default="USD"),
        "tags": P.tags(c("labels")),
        "commitment_discount_id": P.first_filled(c("credits.name")),
        "source_record_id": F.concat(F.lit("gcp-row-"), file_position(rows)),
        "start_text": c("usage_start_time"),
        "end_text": c("usage_end_time"),
    }
    return _rows(rows, columns)


def native_costs(spark: SparkSession, path: str, detected_format: str) -> DataFrame:
    """Cost rows of one export whose format is known, with their source position.

    How JSON values lie in the files is found from their content, never assumed.
    """
    if detected_format == "azure-cost-management-json":
        return azure_costs(read_azure(spark, path))
    provider, container = detected_format.split("-")[0], detected_format.split("-")[-1]
    columns, normalise = (
        (AWS_COLUMNS, aws_costs) if provider == "aws" else (GCP_COLUMNS, gcp_costs)
    )
    if container == "json":
        return normalise(read_json_rows(spark, path, columns))
    return normalise(read_csv(spark, path, columns) if container == "csv" else read_parquet(spark, path))


# ------------------------------------------------------------------ stored costs and the FOCUS projection


def read_costs(spark: SparkSession, path: str, periods: Sequence[Period] = ()) -> DataFrame:
    """Stored cost rows of the periods; a store laid out by month is read for their months only."""
    costs = spark.read.parquet(path)
    if not periods:
        return costs.drop("month")
    if "month" in costs.columns:
        months = [Period(period.start.replace(day=1), period.end) for period in periods]
        costs = costs.filter(in_any(months, F.col("month"))).drop("month")
    return costs.filter(in_any(list(periods), F.col("usage_date")))


def focus_rows(costs: DataFrame, version: str = FOCUS_VERSION) -> DataFrame:
    """The 22-column FOCUS projection of cost rows."""
    require_focus_version(version)
    day = F.col("usage_date")
    return costs.select(
        F.col("provider").alias("ProviderName"),
        F.col("billing_account_id").alias("BillingAccountId"),
        F.to_timestamp(day).alias("ChargePeriodStart"),
        F.to_timestamp(F.date_add(day, 1)).alias("ChargePeriodEnd"),
        F.trunc(day, "month").alias("BillingPeriodStart"),
        F.last_day(day).alias("BillingPeriodEnd"),
        F.col("service_name").alias("ServiceName"),
        F.col("service_category").alias("ServiceCategory"),
        F.initcap("charge_category").alias("ChargeCategory"),
        F.col("charge_description").alias("ChargeDescription"),
        F.col("region_id").alias("RegionId"),
        F.col("resource_id").alias("ResourceId"),
        F.col("resource_name").alias("ResourceName"),
        F.col("sku_id").alias("SkuId"),
        F.col("usage_quantity").alias("ConsumedQuantity"),
        F.col("usage_unit").alias("ConsumedUnit"),
        F.col("billed_cost").alias("BilledCost"),
        F.col("effective_cost").alias("EffectiveCost"),
        F.col("currency").alias("BillingCurrency"),
        F.col("tags").alias("Tags"),
        F.col("commitment_discount_id").alias("CommitmentDiscountId"),
        F.lit(version).alias("FocusVersion"),
    )
