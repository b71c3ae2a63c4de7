"""Cost and evidence tables derived from the given benchmark tables.

Billing lines come from ``lineitem`` with its parts, suppliers and nations; metrics and
audit events come from ``events`` stretched over both compared periods.
"""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendshift.functions.classify import service_category
from spendshift.periods import Period
from spendshift.schemas import MONEY, conform, COST

# Ship dates are moved by 27 years, so the compared periods lie where billing rules are dated.
SHIFT_MONTHS = 324
BASELINE = Period(date(2024, 7, 1), date(2024, 12, 31))
CURRENT = Period(date(2025, 1, 1), date(2025, 6, 30))
SHIPPED = ("1997-07-01", "1998-07-01")
AS_OF = date(2026, 9, 1)

PART_TYPES = ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"]
SERVICES = {
    "aws": ["Amazon Elastic Compute Cloud", "Amazon Virtual Private Cloud",
            "Amazon Relational Database Service", "Amazon Bedrock", "AWS Data Transfer",
            "AmazonCloudWatch"],
    "azure": ["Virtual Machines", "Azure Functions", "SQL Database", "Cognitive Services",
              "Bandwidth", "Storage"],
    "gcp": ["Compute Engine", "Cloud Translation API", "Cloud SQL", "Vertex AI", "Networking",
            "BigQuery"],
}
METRICS = {
    "aws": {"view": "CPUUtilization", "click": "BytesOutToDestination",
            "purchase": "DatabaseConnections", "signup": "Invocations", "error": "NetworkOut"},
    "azure": {"view": "Percentage CPU", "click": "FunctionExecutionCount",
              "purchase": "connection_successful", "signup": "TokenTransaction", "error": "Egress"},
    "gcp": {"view": "compute.googleapis.com/instance/cpu/utilization", "click": "request_count",
            "purchase": "database/network/connections", "signup": "token_count",
            "error": "nat/sent_bytes_count"},
}
AUDIT_NAMES = {
    "aws": {"error": "DeleteVpcEndpoint", "signup": "RunInstances", "view": "DescribeInstances",
            "click": "StartInstances", "purchase": "PurchaseSavingsPlan"},
    "azure": {"error": "Microsoft.Web/sites/restart", "signup": "publish", "view": "Microsoft.Compute/virtualMachines/read",
              "click": "Microsoft.Compute/virtualMachines/start", "purchase": "Microsoft.Capacity/orders/purchase"},
    "gcp": {"error": "TranslateText", "signup": "compute.instances.insert", "view": "compute.instances.get",
            "click": "compute.instances.start", "purchase": "compute.commitments.create"},
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def data_stamp(spark: SparkSession, sf: str) -> tuple:
    """Names, sizes and times of the files in a folder: what a kept result depends on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))


def provider_of(number: Column) -> Column:
    rest = number % 3
    return F.when(rest == 0, "aws").when(rest == 1, "azure").otherwise("gcp")


def _lookup(names: dict[str, dict[str, str]], provider: Column, item: Column) -> Column:
    chain = F
    for owner, mapping in names.items():
        for key, value in mapping.items():
            chain = chain.when((provider == owner) & (item == key), F.lit(value))
    return chain.otherwise(F.lit(None).cast("string"))


def text_number(number: Column) -> Column:
    return number.cast("string")


def service_names(spark: SparkSession) -> DataFrame:
    """Service and category of each (provider, part type); categorised once per name."""
    pairs = [
        (owner, kind, name) for owner, names in SERVICES.items() for kind, name in zip(PART_TYPES, names)
    ]
    columns = dict(zip(("line_provider", "p_type", "listed_service"), map(list, zip(*pairs))))
    named = spark.createDataFrame(pa.table(columns))
    return named.withColumn("listed_category", service_category(F.col("listed_service")))


def cost_rows(spark: SparkSession, sf: str, *, lines: DataFrame | None = None) -> DataFrame:
    """One cost row per ``lineitem`` row, in the fixed cost schema."""
    wanted = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = (table(spark, sf, "lineitem") if lines is None else lines).select(*wanted)
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .join(nations, suppliers.s_nationkey == nations.n_nationkey)
        .withColumn("line_provider", provider_of(F.col("l_suppkey")))
        .join(service_names(spark), ["line_provider", "p_type"], "left")
    )
    provider = F.col("line_provider")
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    resource = (
        F.when(part % 10 == 0, None)
        .when(part % 2 == 1, F.concat(F.lit("res-"), text_number(supplier)))
        .otherwise(F.concat(F.lit("res-p"), text_number(part)))
    )
    owner_tags = F.when(
        supplier % 7 == 0, F.create_map(F.lit("env"), F.col("l_linestatus"))
    ).otherwise(
        F.create_map(F.lit("env"), F.col("l_linestatus"), F.lit("owner"), F.col("s_name"))
    )
    columns = {
        "provider": provider,
        "billing_account_id": F.concat(F.lit("acct-"), text_number(F.col("n_nationkey"))),
        "usage_date": F.add_months(F.col("l_shipdate").cast("date"), SHIFT_MONTHS),
        "service_name": F.col("listed_service"),
        "service_category": F.col("listed_category"),
        "charge_category": F.when(F.col("l_returnflag") == "N", "usage")
        .when(F.col("l_returnflag") == "A", "adjustment")
        .otherwise("credit"),
        "charge_description": F.col("p_name"),
        "region_id": F.when(F.col("n_nationkey") != 7, F.col("n_name")),
        "resource_id": resource,
        "resource_name": F.when(resource.isNotNull() & (part % 3 > 0), F.col("p_name")),
        "sku_id": F.when(
            (provider == "aws") & (F.col("p_type") == "ECONOMY"), F.lit("NatGateway-Bytes")
        ).otherwise(F.col("p_brand")),
        "usage_quantity": F.col("l_quantity").cast(MONEY),
        "usage_unit": F.lit("unit"),
        "billed_cost": price.cast(MONEY),
        "effective_cost": (price * (F.lit(1) - discount)).cast(MONEY),
        "currency": F.lit("USD"),
        "tags": owner_tags,
        "commitment_discount_id": F.when(
            F.col("l_tax") >= 0.07, F.concat(F.lit("cd-"), text_number(supplier % 5))
        ),
        "source_record_id": F.concat_ws(
            "-", text_number(F.col("l_orderkey")), text_number(F.col("l_linenumber"))
        ),
        "seq": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
    }
    return conform(joined.select(*[column.alias(name) for name, column in columns.items()]), COST)


def scoped_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Cost rows in the default investigated scope (usage, purchase and adjustment).

    The periods are also put on the ship date itself, which the Parquet scan can prune by.
    """
    from spendshift.operators.filters import scope

    first, end = (F.lit(day).cast("timestamp_ntz") for day in SHIPPED)
    lines = table(spark, sf, "lineitem").filter((F.col("l_shipdate") >= first) & (F.col("l_shipdate") < end))
    return scope(cost_rows(spark, sf, lines=lines), periods=[CURRENT, BASELINE])


def _stretched(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a time that spans both periods: each January day becomes twelve days."""
    offset = F.datediff(F.col("ts").cast("date"), F.lit(date(2024, 1, 1)))
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    day = F.date_add(F.lit(BASELINE.start), (offset * 12).cast("int"))
    stamp = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(day)) + seconds)
    return table(spark, sf, "events").withColumn("event_time", stamp)


def metric_points(spark: SparkSession, sf: str) -> DataFrame:
    """Daily metric points per resource and metric, one row per point."""
    provider = provider_of(F.col("user_id"))
    return (
        _stretched(spark, sf)
        .withColumn("provider", provider)
        .withColumn("metric_name", _lookup(METRICS, F.col("provider"), F.col("event_type")))
        .groupBy(
            "provider",
            F.concat(F.lit("res-"), F.col("user_id").cast("string")).alias("resource_id"),
            "metric_name",
            F.to_date("event_time").alias("point_date"),
        )
        .agg(F.sum(F.col("value").cast(MONEY)).cast(MONEY).alias("value"), F.min("event_id").alias("seq"))
        .withColumn("unit", F.lit("Count"))
        .withColumn("statistic", F.lit("Sum"))
    )


def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    return (
        _stretched(spark, sf)
        .select(
            provider_of(user).alias("provider"),
            F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
            _lookup(AUDIT_NAMES, provider_of(user), F.col("event_type")).alias("event_name"),
            "event_time",
            F.lit("audit-log").alias("source"),
            F.concat(F.lit("user-"), user.cast("string")).alias("actor"),
            F.lit("user").alias("actor_type"),
            F.lit(None).cast("string").alias("region_id"),
            F.lit(None).cast("string").alias("source_ip"),
            F.lit(None).cast("string").alias("source_location"),
            F.array(
                F.concat(F.lit("res-"), user.cast("string")),
                F.concat(F.lit("res-"), (user + 3).cast("string")),
            ).alias("resource_ids"),
            F.col("props").alias("summary"),
            F.col("event_id").alias("seq"),
        )
    )


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Resources: one per part, and one per supplier; every fifth is listed twice."""
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("n"),
        F.concat(F.lit("res-p"), F.col("p_partkey").cast("string")).alias("resource_id"),
        F.col("p_name").alias("resource_name"),
        F.col("p_type").alias("resource_type"),
        (F.col("p_size") % 4).alias("state_number"),
        F.col("p_brand").alias("owner"),
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("n"),
        F.concat(F.lit("res-"), F.col("s_suppkey").cast("string")).alias("resource_id"),
        F.col("s_name").alias("resource_name"),
        F.lit("SHARED").alias("resource_type"),
        (F.col("s_nationkey") % 4).alias("state_number"),
        F.col("s_name").alias("owner"),
    )
    both = parts.unionByName(suppliers)
    copies = F.when(F.col("n") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return both.withColumn("copy", F.explode(copies)).select(
        provider_of(F.col("n")).alias("provider"),
        "resource_id",
        "resource_name",
        "resource_type",
        F.lit(None).cast("string").alias("region_id"),
        F.when(F.col("copy") == 1, "deleted")
        .when(F.col("state_number") == 0, "stopped")
        .otherwise("running")
        .alias("state"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.when(F.col("n") % 4 == 0, F.create_map(F.lit("owner"), F.col("owner")))
        .otherwise(F.create_map(F.lit("tier"), F.col("owner")))
        .alias("tags"),
        F.lit(None).cast("map<string,string>").alias("attributes"),
        (F.col("n") * 2 + F.col("copy")).alias("seq"),
    )


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """A savings recommendation per part, aimed at the part or at its supplier number."""
    part = F.col("p_partkey")
    return (
        table(spark, sf, "part")
        .select(
            provider_of(part).alias("provider"),
            F.concat(F.lit("rec-"), part.cast("string")).alias("recommendation_id"),
            F.lit("advisor").alias("source"),
            F.lower("p_type").alias("category"),
            F.concat(F.lit("res-"), F.when(part % 2 == 0, F.lit("p")).otherwise(F.lit("")),
                     part.cast("string")).alias("resource_id"),
            F.col("p_name").alias("description"),
            (F.col("p_retailprice").cast("decimal(18,2)") / 100).cast("decimal(18,4)").cast("double")
            .alias("estimated_monthly_savings"),
            F.lit("USD").alias("currency"),
            part.alias("seq"),
        )
    )


def provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Source provenance per (provider, kind), dated from the data itself."""
    costs = (
        cost_rows(spark, sf)
        .groupBy("provider")
        .agg(F.max("usage_date").alias("last"))
        .withColumn("kind", F.lit("cost"))
    )
    audits = (
        audit_rows(spark, sf)
        .groupBy("provider")
        .agg(F.max(F.to_date("event_time")).alias("last"))
        .withColumn("kind", F.lit("audit"))
    )
    metrics = (
        metric_points(spark, sf)
        .groupBy("provider")
        .agg(F.max("point_date").alias("last"))
        .withColumn("kind", F.lit("metrics"))
    )
    both = costs.unionByName(audits).unionByName(metrics)
    end = F.to_timestamp("last") + F.expr("interval '23:59:59' hour to second")
    return both.select(
        "provider",
        "kind",
        F.concat(F.col("provider"), F.lit("-"), F.col("kind"), F.lit("-export")).alias("source"),
        F.lit("1.0").alias("schema_version"),
        end.alias("observed_at"),
        end.alias("retrieved_at"),
        end.alias("data_through"),
        F.when(F.col("kind") == "cost", "upload").otherwise("fixture").alias("origin"),
        F.when(F.col("kind") == "cost", F.concat(F.lit("query-"), F.col("provider")))
        .otherwise(F.lit(""))
        .alias("query_reference"),
    )
