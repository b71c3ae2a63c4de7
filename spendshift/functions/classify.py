"""Service categories, charge categories, grouping keys and owners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendshift.functions.parsing import first_filled

# The keyword lists and their order decide the published category.
SERVICE_CATEGORIES = [
    ("Networking", ["nat gateway", "virtual private cloud", "vpc", "cloud nat", "load balanc", "cdn",
                    "front door", "data transfer", "networking", "bandwidth", "cloud interconnect",
                    "expressroute"]),
    ("Compute", ["ec2", "compute engine", "virtual machines", "app service", "lambda", "functions",
                 "cloud run", "fargate", "container", "kubernetes", "aks", "eks", "gke"]),
    ("Storage", ["s3", "simple storage", "ebs", "elastic block", "blob", "cloud storage", "filestore",
                 "snapshot", "managed disks", "efs", "backup"]),
    ("Databases", ["rds", "aurora", "dynamodb", "cosmos", "sql database", "cloud sql", "bigtable",
                   "spanner", "redis", "cache", "database"]),
    ("AI and Machine Learning", ["bedrock", "sagemaker", "vertex ai", "openai", "cognitive",
                                 "translation", "ai platform", "machine learning"]),
    ("Analytics", ["bigquery", "athena", "synapse", "dataflow", "kinesis", "event hubs", "pub/sub",
                   "analytics"]),
    ("Management and Governance", ["cloudwatch", "monitor", "logging", "cloudtrail", "config",
                                   "advisor", "trusted advisor", "management"]),
    ("Security", ["kms", "secrets manager", "key vault", "iam", "guardduty", "defender", "security"]),
]

# Native charge types and the charge category each one maps to.
AWS_CHARGE_TYPES = {
    "usage": "usage",
    "discountedusage": "usage",
    "savingsplancoverednusage": "usage",
    "savingsplancoveredusage": "usage",
    "savingsplanrecurringfee": "purchase",
    "ripurchase": "purchase",
    "fee": "purchase",
    "tax": "tax",
    "credit": "credit",
    "refund": "credit",
    "savingsplannegation": "adjustment",
    "edpdiscount": "adjustment",
}
AZURE_CHARGE_TYPES = {
    "usage": "usage",
    "purchase": "purchase",
    "tax": "tax",
    "refund": "credit",
    "unusedreservation": "usage",
    "adjustment": "adjustment",
}

# Tag keys that name an owner, in the order they are tried.
GROUPING_OWNER_KEYS = ("owner", "Owner", "team", "Team")
OWNER_KEYS = ("owner", "Owner", "team", "Team", "cost-center", "costCenter")

DIMENSIONS = ("service", "region", "account", "resource", "tag_owner")


def service_category(service_name: Column) -> Column:
    lowered = F.lower(service_name)
    chain = F
    for category, keywords in SERVICE_CATEGORIES:
        hits = [F.contains(lowered, F.lit(keyword)) for keyword in keywords]
        chain = chain.when(reduce(Column.__or__, hits), F.lit(category))
    return chain.otherwise(F.lit("Other"))


def charge_category(charge_type: Column, known: dict[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(item) for pair in known.items() for item in pair])
    lowered = F.lower(F.coalesce(F.nullif(charge_type, F.lit("")), F.lit("usage")))
    return F.coalesce(F.try_element_at(lookup, lowered), F.lit("unknown"))


def charge_category_by_sign(cost: Column) -> Column:
    return F.when(cost >= 0, F.lit("usage")).otherwise(F.lit("credit"))


def resource_key(resource_id: Column, service_name: Column) -> Column:
    return F.coalesce(
        F.nullif(resource_id, F.lit("")), F.concat(service_name, F.lit("::untagged-aggregate"))
    )


def owner_tag(tags: Column) -> Column:
    return first_filled(
        *[F.try_element_at(tags, F.lit(key)) for key in GROUPING_OWNER_KEYS], default="untagged"
    )


def dimension_key(dimension: str) -> Column:
    """Grouping key of a cost row; a resource row without a resource id has none."""
    keys = {
        "service": F.col("service_name"),
        "region": first_filled(F.col("region_id"), default="unknown-region"),
        "account": F.col("billing_account_id"),
        "resource": F.col("resource_id"),
        "tag_owner": owner_tag(F.col("tags")),
    }
    return keys[dimension]


def has_owner(tags: Column, overlay: Column) -> Column:
    """Any owner key filled once the overlay's tags replace the first map's."""
    merged = F.map_concat(F.coalesce(tags, F.create_map().cast("map<string,string>")),
                          F.coalesce(overlay, F.create_map().cast("map<string,string>")))
    filled = [F.coalesce(F.try_element_at(merged, F.lit(key)), F.lit("")) != "" for key in OWNER_KEYS]
    hit = F.lit(False)
    for column in filled:
        hit = hit | column
    return hit


def contains_any(value: Column, patterns: Column) -> Column:
    """Case-insensitive: does the value contain one of the patterns?"""
    lowered = F.lower(value)
    return F.coalesce(
        F.exists(patterns, lambda pattern: F.contains(lowered, F.lower(pattern))), F.lit(False)
    ) & (F.coalesce(value, F.lit("")) != "")


def reconciled_origin(origin: Column, is_fixture: Column) -> tuple[Column, Column]:
    """The (origin, is_fixture) pair with the origin winning over the older flag."""
    derived = F.when(is_fixture, F.lit("fixture")).when(~is_fixture, F.lit("live"))
    return F.coalesce(origin, derived), F.when(origin.isNotNull(), origin == "fixture").otherwise(is_fixture)


def provenance_reference(query_reference: Column, provider: Column, source: Column) -> Column:
    return F.coalesce(F.nullif(query_reference, F.lit("")), F.concat_ws(":", provider, source))
