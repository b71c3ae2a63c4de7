"""Billing rules and playbooks as small tables.

``data/rules.jsonl`` and ``data/playbooks.jsonl`` hold fixed values, one row per line in
load order; users pass their own tables of the same shape. The packaged ones enter plans
as local relations, so Spark knows their size and broadcasts them by its own threshold.
"""

from __future__ import annotations

import json
from datetime import date
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_S, _D, _L = T.StringType(), T.DateType(), T.ArrayType(T.StringType())


def _schema(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RULES = _schema([
    ("id", _S), ("provider", _S), ("rule_type", _S), ("service", _S), ("valid_from", _D), ("valid_to", _D),
    ("reviewed_at", _D), ("confidence", _S), ("matches_categories", _L), ("matches_services", _L),
    ("cost_drivers", _L), ("investigation_checks", _L), ("schema_version", _S), ("source_url", _S),
    ("source_updated_at", _D), ("data", _S), ("seq", T.IntegerType()),
])

PLAYBOOKS = _schema([
    ("provider", _S), ("category", _S), ("priority", T.IntegerType()), ("max_confidence", T.DoubleType()),
    ("risk", _S), ("rule_type", _S), ("service_patterns", _L), ("sku_patterns", _L),
    ("resource_type_patterns", _L), ("metric_names", _L), ("audit_event_patterns", _L),
    ("low_utilization_metrics", _L), ("low_utilization_threshold", T.DoubleType()),
    ("requires_new_spend", T.BooleanType()), ("requires_quantity_growth", T.BooleanType()),
    ("requires_rate_change", T.BooleanType()), ("requires_missing_owner", T.BooleanType()),
    ("root_cause", _S), ("recommendation", _S), ("seq", T.IntegerType()),
])

# Root-cause and recommendation wording per category, shared by the providers.
WORDING = {
    "nat_gateway_misroute": (
        "Gateway {resource} in {region} has processed far more traffic since {spike_date}; a route "
        "change is the likely reason that private traffic now crosses the gateway",
        "Check recent route table edits and put back the private endpoint for storage traffic.",
    ),
    "ai_inference": (
        "Inference usage of {service} has grown since {spike_date}, worth {increase}",
        "Confirm that the new call volume is wanted; look for retries and consider caching.",
    ),
    "pricing_change": (
        "The cost of {key} rose while its usage stayed level, so the rate paid has changed",
        "Compare the unit cost with a dated price list and check commitment coverage.",
    ),
    "idle_compute": (
        "Instance {resource} in {region} is billed but close to idle since {spike_date}",
        "Ask the owner whether the instance is needed, then stop or resize it.",
    ),
    "unattached_storage": (
        "Volume {resource} in {region} is billed without reads or writes since {spike_date}",
        "Take a snapshot if the data matters, then remove the unused volume.",
    ),
    "idle_database": (
        "Database {resource} in {region} is billed with almost no connections since {spike_date}",
        "Confirm that nothing depends on it, then stop or downsize the database.",
    ),
    "kubernetes_autoscaling": (
        "The node pool behind {resource} has grown since {spike_date}, adding {increase}",
        "Review the scaling limits and the pending workloads that hold nodes up.",
    ),
    "cross_region_transfer": (
        "Data transfer on {service} has grown since {spike_date}, adding {increase}",
        "Find the new traffic path and keep the traffic inside one region where possible.",
    ),
    "commitment_change": (
        "Commitment coverage of {service} changed, which moved {increase} to other rates",
        "Compare commitment coverage of both periods before buying or changing anything.",
    ),
    "untagged_resources": (
        "{key} grew by {increase} and carries no owner tag, so nobody is answerable for it",
        "Find the owner and add the owner tags the organisation requires.",
    ),
    "functions_retry_loop": (
        "Function app {resource} has run far more often since {spike_date}, as failing calls that "
        "are retried would show",
        "Inspect the latest deployment and the failing calls, and bound the retries.",
    ),
    "api_key_abuse": (
        "Calls to {service} have jumped since {spike_date} in a way a leaked key would cause",
        "Restrict or rotate the key and check the callers' addresses in the audit log.",
    ),
}
FALLBACK_CATEGORY = "unexplained_increase"
FALLBACK_WORDING = (
    "{key} costs clearly more, but no known pattern explains it; the increase is measured, its "
    "mechanism is not",
    "Review the resource or service by hand: the increase is certain, its cause is not.",
)
FALLBACK_CAP = 0.4


def _lines(name: str) -> list[dict]:
    text = resources.files("spendshift.data").joinpath(name).read_text(encoding="utf-8")
    return [json.loads(line) for line in text.splitlines() if line.strip()]


def _local(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    columns = list(zip(*rows))
    arrow_schema = to_arrow_schema(schema)
    arrays = [pa.array(values, type=f.type) for values, f in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.table(arrays, schema=arrow_schema), schema)


def _day(value: str | None) -> date | None:
    return date.fromisoformat(value) if value else None


def rule_rows(records: list[dict]) -> list[tuple]:
    """Rule records as rows of the rule schema, numbered in load order."""
    days = {"valid_from", "valid_to", "reviewed_at", "source_updated_at"}
    lists = {"matches_categories", "matches_services", "cost_drivers", "investigation_checks"}
    rows = []
    for seq, record in enumerate(records):
        row = []
        for field in RULES.names[:-1]:
            value = record.get(field)
            if field in days:
                value = _day(value)
            elif field in lists:
                value = value or []
            elif field == "data":
                value = json.dumps(value or {})
            row.append(value)
        rows.append((*row, seq))
    return rows


def billing_rules(spark: SparkSession, extra: list[dict] | None = None) -> DataFrame:
    """The packaged rules, optionally followed by extra rule records."""
    return _local(spark, rule_rows(_lines("rules.jsonl") + (extra or [])), RULES)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A user's rule table (JSON lines with a ``seq`` column); duplicate ids are refused."""
    rules = spark.read.schema(RULES).json(path, mode="FAILFAST")
    refuse_duplicate_rules(rules)
    return rules


def duplicate_rules(rules: DataFrame) -> DataFrame:
    return rules.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def refuse_duplicate_rules(rules: DataFrame) -> None:
    repeated = [row.id for row in duplicate_rules(rules).orderBy("id").limit(5).collect()]
    if repeated:
        raise ValueError(f"duplicate rule ids: {', '.join(repeated)}")


def playbooks(spark: SparkSession, extra: list[dict] | None = None) -> DataFrame:
    """The packaged playbooks of all providers in declaration order."""
    rows = []
    for seq, record in enumerate(_lines("playbooks.jsonl") + (extra or [])):
        root_cause, recommendation = WORDING.get(record["category"], FALLBACK_WORDING)
        full = {"root_cause": root_cause, "recommendation": recommendation, "seq": seq, **record}
        rows.append(tuple(full[name] for name in PLAYBOOKS.names))
    return _local(spark, rows, PLAYBOOKS)
