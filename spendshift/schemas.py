"""Table schemas. Every evidence table carries ``provider`` and a deterministic ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 6)
# Totals keep 16 integer digits and leave Spark enough scale for exact quotients.
TOTAL = T.DecimalType(22, 6)

PROVIDERS = ("aws", "azure", "gcp")
STRING_MAP = T.MapType(T.StringType(), T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _TS, _D = T.StringType(), T.TimestampType(), T.DateType()

COST = _struct(
    provider=_S,
    billing_account_id=_S,
    usage_date=_D,
    service_name=_S,
    service_category=_S,
    charge_category=_S,
    charge_description=_S,
    region_id=_S,
    resource_id=_S,
    resource_name=_S,
    sku_id=_S,
    usage_quantity=MONEY,
    usage_unit=_S,
    billed_cost=MONEY,
    effective_cost=MONEY,
    currency=_S,
    tags=STRING_MAP,
    commitment_discount_id=_S,
    source_record_id=_S,
    seq=T.LongType(),
)

INVENTORY = _struct(
    provider=_S,
    resource_id=_S,
    resource_name=_S,
    resource_type=_S,
    region_id=_S,
    state=_S,
    created_at=_TS,
    tags=STRING_MAP,
    attributes=STRING_MAP,
)

POINT = _struct(timestamp=_TS, value=T.DoubleType())
METRICS = _struct(
    provider=_S,
    resource_id=_S,
    metric_name=_S,
    unit=_S,
    statistic=_S,
    points=T.ArrayType(POINT),
)

AUDIT = _struct(
    provider=_S,
    event_id=_S,
    event_name=_S,
    event_time=_TS,
    source=_S,
    actor=_S,
    actor_type=_S,
    region_id=_S,
    source_ip=_S,
    source_location=_S,
    resource_ids=T.ArrayType(_S),
    summary=_S,
    attributes=STRING_MAP,
)

RECOMMENDATIONS = _struct(
    provider=_S,
    recommendation_id=_S,
    source=_S,
    category=_S,
    resource_id=_S,
    description=_S,
    estimated_monthly_savings=T.DoubleType(),
    currency=_S,
)

PROVENANCE = _struct(
    provider=_S,
    kind=_S,
    source=_S,
    schema_version=_S,
    observed_at=_TS,
    retrieved_at=_TS,
    data_through=_TS,
    origin=_S,
    query_reference=_S,
)

EVIDENCE_SCHEMAS = {
    "metrics": METRICS,
    "audit": AUDIT,
    "inventory": INVENTORY,
    "recommendations": RECOMMENDATIONS,
}

# Fields an evidence item must carry, and the value an absent optional field takes.
REQUIRED_FIELDS = {
    "metrics": ("resource_id", "metric_name"),
    "audit": ("event_id", "event_name", "event_time", "source"),
    "inventory": ("resource_id", "resource_type"),
    "recommendations": ("recommendation_id", "source", "category"),
}
DEFAULTS = {
    "metrics": {"unit": "Count", "statistic": "Sum"},
    "audit": {"actor_type": "unknown", "summary": ""},
    "inventory": {"state": "unknown"},
    "recommendations": {"description": "", "estimated_monthly_savings": 0.0, "currency": "USD"},
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a schema: cast what is there, null for what is not."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{field.name}`") if field.name in present else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in schema.fields
        ]
    )
