"""Registered source, quarantine, coverage and store queries."""

from __future__ import annotations

import contextlib
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendshift.functions import classify, parsing, text
from spendshift.operators import coverage, rollup
from spendshift.plans.ingest import ingest_costs
from spendshift.schemas import PROVIDERS
from spendshift.session import scratch_path
from spendshift.sources import landing, native, store
from spendshift.sources.snapshots import SnapshotStore, slot_key
from spendshift.workloads import exports
from spendshift.workloads.oracle import (
    BASE, COSTS, CUR, EVIDENCE, category_case, with_,
)
from spendshift.workloads.registry import query
from spendshift.workloads.views import BASELINE, CURRENT, audit_rows, cost_rows, metric_points, provenance, table

TAGS = "concat_ws('|', 'env=' || tag_env, 'owner=' || tag_owner)"
NATIVE = [
    "billing_account_id", "usage_date", "service_name", "service_category", "charge_category", "region_id",
    "resource_id", "resource_name", "sku_id", "usage_quantity", "usage_unit", "billed_cost", "effective_cost",
    "currency", "tags", "commitment_discount_id",
]


def _native_sql(provider: str, billed="billed_cost", effective="effective_cost", charge="charge_category",
                name="coalesce(resource_name, resource_id)", extra="") -> str:
    return with_(COSTS) + f"""
SELECT billing_account_id, strftime(usage_date, '%Y-%m-%d') AS usage_date, service_name,
  {category_case('service_name')} AS service_category, {charge} AS charge_category, region_id, resource_id,
  {name} AS resource_name, sku_id, CAST(usage_quantity AS DOUBLE) AS usage_quantity, usage_unit,
  CAST({billed} AS DOUBLE) AS billed_cost, CAST({effective} AS DOUBLE) AS effective_cost, currency, {TAGS} AS tags,
  commitment_discount_id{extra} FROM costs WHERE provider = '{provider}'"""


@query("s1_aws_export_csv", _native_sql("aws", extra=", source_record_id"))
def s1(spark, sf):
    return native.native_costs(spark, exports.aws_csv(spark, sf), "aws-cur-csv").select(*NATIVE, "source_record_id")


@query("s6_aws_export_json", _native_sql("aws", extra=", source_record_id"))
def s6(spark, sf):
    path = exports.aws_json_lines(spark, sf)
    return native.native_costs(spark, path, "aws-cur-json").select(*NATIVE, "source_record_id")


@query("s2_azure_query_result", _native_sql("azure", name="resource_id"))
def s2(spark, sf):
    path = exports.azure_json_lines(spark, sf)
    return native.native_costs(spark, path, "azure-cost-management-json").select(*NATIVE)


_SIGN = "CASE WHEN charge_category = 'credit' THEN -1 ELSE 1 END"


@query("s3_gcp_export_csv", _native_sql(
    "gcp", billed=f"billed_cost * ({_SIGN})", effective=f"billed_cost * ({_SIGN}) + effective_cost - billed_cost",
    charge="CASE WHEN charge_category = 'credit' AND billed_cost > 0 THEN 'credit' ELSE 'usage' END", name="resource_id"))
def s3(spark, sf):
    return native.native_costs(spark, exports.gcp_csv(spark, sf), "gcp-billing-export-csv").select(*NATIVE)


@query("p8_gcp_credits", with_(COSTS) + f"""
SELECT usage_unit, count(*) AS lines, CAST(sum(billed_cost * ({_SIGN})) AS DOUBLE) AS billed_cost,
  CAST(sum(billed_cost * ({_SIGN}) + effective_cost - billed_cost) AS DOUBLE) AS effective_cost FROM costs WHERE provider = 'gcp' GROUP BY ALL""")
def p8(spark, sf):
    rows = native.native_costs(spark, exports.gcp_csv(spark, sf), "gcp-billing-export-csv")
    return rows.groupBy("usage_unit").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("billed_cost").alias("billed_cost"), F.sum("effective_cost").alias("effective_cost")
    )


# ------------------------------------------------------------------ evidence items

_AUDIT_ITEM = """
CASE WHEN seq % 11 = 0 THEN 'not_an_object' WHEN seq % 7 = 0 THEN 'schema_mismatch' END"""


def _audit_path(spark, sf) -> str:
    """Audit events as items: some are bare strings, some carry a bad time or an unknown field."""
    rows = audit_rows(spark, sf)
    good = F.to_json(F.struct(
        F.lit("someone-else").alias("provider"), "event_id", "event_name",
        F.when(F.col("seq") % 7 == 0, F.lit("yesterday")).otherwise(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("event_time"),
        "source", "actor", "resource_ids", "summary",
        F.when(F.col("seq") % 14 == 0, F.lit("x")).alias("surprise"),
    ))
    item = F.when(F.col("seq") % 11 == 0, F.lit('"loose text"')).otherwise(good)
    return exports.evidence_items(spark, sf, "audit", rows.select(item.alias("item")))


@query("s4_audit_items", with_(COSTS, EVIDENCE) + f"""
SELECT 'aws' AS provider, event_id, event_name, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, actor,
  'unknown' AS actor_type, r1 || '|' || r2 AS resource_ids, summary FROM audit WHERE {_AUDIT_ITEM} IS NULL""")
def s4(spark, sf):
    items = landing.read_items(spark, _audit_path(spark, sf))
    usable, _ = landing.evidence_items(items, "aws", "audit")
    return usable.select(
        "provider", "event_id", "event_name", "event_time", "actor", "actor_type", "resource_ids", "summary"
    )


@query("s8_evidence_quarantine", with_(COSTS, EVIDENCE) + f"""
SELECT code, detail, count(*) AS items FROM (SELECT {_AUDIT_ITEM} AS code,
  CASE WHEN seq % 11 = 0 THEN 'entries must be objects' WHEN seq % 14 = 0
    THEN 'invalid or missing fields: event_time (invalid), surprise (unexpected)' ELSE 'invalid or missing fields: event_time (invalid)' END AS detail
  FROM audit) WHERE code IS NOT NULL GROUP BY ALL""")
def s8(spark, sf):
    items = landing.read_items(spark, _audit_path(spark, sf))
    _, rejected = landing.evidence_items(items, "aws", "audit")
    return rejected.groupBy("code", "detail").agg(F.count(F.lit(1)).alias("items"))


# ------------------------------------------------------------------ detection and refusal


@query("s5_format_detection", with_(COSTS) + """
SELECT * FROM (VALUES ('aws-cur-csv', 'aws'), ('aws-cur-json', 'aws'), ('azure-cost-management-json', 'azure'), ('gcp-billing-export-csv', 'gcp'))
  v(detected_format, provider) JOIN (SELECT provider, count(*) AS rows FROM costs GROUP BY provider) USING (provider)""")
def s5(spark, sf):
    """Formats found in the landed folders, with the rows they hold."""
    paths = [exports.aws_csv(spark, sf), exports.aws_json_lines(spark, sf), exports.azure_json_lines(spark, sf), exports.gcp_csv(spark, sf)]
    detected = None
    for path in paths:
        lines = landing.read_lines(spark, path)
        found = landing.detect_formats(lines)
        counts = lines.filter(F.trim("value") != "").groupBy("source_file").agg(F.count(F.lit(1)).alias("lines"))
        part = found.join(counts, "source_file").select("detected_format", (
            F.col("lines") - F.when(F.endswith("detected_format", F.lit("csv")), 1).otherwise(0)).alias("rows"))
        detected = part if detected is None else detected.unionByName(part)
    return detected.groupBy(F.substring_index("detected_format", "-", 1).alias("provider"), "detected_format").agg(
        F.sum("rows").alias("rows"))


_MARKS = ", ".join(f"'{m}'" for m in text.CREDENTIAL_MARKERS)


@query("s16_credential_scan", f"""
WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 7 = 0 THEN ' {{"Client_Secret": 1}}' ELSE '' END
  || CASE WHEN doc_id % 11 = 0 THEN ' PRIVATE_KEY_ID=' ELSE '' END AS text FROM documents),
h AS (SELECT doc_id, list_filter([{_MARKS}], lambda m: contains(lower(text), m)) AS markers FROM t)
SELECT doc_id, array_to_string(markers, '|') AS markers FROM h WHERE len(markers) > 0""")
def s16(spark, sf):
    """Whole document texts, some of them with a credential field planted at the end."""
    planted = F.concat(
        "text", F.when(F.col("doc_id") % 7 == 0, ' {"Client_Secret": 1}').otherwise(""),
        F.when(F.col("doc_id") % 11 == 0, " PRIVATE_KEY_ID=").otherwise(""),
    )
    hits = table(spark, sf, "documents").select("doc_id", text.credential_markers(planted).alias("markers"))
    return hits.filter(F.size("markers") > 0)


@query("s17_currency_mix", with_(COSTS) + """
SELECT provider, billing_account_id, array_to_string(list_sort(list_distinct(list(c) FILTER (c <> ''))), '|') AS currencies,
  count(DISTINCT c) FILTER (c <> '') > 1 AS is_mixed, coalesce(min(c) FILTER (c <> ''), 'USD') AS currency FROM (
  SELECT *, CASE WHEN billing_account_id IN ('acct-3', 'acct-4') AND seq % 9 = 0 THEN 'EUR' WHEN seq % 10 = 0 THEN '' ELSE currency END AS c FROM costs)
GROUP BY ALL""")
def s17(spark, sf):
    mixed = cost_rows(spark, sf).withColumn(
        "currency",
        F.when(F.col("billing_account_id").isin("acct-3", "acct-4") & (F.col("seq") % 9 == 0), "EUR")
        .when(F.col("seq") % 10 == 0, "").otherwise(F.col("currency")),
    )
    return coverage.currencies(mixed, ["provider", "billing_account_id"])


_VERSION = "CASE WHEN kind = 'audit' THEN '3.0' WHEN provider = 'azure' THEN '2023-11-01' ELSE '1.0' END"


@query("s15_unsupported_versions", with_(COSTS, EVIDENCE) + f"""
SELECT provider, kind, version AS schema_version FROM (SELECT *, {_VERSION} AS version FROM provenance)
WHERE NOT ((provider = 'aws' AND version IN ('1', '1.0', '2.0')) OR (provider = 'azure' AND version IN ('1', '1.0', '2023-11-01'))
  OR (provider = 'gcp' AND version IN ('1', '1.0')))""")
def s15(spark, sf):
    versioned = provenance(spark, sf).withColumn(
        "schema_version",
        F.when(F.col("kind") == "audit", "3.0").when(F.col("provider") == "azure", "2023-11-01").otherwise("1.0"),
    )
    return coverage.unsupported_sources(versioned).select("provider", "kind", "schema_version")


# ------------------------------------------------------------------ quarantine and rollup


def _spoiled(spark, sf):
    """Cost rows where some have lost their service, their amounts or their date."""
    zero = F.lit(0).cast("decimal(18,6)")
    emptied = F.col("seq") % 13 == 0
    rows = cost_rows(spark, sf).withColumn(
        "service_name", F.when(F.col("seq") % 17 == 0, "unknown").otherwise(F.col("service_name"))
    ).withColumn("usage_date", F.when(F.col("seq") % 19 != 0, F.col("usage_date")))
    for name in ("billed_cost", "effective_cost", "usage_quantity"):
        rows = rows.withColumn(name, F.when(emptied, zero).otherwise(F.col(name)))
    return rows


@query("s7_row_quarantine", with_(COSTS) + """
SELECT provider, CASE WHEN seq % 19 = 0 THEN 'bad_date' WHEN seq % 17 = 0 THEN 'missing_service' WHEN seq % 13 = 0 THEN 'empty_row' END AS code,
  count(*) AS rows, min(seq) AS first_seq FROM costs WHERE seq % 19 = 0 OR seq % 17 = 0 OR seq % 13 = 0 GROUP BY ALL""")
def s7(spark, sf):
    _, rejected = rollup.quarantine(_spoiled(spark, sf))
    return rejected.groupBy("provider", "code").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"))


_KEYS = "provider, billing_account_id, usage_date, service_name, sku_id, region_id, resource_id, charge_category, currency, tag_env, tag_owner"
ROLLED = f"""
rolled AS (
  SELECT {_KEYS}, sum(usage_quantity) AS usage_quantity, sum(billed_cost) AS billed_cost, sum(effective_cost) AS effective_cost,
    min(seq) AS seq, arg_min(resource_name, {{'s': seq, 'v': resource_name}}) FILTER (resource_name IS NOT NULL) AS resource_name,
    arg_min(commitment_discount_id, {{'s': seq, 'v': commitment_discount_id}}) FILTER (commitment_discount_id IS NOT NULL) AS commitment_discount_id
  FROM costs GROUP BY {_KEYS})"""


@query("a1_daily_rollup", with_(COSTS, ROLLED) + f"""
SELECT provider, billing_account_id, strftime(usage_date, '%Y-%m-%d') AS usage_date, service_name, sku_id, region_id, resource_id,
  charge_category, {TAGS} AS tags, CAST(usage_quantity AS DOUBLE) AS usage_quantity, CAST(billed_cost AS DOUBLE) AS billed_cost,
  CAST(effective_cost AS DOUBLE) AS effective_cost, seq, resource_name, commitment_discount_id FROM rolled""")
def a1(spark, sf):
    return rollup.daily_rollup(cost_rows(spark, sf)).select(
        "provider", "billing_account_id", "usage_date", "service_name", "sku_id", "region_id", "resource_id",
        "charge_category", "tags", "usage_quantity", "billed_cost", "effective_cost", "seq", "resource_name",
        "commitment_discount_id",
    )


@query("w5_record_ids", with_(COSTS, ROLLED) + f"""
, numbered AS (SELECT *, row_number() OVER (ORDER BY usage_date, service_name, coalesce(resource_id, service_name || '::untagged-aggregate'),
  seq, provider, billing_account_id, sku_id, region_id NULLS FIRST, charge_category, tag_env, tag_owner NULLS FIRST) - 1 AS n FROM rolled)
SELECT 'upload-' || strftime(usage_date, '%Y-%m-%d') || '-' || CASE WHEN n < 1000000 THEN lpad(CAST(n AS VARCHAR), 6, '0') ELSE CAST(n AS VARCHAR) END AS source_record_id,
  service_name, resource_id, seq, CAST(billed_cost AS DOUBLE) AS billed_cost FROM numbered""")
def w5(spark, sf):
    # What neither the order nor the result reads is not sorted and checkpointed along.
    rolled = rollup.daily_rollup(cost_rows(spark, sf)).select(*rollup.ROLLUP_KEYS, "tags", "seq", "source_record_id", "billed_cost")
    rows = rollup.with_record_ids(rolled)
    return rows.select("source_record_id", "service_name", "resource_id", "seq", "billed_cost")


# ------------------------------------------------------------------ data through


@query("a24_aws_data_through", with_(COSTS) + """,
own AS (SELECT usage_date, seq % 24 AS h FROM costs WHERE provider = 'aws'),
days AS (SELECT usage_date, count(DISTINCT h) AS hours FROM own GROUP BY usage_date ORDER BY usage_date DESC LIMIT 2),
l AS (SELECT max(usage_date) AS last_date, arg_max(hours, usage_date) AS last_hours, min(usage_date) AS earlier FROM days)
SELECT strftime(last_date, '%Y-%m-%d') AS last_date, last_hours, last_hours < 24 AS is_partial,
  strftime(CASE WHEN last_hours < 24 THEN earlier ELSE last_date END, '%Y-%m-%d') || ' 23:59:59' AS data_through FROM l""")
def a24(spark, sf):
    return coverage.aws_data_through(native.native_costs(spark, exports.aws_csv(spark, sf), "aws-cur-csv"))


@query("a25_gcp_data_through", with_(COSTS) + """,
l AS (SELECT max(usage_date) AS last_date FROM costs WHERE provider = 'gcp'),
e AS (SELECT max(usage_date) AS earlier FROM costs, l WHERE provider = 'gcp' AND usage_date < last_date)
SELECT strftime(last_date, '%Y-%m-%d') AS last_date, strftime(last_date, '%Y-%m-%d') || ' 14:00:00' AS latest_end, true AS is_partial,
  strftime(earlier, '%Y-%m-%d') || ' 23:59:59' AS data_through FROM l, e""")
def a25(spark, sf):
    return coverage.gcp_data_through(native.native_costs(spark, exports.gcp_csv(spark, sf), "gcp-billing-export-csv"))


@query("a26_azure_data_through", with_(COSTS) + """
SELECT strftime(max(usage_date), '%Y-%m-%d') AS last_date, false AS is_partial,
  strftime(max(usage_date), '%Y-%m-%d') || ' 23:59:59' AS data_through FROM costs WHERE provider = 'azure'""")
def a26(spark, sf):
    path = exports.azure_json_lines(spark, sf)
    rows = native.native_costs(spark, path, "azure-cost-management-json")
    return coverage.azure_data_through(rows).drop("note")


# ------------------------------------------------------------------ provenance


@query("s9_source_provenance", with_(COSTS, EVIDENCE) + """
SELECT c.provider, c.lines, p.source, strftime(p.data_through, '%Y-%m-%d %H:%M:%S') AS data_through, p.origin
FROM (SELECT provider, count(*) AS lines FROM costs GROUP BY provider) c JOIN provenance p ON p.provider = c.provider AND p.kind = 'cost'""")
def s9(spark, sf):
    lines = cost_rows(spark, sf).groupBy("provider").agg(F.count(F.lit(1)).alias("lines")).withColumn("kind", F.lit("cost"))
    return lines.join(provenance(spark, sf), ["provider", "kind"]).select("provider", "lines", "source", "data_through", "origin")


@query("s10_absent_sources", with_(COSTS, EVIDENCE) + """
SELECT g.provider, k.kind, p.provider IS NOT NULL AS is_present, coalesce(p.source, 'absent-' || k.kind) AS source,
  coalesce(strftime(p.data_through, '%Y-%m-%d %H:%M:%S'), '2026-01-01 00:00:00') AS data_through, coalesce(p.origin, 'upload') AS origin
FROM (SELECT DISTINCT provider FROM provenance) g CROSS JOIN (VALUES ('cost'), ('metrics'), ('audit'), ('inventory'), ('recommendations')) k(kind)
LEFT JOIN provenance p ON p.provider = g.provider AND p.kind = k.kind""")
def s10(spark, sf):
    full = coverage.with_all_kinds(provenance(spark, sf), F.lit("2026-01-01").cast("timestamp"))
    return full.select("provider", "kind", "is_present", "source", "data_through", "origin")


@query("c10_data_freshness", with_(COSTS, EVIDENCE) + """
SELECT provider, kind, source, strftime(data_through, '%Y-%m-%d %H:%M:%S') AS data_through, origin, origin = 'fixture' AS is_fixture,
  '1.0' AS schema_version, CASE WHEN query_reference <> '' THEN query_reference ELSE provider || ':' || source END AS query_reference FROM provenance""")
def c10(spark, sf):
    return coverage.freshness_table(provenance(spark, sf)).select(
        "provider", "kind", "source", "data_through", "origin", "is_fixture", "schema_version", "query_reference"
    )


@query("p28_provenance_reference", with_(COSTS, EVIDENCE) + """
SELECT provider, kind, CASE WHEN query_reference <> '' THEN query_reference ELSE provider || ':' || source END AS reference FROM provenance""")
def p28(spark, sf):
    reference = classify.provenance_reference(F.col("query_reference"), F.col("provider"), F.col("source"))
    return provenance(spark, sf).select("provider", "kind", reference.alias("reference"))


@query("p27_origin_flag", with_(COSTS) + """
SELECT provider, coalesce(o, CASE WHEN f THEN 'fixture' WHEN NOT f THEN 'live' END) AS origin,
  CASE WHEN o IS NOT NULL THEN o = 'fixture' ELSE f END AS is_fixture, count(*) AS rows FROM (
  SELECT provider, CASE seq % 4 WHEN 0 THEN 'upload' WHEN 1 THEN 'fixture' END AS o, CASE seq % 3 WHEN 0 THEN true WHEN 1 THEN false END AS f FROM costs)
GROUP BY ALL""")
def p27(spark, sf):
    seq = F.col("seq")
    origin, flag = classify.reconciled_origin(
        F.when(seq % 4 == 0, "upload").when(seq % 4 == 1, "fixture"),
        F.when(seq % 3 == 0, True).when(seq % 3 == 1, False),
    )
    return cost_rows(spark, sf).groupBy("provider", origin.alias("origin"), flag.alias("is_fixture")).agg(
        F.count(F.lit(1)).alias("rows"))


@query("u2_distinct_sources", with_(COSTS) + """
SELECT provider, billing_account_id AS source, strftime(usage_date, '%Y-%m-%d') AS data_through, min(seq) AS seq FROM costs GROUP BY ALL""")
def u2(spark, sf):
    from spendshift.operators.findings import distinct_sources

    sources = cost_rows(spark, sf).select(
        "provider", F.col("billing_account_id").alias("source"), F.col("usage_date").alias("data_through"), "seq")
    return distinct_sources(sources)


# ------------------------------------------------------------------ store

_SOURCES = """
sources AS (
  SELECT billing_account_id AS dataset_id, provider, 'cost' AS kind, count(*) AS stored_rows, min(usage_date) AS period_start,
    max(usage_date) AS period_end, CAST(max(usage_date) AS TIMESTAMP) AS data_through, sum(length(source_record_id)) AS byte_size FROM costs GROUP BY ALL
  UNION ALL
  SELECT 'acct-' || substr(resource_id, 5, 1), provider, 'metrics', count(*), min(point_date), max(point_date), CAST(max(point_date) AS TIMESTAMP),
    sum(length(metric_name)) FROM points GROUP BY ALL)"""


def _sources(spark, sf):
    """One row per (dataset, provider, kind): accounts as datasets of cost, resources as datasets of metrics."""
    costs = cost_rows(spark, sf).groupBy(F.col("billing_account_id").alias("dataset_id"), "provider").agg(
        F.count(F.lit(1)).alias("stored_rows"), F.min("usage_date").alias("period_start"), F.max("usage_date").alias("period_end"),
        F.max("usage_date").cast("timestamp").alias("data_through"), F.sum(F.length("source_record_id")).alias("byte_size"),
    ).withColumn("kind", F.lit("cost"))
    metrics = metric_points(spark, sf).groupBy(
        F.concat(F.lit("acct-"), F.substring("resource_id", 5, 1)).alias("dataset_id"), "provider"
    ).agg(
        F.count(F.lit(1)).alias("stored_rows"), F.min("point_date").alias("period_start"), F.max("point_date").alias("period_end"),
        F.max("point_date").cast("timestamp").alias("data_through"), F.sum(F.length("metric_name")).alias("byte_size"),
    ).withColumn("kind", F.lit("metrics"))
    return costs.unionByName(metrics)


@query("k1_slot_replace", with_(COSTS) + """
SELECT provider, count(*) AS rows, CAST(sum(billed_cost) AS DOUBLE) AS billed_cost FROM costs GROUP BY provider""")
def k1(spark, sf):
    """Ingest every provider, then ingest one again: its slot is replaced and never counted twice."""
    path = scratch_path(spark, "store")
    costs = cost_rows(spark, sf)
    store.replace_slot(costs, path, "d1", "cost")
    store.replace_slot(costs.filter(F.col("provider") == "aws"), path, "d1", "cost")
    stored = store.read_slots(spark, path, "d1")
    return stored.groupBy("provider").agg(F.count(F.lit(1)).alias("rows"), F.sum("billed_cost").alias("billed_cost"))


@query("k1_atomic_slot_replace", with_(COSTS) + """
SELECT provider, count(*) AS rows, CAST(sum(billed_cost) AS DOUBLE) AS billed_cost FROM costs GROUP BY provider""")
def k1_atomic(spark, sf):
    """The same on versioned snapshots; a write of one slot that fails in the middle changes nothing."""
    snapshots = SnapshotStore(spark, scratch_path(spark, "snapshots"))
    # Seven writes read these rows; their parts and suppliers are looked up (and broadcast) once.
    landed = scratch_path(spark, "landed")
    cost_rows(spark, sf).write.parquet(landed)
    costs = spark.read.parquet(landed)
    for provider in PROVIDERS:
        snapshots.replace(slot_key("d1", provider, "cost"), costs.filter((F.col("provider") == provider) & (F.col("seq") % 2 == 0)))
    for provider in PROVIDERS:
        snapshots.replace(slot_key("d1", provider, "cost"), costs.filter(F.col("provider") == provider))
    spoiled = costs.withColumn("provider", F.when(F.col("seq") % 7 == 3, F.raise_error(F.lit("broken row"))).otherwise(F.col("provider")))
    with contextlib.suppress(PySparkException, Py4JJavaError):
        snapshots.replace(slot_key("d1", "aws", "cost"), spoiled)
    now = snapshots.version()
    stored = reduce(DataFrame.unionByName, [snapshots.read(key, now) for key in snapshots.keys(now)])
    return stored.groupBy("provider").agg(F.count(F.lit(1)).alias("rows"), F.sum("billed_cost").alias("billed_cost"))


@query("s12_period_pruned_scan", with_(COSTS) + f"""
SELECT strftime(usage_date, '%Y-%m') AS month, count(*) AS rows, CAST(sum(effective_cost) AS DOUBLE) AS effective_cost
FROM costs WHERE ({CUR}) OR ({BASE}) GROUP BY ALL""")
def s12(spark, sf):
    """A store laid out by month, read for the two periods only."""
    path = scratch_path(spark, "by-month")
    store.write_by_month(cost_rows(spark, sf), path)
    rows = native.read_costs(spark, path, [CURRENT, BASELINE])
    return rows.groupBy(F.date_format("usage_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("effective_cost").alias("effective_cost"))


@query("k2_ingest_report", with_(COSTS) + """,
kept AS (SELECT * FROM costs WHERE seq % 19 <> 0 AND seq % 17 <> 0 AND seq % 13 <> 0),
rolled AS (SELECT provider, usage_date FROM kept GROUP BY provider, billing_account_id, usage_date, service_name, sku_id, region_id, resource_id,
  charge_category, currency, tag_env, tag_owner)
SELECT c.provider, raw_rows, accepted_rows, raw_rows - accepted_rows AS rejected_rows, stored_rows, strftime(a, '%Y-%m-%d') AS period_start,
  strftime(b, '%Y-%m-%d') AS period_end, 'USD' AS currencies
FROM (SELECT provider, count(*) AS raw_rows FROM costs GROUP BY 1) c JOIN (SELECT provider, count(*) AS accepted_rows FROM kept GROUP BY 1) k USING (provider)
JOIN (SELECT provider, count(*) AS stored_rows, min(usage_date) AS a, max(usage_date) AS b FROM rolled GROUP BY 1) r USING (provider)""")
def k2(spark, sf):
    rows = _spoiled(spark, sf)
    usable, rejected = rollup.quarantine(rows)
    return store.ingest_report(rows, rejected, rollup.daily_rollup(usable))


@query("k2_first_rejections", with_(COSTS) + """
SELECT seq, provider, CASE WHEN seq % 19 = 0 THEN 'bad_date' WHEN seq % 17 = 0 THEN 'missing_service' ELSE 'empty_row' END AS code
FROM costs WHERE seq % 19 = 0 OR seq % 17 = 0 OR seq % 13 = 0 ORDER BY seq, provider, code LIMIT 50""")
def k2_rejections(spark, sf):
    _, rejected = rollup.quarantine(_spoiled(spark, sf))
    return store.reported_rejections(rejected, "seq", "provider", "code").select("seq", "provider", "code")


@query("k3_sealable_datasets", with_(COSTS, EVIDENCE, _SOURCES) + """
SELECT DISTINCT dataset_id FROM sources WHERE kind = 'cost' AND stored_rows > 0""")
def k3(spark, sf):
    return store.sealable(_sources(spark, sf))


@query("k9_live_datasets", with_(COSTS, EVIDENCE, _SOURCES) + f"""
SELECT dataset_id, provider, kind FROM sources WHERE data_through + INTERVAL '7200' SECOND > TIMESTAMP '2028-10-20 00:00:00'""")
def k9(spark, sf):
    dated = _sources(spark, sf).withColumn("expires_at", F.col("data_through") + F.expr("interval 7200 seconds"))
    return store.live_datasets(dated, F.lit("2028-10-20").cast("timestamp")).select("dataset_id", "provider", "kind")


@query("k9_expired_slots", with_(COSTS) + """
SELECT 'd1/' || provider || '/cost' AS slot, count(*) AS rows FROM costs GROUP BY provider HAVING provider <> 'azure'""")
def k9_expired(spark, sf):
    """Slots of a store after one has expired; its files are gone from the disk as well."""
    snapshots = SnapshotStore(spark, scratch_path(spark, "expiring"))
    costs = cost_rows(spark, sf)
    for provider in PROVIDERS:
        snapshots.replace(slot_key("d1", provider, "cost"), costs.filter(F.col("provider") == provider))
    snapshots.expire({slot_key("d1", "azure", "cost"): 100.0, slot_key("d1", "aws", "cost"): 101.0}, now=100.0)
    snapshots.vacuum(versions=1, grace=0)
    now = snapshots.version()
    return reduce(DataFrame.unionByName, [
        snapshots.read(key, now).groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(key).alias("slot"), "rows") for key in snapshots.keys(now)
    ])


@query("k10_store_totals", with_(COSTS, EVIDENCE, _SOURCES) + """
SELECT CAST(sum(byte_size) AS BIGINT) AS total_bytes, count(DISTINCT dataset_id) AS datasets,
  CAST(sum(byte_size) FILTER (dataset_id <> 'acct-3') AS BIGINT) AS other_bytes, max(stored_rows) AS largest_source FROM sources""")
def k10(spark, sf):
    return store.store_totals(_sources(spark, sf), excluding="acct-3")


_SUMMARY = """
summary AS (SELECT dataset_id, array_to_string(coalesce(list_sort(list_distinct(list(provider) FILTER (kind = 'cost'))), CAST([] AS VARCHAR[])), '|') AS providers,
  CAST(sum(stored_rows) AS BIGINT) AS record_count, min(period_start) FILTER (kind = 'cost') AS period_start,
  max(period_end) FILTER (kind = 'cost') AS period_end, min(data_through) AS data_through FROM sources GROUP BY dataset_id)"""


@query("a28_dataset_summary", with_(COSTS, EVIDENCE, _SOURCES, _SUMMARY) + """
SELECT dataset_id, providers, record_count, strftime(period_start, '%Y-%m-%d') AS period_start, strftime(period_end, '%Y-%m-%d') AS period_end,
  strftime(data_through, '%Y-%m-%d %H:%M:%S') AS data_through FROM summary""")
def a28(spark, sf):
    return coverage.dataset_summary(_sources(spark, sf))


@query("a29_suggested_periods", with_(COSTS, EVIDENCE, _SOURCES, _SUMMARY) + """
, s AS (SELECT *, date_diff('day', period_start, period_end) + 1 AS span FROM summary WHERE period_start IS NOT NULL)
SELECT dataset_id, strftime(period_start, '%Y-%m-%d') AS baseline_start,
  strftime(CASE WHEN span < 2 THEN period_start ELSE period_start + CAST(span // 2 - 1 AS INTEGER) END, '%Y-%m-%d') AS baseline_end,
  strftime(CASE WHEN span < 2 THEN period_start ELSE period_start + CAST(span // 2 AS INTEGER) END, '%Y-%m-%d') AS current_start,
  strftime(period_end, '%Y-%m-%d') AS current_end FROM s""")
def a29(spark, sf):
    return coverage.suggested_periods(coverage.dataset_summary(_sources(spark, sf))).select(
        "dataset_id", "baseline_start", "baseline_end", "current_start", "current_end")


@query("c1_ingest_cost_source", with_(COSTS) + f""",
own AS (SELECT * FROM costs WHERE provider = 'aws'),
rolled AS (SELECT usage_date, service_name, charge_category, sum(billed_cost) AS billed_cost, sum(effective_cost) AS effective_cost FROM own
  GROUP BY billing_account_id, usage_date, service_name, sku_id, region_id, resource_id, charge_category, currency, tag_env, tag_owner)
SELECT strftime(usage_date, '%Y-%m') AS month, service_name, count(*) AS rows, CAST(sum(billed_cost) AS DOUBLE) AS billed_cost,
  CAST(sum(effective_cost) AS DOUBLE) AS effective_cost FROM rolled GROUP BY ALL""")
def c1(spark, sf):
    done = ingest_costs(spark, exports.aws_csv(spark, sf), "aws")
    return done.costs.groupBy(F.date_format("usage_date", "yyyy-MM").alias("month"), "service_name").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("billed_cost").alias("billed_cost"), F.sum("effective_cost").alias("effective_cost"))


def _monthly(done):
    return done.costs.groupBy(F.date_format("usage_date", "yyyy-MM").alias("month"), "service_name").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("billed_cost").alias("billed_cost"), F.sum("effective_cost").alias("effective_cost"))


def _ingested_sql(provider: str, billed: str, effective: str, charge: str) -> str:
    return with_(COSTS) + f""",
own AS (SELECT *, {charge} AS c, {billed} AS b, {effective} AS e FROM costs WHERE provider = '{provider}'),
rolled AS (SELECT usage_date, service_name, sum(b) AS b, sum(e) AS e FROM own
  GROUP BY billing_account_id, usage_date, service_name, sku_id, region_id, resource_id, c, currency, tag_env, tag_owner)
SELECT strftime(usage_date, '%Y-%m') AS month, service_name, count(*) AS rows, CAST(sum(b) AS DOUBLE) AS billed_cost,
  CAST(sum(e) AS DOUBLE) AS effective_cost FROM rolled GROUP BY ALL"""


@query("c1_ingest_azure_source", _ingested_sql("azure", "billed_cost", "effective_cost", "charge_category"))
def c1_azure(spark, sf):
    return _monthly(ingest_costs(spark, exports.azure_json_lines(spark, sf), "azure"))


@query("c1_ingest_gcp_source", _ingested_sql(
    "gcp", f"billed_cost * ({_SIGN})", f"billed_cost * ({_SIGN}) + effective_cost - billed_cost",
    "CASE WHEN charge_category = 'credit' AND billed_cost > 0 THEN 'credit' ELSE 'usage' END"))
def c1_gcp(spark, sf):
    return _monthly(ingest_costs(spark, exports.gcp_csv(spark, sf), "gcp"))


# ------------------------------------------------------------------ scalar functions


@query("p1_focus_projection", with_(COSTS) + f"""
SELECT provider AS "ProviderName", billing_account_id AS "BillingAccountId", strftime(usage_date, '%Y-%m-%d') || ' 00:00:00' AS "ChargePeriodStart",
  strftime(usage_date + 1, '%Y-%m-%d') || ' 00:00:00' AS "ChargePeriodEnd", strftime(date_trunc('month', usage_date), '%Y-%m-%d') AS "BillingPeriodStart",
  strftime(last_day(usage_date), '%Y-%m-%d') AS "BillingPeriodEnd", service_name AS "ServiceName", {category_case('service_name')} AS "ServiceCategory",
  upper(charge_category[1]) || charge_category[2:] AS "ChargeCategory", charge_description AS "ChargeDescription", region_id AS "RegionId",
  resource_id AS "ResourceId", resource_name AS "ResourceName", sku_id AS "SkuId", CAST(usage_quantity AS DOUBLE) AS "ConsumedQuantity",
  usage_unit AS "ConsumedUnit", CAST(billed_cost AS DOUBLE) AS "BilledCost", CAST(effective_cost AS DOUBLE) AS "EffectiveCost",
  currency AS "BillingCurrency", {TAGS} AS "Tags", commitment_discount_id AS "CommitmentDiscountId", '1.4' AS "FocusVersion" FROM costs""")
def p1(spark, sf):
    return native.focus_rows(cost_rows(spark, sf))


@query("p2_service_category", f"""
WITH n AS (SELECT p_name || ' ' || lower(p_type) || CASE p_size % 9 WHEN 0 THEN ' VPC' WHEN 1 THEN ' EC2 functions' WHEN 2 THEN ' S3'
  WHEN 3 THEN ' Key Management' WHEN 4 THEN ' KMS' WHEN 5 THEN ' redis cache' WHEN 6 THEN ' OpenAI' WHEN 7 THEN ' BigQuery' ELSE '' END AS service FROM part)
SELECT service, {category_case('service')} AS category, count(*) AS parts FROM n GROUP BY ALL""")
def p2(spark, sf):
    tail = F.element_at(
        F.array(*[F.lit(t) for t in (" VPC", " EC2 functions", " S3", " Key Management", " KMS", " redis cache", " OpenAI", " BigQuery", "")]),
        (F.col("p_size") % 9 + 1).cast("int"),
    )
    named = table(spark, sf, "part").select(F.concat("p_name", F.lit(" "), F.lower("p_type"), tail).alias("service"))
    return named.groupBy("service", classify.service_category(F.col("service")).alias("category")).agg(F.count(F.lit(1)).alias("parts"))


_TYPES = ["Usage", "DiscountedUsage", "SavingsPlanRecurringFee", "RIPurchase", "Fee", "Tax", "Credit", "Refund", "SavingsPlanNegation", "EdpDiscount", "Surprise", ""]


@query("p3_charge_categories", with_(COSTS) + f"""
SELECT t AS charge_type, CASE lower(t) WHEN 'usage' THEN 'usage' WHEN 'discountedusage' THEN 'usage' WHEN 'savingsplanrecurringfee' THEN 'purchase'
  WHEN 'ripurchase' THEN 'purchase' WHEN 'fee' THEN 'purchase' WHEN 'tax' THEN 'tax' WHEN 'credit' THEN 'credit' WHEN 'refund' THEN 'credit'
  WHEN 'savingsplannegation' THEN 'adjustment' WHEN 'edpdiscount' THEN 'adjustment' WHEN '' THEN 'usage' ELSE 'unknown' END AS aws_category,
  CASE lower(t) WHEN 'usage' THEN 'usage' WHEN 'tax' THEN 'tax' WHEN 'refund' THEN 'credit' WHEN '' THEN 'usage' ELSE 'unknown' END AS azure_category,
  count(*) AS rows FROM (SELECT {_TYPES}[seq % 12 + 1] AS t FROM costs) GROUP BY ALL""")
def p3(spark, sf):
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("seq") % 12 + 1).cast("int"))
    typed = cost_rows(spark, sf).select(kind.alias("charge_type"))
    return typed.groupBy(
        "charge_type", classify.charge_category(F.col("charge_type"), classify.AWS_CHARGE_TYPES).alias("aws_category"),
        classify.charge_category(F.col("charge_type"), classify.AZURE_CHARGE_TYPES).alias("azure_category"),
    ).agg(F.count(F.lit(1)).alias("rows"))


@query("p4_tolerant_amounts", with_(COSTS) + """
SELECT provider, count(*) AS rows, CAST(sum(CASE seq % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE billed_cost END) AS DOUBLE) AS total
FROM costs GROUP BY provider""")
def p4(spark, sf):
    kind = F.col("seq") % 6
    written = (
        F.when(kind == 0, "").when(kind == 1, "n/a").when(kind == 2, None).when(kind == 3, "NaN")
        .when(kind == 4, F.concat(F.lit(" "), F.col("billed_cost").cast("string"))).otherwise(F.col("billed_cost").cast("string"))
    )
    rows = cost_rows(spark, sf).select("provider", parsing.amount(written).alias("amount"))
    return rows.groupBy("provider").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("total"))


@query("p5_flexible_dates", with_(COSTS) + """
SELECT provider, seq, strftime(CASE WHEN seq % 5 < 4 THEN usage_date END, '%Y-%m-%d') AS day FROM costs""")
def p5(spark, sf):
    kind, day = F.col("seq") % 5, F.col("usage_date")
    iso = day.cast("string")
    written = (
        F.when(kind == 0, iso).when(kind == 1, F.date_format(day, "yyyyMMdd"))
        .when(kind == 2, F.concat(iso, F.lit("T23:00:00-05:00"))).when(kind == 3, F.concat(iso, F.lit("T01:30:00Z"))).otherwise("soon")
    )
    return cost_rows(spark, sf).select("provider", "seq", parsing.flexible_date(written).alias("day"))


@query("p6_tag_shapes", with_(COSTS) + f"""
SELECT provider, seq, CASE WHEN seq % 4 < 2 THEN {TAGS} WHEN seq % 4 = 2 THEN 'k=last' ELSE '' END AS tags FROM costs""")
def p6(spark, sf):
    kind = F.col("seq") % 4
    entries = F.transform(F.map_entries("tags"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    written = (
        F.when(kind == 0, F.to_json("tags")).when(kind == 1, F.to_json(entries))
        .when(kind == 2, '[{"key":"k","value":"first"},{"value":"no key"},{"key":"k","value":"last"}]').otherwise("{not json")
    )
    return cost_rows(spark, sf).select("provider", "seq", parsing.tags(written).alias("tags"))


@query("p7_resource_name_from_id", with_(COSTS) + """
SELECT provider, seq, CASE seq % 4 WHEN 3 THEN NULL ELSE resource_id END AS name FROM costs""")
def p7(spark, sf):
    own, kind = F.col("resource_id"), F.col("seq") % 4
    path = (
        F.when(kind == 0, own).when(kind == 1, F.concat(F.lit("arn:aws:ec2:us:1:volume/"), own))
        .when(kind == 2, F.concat(F.lit("a/b:c:"), own)).otherwise(F.concat(own, F.lit("/")))
    )
    return cost_rows(spark, sf).select("provider", "seq", parsing.resource_name_from_id(path).alias("name"))


@query("p9_first_filled", with_(COSTS) + """
SELECT provider, coalesce(nullif(CASE WHEN seq % 3 = 0 THEN '' ELSE region_id END, ''), nullif(resource_id, ''), 'unknown') AS value, count(*) AS rows
FROM costs GROUP BY ALL""")
def p9(spark, sf):
    region = F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("region_id"))
    value = parsing.first_filled(region, F.col("resource_id"), default="unknown")
    return cost_rows(spark, sf).groupBy("provider", value.alias("value")).agg(F.count(F.lit(1)).alias("rows"))


@query("p10_resource_key", with_(COSTS) + """
SELECT provider, coalesce(resource_id, service_name || '::untagged-aggregate') AS resource_key, count(*) AS rows FROM costs GROUP BY ALL""")
def p10(spark, sf):
    key = classify.resource_key(F.col("resource_id"), F.col("service_name"))
    return cost_rows(spark, sf).groupBy("provider", key.alias("resource_key")).agg(F.count(F.lit(1)).alias("rows"))


@query("p11_dimension_keys", with_(COSTS) + """
SELECT dimension, key, count(*) AS rows FROM dims GROUP BY ALL""")
def p11(spark, sf):
    from spendshift.operators.compare import with_dimension_keys
    from spendshift.workloads.views import scoped_costs

    return with_dimension_keys(scoped_costs(spark, sf)).groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("rows"))


@query("p22_period_arithmetic", with_(COSTS) + f"""
SELECT provider, count(*) FILTER ({CUR}) AS current_rows, count(*) FILTER ({BASE}) AS baseline_rows, {CURRENT.days} AS current_days,
  {BASELINE.days} AS baseline_days, '{CURRENT.label}' AS label FROM costs GROUP BY provider""")
def p22(spark, sf):
    day = F.col("usage_date")
    return cost_rows(spark, sf).groupBy("provider").agg(
        F.count(F.when(CURRENT.contains(day), 1)).alias("current_rows"), F.count(F.when(BASELINE.contains(day), 1)).alias("baseline_rows"),
    ).select("*", F.lit(CURRENT.days).alias("current_days"), F.lit(BASELINE.days).alias("baseline_days"), F.lit(CURRENT.label).alias("label"))


@query("p23_lenient_timestamps", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(date_trunc('second', ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS stamp
FROM events""")
def p23(spark, sf):
    kind = F.col("event_id") % 4
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(kind == 0, iso).when(kind == 1, F.concat(iso, F.lit("Z"))).when(kind == 2, F.concat(iso, F.lit("-02:00"))).otherwise("later")
    return table(spark, sf, "events").select("event_id", parsing.lenient_timestamp(written).alias("stamp"))


@query("p24_end_of_day", with_(COSTS) + """
SELECT provider, strftime(usage_date, '%Y-%m-%d') || ' 23:59:59' AS stamp, count(*) AS rows FROM costs GROUP BY ALL""")
def p24(spark, sf):
    rows = cost_rows(spark, sf).groupBy("provider", "usage_date").agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("provider", parsing.end_of_day(F.col("usage_date")).alias("stamp"), "rows")


@query("k11_account_pseudonyms", with_(COSTS) + """
SELECT account, CASE WHEN account = '' THEN '' ELSE 'acct-' || substr(sha256('pepper:' || account), 1, 12) END AS pseudonym, count(*) AS rows
FROM (SELECT CASE WHEN seq % 20 = 0 THEN '' ELSE billing_account_id END AS account FROM costs) GROUP BY ALL""")
def k11(spark, sf):
    account = F.when(F.col("seq") % 20 == 0, "").otherwise(F.col("billing_account_id")).alias("account")
    counted = cost_rows(spark, sf).groupBy(account).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("account", text.pseudonym(F.col("account"), "pepper").alias("pseudonym"), "rows")
