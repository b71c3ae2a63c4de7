"""Registered evidence, playbook, finding and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendshift.functions.classify import contains_any as contains_any_of
from spendshift.functions.classify import has_owner
from spendshift.operators import compare, coverage, evidence, filters, findings, playbooks
from spendshift.plans.investigate import Request, Tables, case_files, investigate
from spendshift.session import scratch_path, settle, stored
from spendshift.sources import metric_store
from spendshift.sources.reference_tables import WORDING, billing_rules
from spendshift.sources.reference_tables import playbooks as playbook_table
from spendshift.workloads import exports
from spendshift.workloads.comparison import DESCRIBE
from spendshift.workloads.oracle import (
    BD, CANDIDATES, CD, COSTS, EVIDENCE, RULES, SPECS, category_case, changes, contains_any, half_even, micro,
    rule_choice, with_,
)
from spendshift.workloads.registry import query
from spendshift.workloads.views import (
    AS_OF, BASELINE, CURRENT, audit_rows, cost_rows, data_stamp, inventory, metric_points, provenance,
    recommendations, scoped_costs,
)

REQUEST = Request(CURRENT, BASELINE, AS_OF)

_settled: dict[tuple, object] = {}


def forget_settled() -> None:
    """Drop the per-session intermediate tables, so the next query computes them anew."""
    _settled.clear()
    exports.forget_written()


def _shared(spark: SparkSession, sf: str, name: str, build):
    """What several queries or steps of one session share, its tables computed as ``build`` says."""
    key = (spark.sparkContext.applicationId, sf, data_stamp(spark, sf), name)
    if key not in _settled:
        _settled[key] = build()
    return _settled[key]


def _once(spark: SparkSession, sf: str, name: str, build, keep=settle) -> DataFrame:
    """An intermediate table several queries of one session share."""
    return _shared(spark, sf, name, lambda: keep(build()))


def sources(spark, sf):
    """Provenance, a few rows told from all cost, audit and metric rows: asked for often, computed once."""
    return _once(spark, sf, "sources", lambda: provenance(spark, sf))


def tables(spark: SparkSession, sf: str) -> Tables:
    return Tables(
        costs=scoped_costs(spark, sf), inventory=inventory(spark, sf), points=metric_points(spark, sf),
        audit=audit_rows(spark, sf), recommendations=recommendations(spark, sf),
        provenance=coverage.with_all_kinds(sources(spark, sf), F.lit("2026-01-01").cast("timestamp")),
        rules=billing_rules(spark), playbooks=playbook_table(spark),
    )


def candidates(spark, sf):
    return _once(spark, sf, "candidates", lambda: compare.candidates(scoped_costs(spark, sf), CURRENT, BASELINE), stored)


def series(spark, sf):
    build = lambda: evidence.candidate_series(candidates(spark, sf), metric_points(spark, sf), CURRENT, BASELINE)
    return _once(spark, sf, "series", build)


def files(spark, sf):
    return _shared(spark, sf, "files", lambda: case_files(REQUEST, tables(spark, sf), candidates(spark, sf)))


def chosen(spark, sf):
    return files(spark, sf)["chosen"]


def evidence_rows(spark, sf):
    def build():
        return files(spark, sf)["evidence"]

    return _once(spark, sf, "evidence", build)


def gaps(spark, sf):
    return files(spark, sf)["gaps"]


def claimed(spark, sf):
    return _once(spark, sf, "claimed", lambda: findings.build_findings(
        candidates(spark, sf), chosen(spark, sf), evidence_rows(spark, sf), billing_rules(spark), gaps(spark, sf),
        CURRENT, F.lit(AS_OF)))


def known(spark, sf):
    return findings.known_resources(scoped_costs(spark, sf), inventory(spark, sf))


def available(spark, sf):
    return coverage.available_source_types(coverage.present_kinds(
        {"cost": scoped_costs(spark, sf), "inventory": inventory(spark, sf), "metrics": metric_points(spark, sf),
         "audit": audit_rows(spark, sf), "recommendations": recommendations(spark, sf)}))


def flawed(spark, sf):
    """Findings with planted faults, so every validation check has something to find.

    Faults follow the finding's place: inflated cost, an unknown resource, lost evidence,
    a rule selected before its start, a confidence without corroboration.
    """
    place = F.col("kept_position")
    rows = claimed(spark, sf)
    return (
        rows.withColumn("actual_cost_increase", F.when(place == 2, (F.col("actual_cost_increase") * 2).cast("decimal(22,6)"))
                        .otherwise(F.col("actual_cost_increase")))
        .withColumn("affected_resources", F.when(place == 3, F.array(F.lit("res-nowhere")))
                    .when(place == 4, F.array(F.lit("res-shared"))).when(place == 5, F.array(F.lit("res-shared")))
                    .otherwise(F.col("affected_resources")))
        .withColumn("evidence_count", F.when(place == 6, F.lit(0).cast("bigint")).otherwise(F.col("evidence_count")))
        .withColumn("rule_selected_for", F.when(place == 7, F.lit("2000-01-01").cast("date"))
                    .otherwise(F.col("rule_selected_for")))
        .withColumn("confidence", F.when(place == 8, F.lit("0.9").cast("decimal(6,3)")).otherwise(F.col("confidence")))
        .withColumn("kinds", F.when(place == 8, F.array(F.lit("cost"))).otherwise(F.col("kinds")))
    )


def validated(spark, sf):
    shared = spark.range(3).select(
        F.element_at(F.array(F.lit("aws"), F.lit("azure"), F.lit("gcp")), (F.col("id") + 1).cast("int")).alias("provider"),
        F.lit("res-shared").alias("resource_id"),
    )
    return _shared(spark, sf, "validated", lambda: findings.validate(
        flawed(spark, sf), known(spark, sf).unionByName(shared), candidates(spark, sf), available(spark, sf)
    ))


def published(spark, sf):
    return _once(spark, sf, "published", lambda: validated(spark, sf)[0])


def dropped(spark, sf):
    return _once(spark, sf, "dropped", lambda: validated(spark, sf)[1])


def issues(spark, sf):
    return _once(spark, sf, "issues", lambda: validated(spark, sf)[2])


# ------------------------------------------------------------------ SQL of the same steps

_IN_CURRENT = f"BETWEEN DATE '{CURRENT.start}' AND DATE '{CURRENT.end}'"
_IN_BASE = f"BETWEEN DATE '{BASELINE.start}' AND DATE '{BASELINE.end}'"
CFULL = f"""
cfull AS (
  SELECT c.*, d.service_name, {category_case('d.service_name')} AS service_category, f.resource_id, f.resource_name,
    f.billing_account_id, f.region_id, f.sku_ids, f.tag_env, f.tag_owner, s.spike
  FROM cand c JOIN dom d USING (provider, dimension, key) JOIN firsts f USING (provider, dimension, key)
  LEFT JOIN spikes s USING (provider, dimension, key)),
cinv AS (
  SELECT c.candidate_id, arg_min(i.resource_type, i.seq) AS resource_type, arg_min(i.resource_name, i.seq) AS inv_name,
    arg_min(coalesce(i.tag_owner, ''), i.seq) AS inv_owner, arg_min(i.state, i.seq) AS state, min(i.seq) AS inv_seq
  FROM cfull c JOIN inv i ON i.provider = c.provider AND i.resource_id = c.resource_id GROUP BY ALL),
cseries AS (
  SELECT c.candidate_id, c.provider, p.resource_id, p.metric_name, min(p.seq) AS seq,
    coalesce(sum(p.value) FILTER (point_date {_IN_CURRENT}), 0) AS cur_total,
    count(*) FILTER (point_date {_IN_CURRENT}) AS cur_points,
    coalesce(max(p.value) FILTER (point_date {_IN_CURRENT}), 0) AS cur_max,
    coalesce(sum(p.value) FILTER (point_date {_IN_BASE}), 0) AS base_total,
    count(*) FILTER (point_date {_IN_BASE}) AS base_points
  FROM cfull c JOIN points p ON p.provider = c.provider AND p.resource_id = c.resource_id GROUP BY ALL),
cevents AS (
  SELECT c.candidate_id, c.provider, a.event_id, a.event_name, a.event_time, a.seq, a.summary FROM cfull c JOIN audit a
    ON a.provider = c.provider AND CAST(a.event_time AS DATE) {_IN_CURRENT}
    AND (c.resource_id IS NULL OR c.resource_id IN (a.r1, a.r2)))"""
SCORES = f"""
pairs AS (
  SELECT c.candidate_id, c.kept_position, s.*,
    ({contains_any('c.service_name', 's.service_patterns')} OR {contains_any('c.service_category', 's.service_patterns')}) AS service_hit,
    len(list_filter(s.sku_patterns, lambda p: contains(lower(c.sku_ids), lower(p)))) > 0 AS sku_hit,
    coalesce(c.quantity_percent_change >= 10, true) AS driven,
    c.tag_owner IS NOT NULL OR coalesce(i.inv_owner, '') <> '' AS owned,
    coalesce((SELECT max(CASE WHEN {contains_any('m.metric_name', 's.low_utilization_metrics')}
      AND CASE WHEN m.cur_points = 0 THEN 0 ELSE m.cur_total / m.cur_points END <= s.low_utilization_threshold THEN 1 ELSE 0 END)
      FROM cseries m WHERE m.candidate_id = c.candidate_id), 0) = 1 AS idle,
    coalesce((SELECT max(CASE WHEN {contains_any('m.metric_name', 's.metric_names')} THEN 1 ELSE 0 END)
      FROM cseries m WHERE m.candidate_id = c.candidate_id), 0) = 1 AS metric_hit,
    coalesce((SELECT max(CASE WHEN {contains_any('e.event_name', 's.audit_event_patterns')} THEN 1 ELSE 0 END)
      FROM cevents e WHERE e.candidate_id = c.candidate_id), 0) = 1 AS audit_hit
  FROM cfull c JOIN specs s ON s.provider = c.provider LEFT JOIN cinv i ON i.candidate_id = c.candidate_id),
scores AS (
  SELECT *, CASE WHEN len(service_patterns) > 0 THEN 3 ELSE 0 END + CASE WHEN len(sku_patterns) > 0 THEN 3 ELSE 0 END
    + CASE WHEN requires_rate_change THEN 3 ELSE 0 END + CASE WHEN requires_missing_owner THEN 2 ELSE 0 END
    + CASE WHEN len(low_utilization_metrics) > 0 THEN 2 ELSE 0 END
    + CASE WHEN len(metric_names) > 0 AND metric_hit THEN 1 ELSE 0 END
    + CASE WHEN len(audit_event_patterns) > 0 AND audit_hit THEN 2 ELSE 0 END AS score
  FROM pairs WHERE (len(service_patterns) = 0 OR service_hit) AND (len(sku_patterns) = 0 OR sku_hit)
    AND CASE WHEN requires_rate_change THEN NOT driven WHEN requires_quantity_growth THEN driven ELSE true END
    AND (NOT requires_missing_owner OR NOT owned) AND (len(low_utilization_metrics) = 0 OR idle)),
bestspec AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, priority, seq) AS n FROM scores)
  WHERE n = 1),
picked AS (
  SELECT c.candidate_id, c.provider, c.kept_position, coalesce(b.category, 'unexplained_increase') AS category,
    coalesce(b.risk, 'low') AS risk, CAST(coalesce(b.max_confidence, 0.4) AS DOUBLE) AS cap, b.category IS NULL AS is_fallback,
    coalesce(b.metric_names, CAST([] AS VARCHAR[])) AS metric_names,
    coalesce(b.audit_event_patterns, CAST([] AS VARCHAR[])) AS audit_patterns
  FROM cfull c LEFT JOIN bestspec b USING (candidate_id))"""
CHOSEN_ROWS = f"""
mwanted AS (
  SELECT m.*, p.kept_position, len(p.metric_names) = 0 OR {contains_any('m.metric_name', 'p.metric_names')} AS wanted
  FROM cseries m JOIN picked p USING (candidate_id)),
mkept AS (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY seq, metric_name) AS item FROM (
    SELECT *, max(CASE WHEN wanted THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_id) AS has_wanted FROM mwanted)
  WHERE wanted OR has_wanted = 0),
ekept AS (
  SELECT e.*, p.kept_position, row_number() OVER (PARTITION BY e.candidate_id ORDER BY event_time, e.seq) AS item
  FROM cevents e JOIN picked p USING (candidate_id)
  WHERE len(p.audit_patterns) = 0 OR {contains_any('e.event_name', 'p.audit_patterns')}),
rkept AS (
  SELECT c.candidate_id, c.provider, c.kept_position, r.recommendation_id, r.estimated_monthly_savings,
    row_number() OVER (PARTITION BY c.candidate_id ORDER BY r.seq, r.recommendation_id) AS item
  FROM cfull c JOIN recs r ON r.provider = c.provider AND r.resource_id = c.resource_id),
cover AS (SELECT provider, min(data_through) < CAST(DATE '{CURRENT.end}' AS TIMESTAMP) + INTERVAL '86399' SECOND AS incomplete
  FROM provenance GROUP BY provider),
ev AS (
  SELECT candidate_id, provider, kept_position, 'cost' AS source_type, 0 AS ko, 1 AS io, key AS source_id,
    absolute_change AS numeric_value FROM cfull UNION ALL
  SELECT candidate_id, provider, kept_position, 'usage', 1, 1, key, CAST(q - bqi AS DOUBLE) / 1000000.0 FROM cfull WHERE q > 0 OR bqi > 0 UNION ALL
  SELECT c.candidate_id, c.provider, c.kept_position, 'inventory', 2, 1, c.resource_id, NULL FROM cfull c JOIN cinv USING (candidate_id) UNION ALL
  SELECT candidate_id, provider, kept_position, 'metric', 3, item, resource_id || ':' || metric_name,
    CASE WHEN cur_points = 0 THEN 0.0 ELSE {half_even(micro('cur_total'), 'greatest(cur_points, 1) * 100', 4)} END FROM mkept WHERE item <= 3 UNION ALL
  SELECT candidate_id, provider, kept_position, 'audit', 4, item, event_id, NULL FROM ekept WHERE item <= 3 UNION ALL
  SELECT candidate_id, provider, kept_position, 'recommendation', 5, item, recommendation_id, estimated_monthly_savings FROM rkept WHERE item <= 2 UNION ALL
  SELECT c.candidate_id, c.provider, c.kept_position, 'freshness', 6, 1, c.provider || ':data_through', NULL FROM cfull c JOIN cover v ON v.provider = c.provider AND v.incomplete),
evid AS (
  SELECT *, row_number() OVER (PARTITION BY provider ORDER BY kept_position, ko, io) AS n FROM ev)"""
_EVIDENCE_ID = "upper(provider) || '-E' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0')"
FINDINGS = f"""
questions AS (
  SELECT c.candidate_id AS qid, c.provider, 'cost_driver' AS rule_type, c.service_name AS service, p.category,
    coalesce(c.spike, DATE '{CURRENT.end}') AS usage_date FROM cfull c JOIN picked p USING (candidate_id)),
{rule_choice('questions').strip()},
kinds AS (
  SELECT candidate_id, list_sort(list_distinct(list(source_type))) AS kinds, count(*) AS evidence_count,
    array_to_string(list_sort(list({_EVIDENCE_ID})), '|') AS evidence_ids FROM evid GROUP BY ALL),
raw_finding AS (
  SELECT c.*, p.category, p.risk, p.cap, p.is_fallback, k.kinds, k.evidence_count, k.evidence_ids, a.found, a.rule_id,
    a.is_stale, a.is_undated, a.rule_valid_from, coalesce(v.incomplete, false) AS incomplete,
    coalesce(c.quantity_percent_change >= 10, true) AS driven,
    30 + CASE WHEN list_contains(k.kinds, 'usage') THEN 10 ELSE 0 END + CASE WHEN list_contains(k.kinds, 'metric') THEN 15 ELSE 0 END
    + CASE WHEN list_contains(k.kinds, 'audit') THEN 20 ELSE 0 END + CASE WHEN list_contains(k.kinds, 'inventory') THEN 10 ELSE 0 END
    + CASE WHEN list_contains(k.kinds, 'recommendation') THEN 10 ELSE 0 END + CASE WHEN c.is_new THEN 5 ELSE 0 END
    - CASE WHEN list_contains(k.kinds, 'freshness') THEN 10 ELSE 0 END AS points
  FROM cfull c JOIN picked p USING (candidate_id) JOIN kinds k USING (candidate_id) JOIN answered a ON a.qid = c.candidate_id
  LEFT JOIN cover v ON v.provider = c.provider),
capped AS (
  SELECT *, greatest(5, least(points, CAST(round(cap * 100) AS INTEGER))) AS c0,
    CASE WHEN NOT found THEN 45 WHEN is_stale OR is_undated THEN 60 ELSE 1000 END AS c1,
    CASE WHEN NOT driven AND category <> 'pricing_change' THEN 70 ELSE 1000 END AS c2 FROM raw_finding),
finding AS (
  SELECT *, upper(provider) || '-F' || lpad(CAST(row_number() OVER (PARTITION BY provider ORDER BY kept_position) AS VARCHAR), 2, '0') AS finding_id,
    CAST(least(c0, c1, c2) AS DOUBLE) / 100.0 AS confidence,
    CAST(round({half_even('c - e', '10000', 0)}) AS BIGINT) AS cents,
    {half_even('(c - e) * 304', f'{CD} * 100000', 2)} AS estimated_monthly_impact,
    is_fallback OR NOT found OR coalesce(is_stale, false) OR is_undated OR incomplete AS is_uncertain
  FROM capped)"""
CASE_SQL = (COSTS, changes("keyed"), CANDIDATES, DESCRIBE, EVIDENCE, CFULL)
ALL_SQL = (*CASE_SQL, SPECS, SCORES, CHOSEN_ROWS, RULES, FINDINGS)


# ------------------------------------------------------------------ metrics


@query("a14_metric_windows", with_(COSTS, EVIDENCE) + f"""
SELECT provider, resource_id, metric_name,
  CAST(coalesce(sum(value) FILTER (point_date {_IN_CURRENT}), 0) AS DOUBLE) AS current_total,
  CAST(coalesce(sum(value) FILTER (point_date {_IN_BASE}), 0) AS DOUBLE) AS baseline_total,
  CAST(coalesce(max(value) FILTER (point_date {_IN_CURRENT}), 0) AS DOUBLE) AS current_max,
  count(*) FILTER (point_date {_IN_CURRENT}) AS current_points, count(*) FILTER (point_date {_IN_BASE}) AS baseline_points
FROM points GROUP BY ALL""")
def a14(spark, sf):
    return evidence.metric_windows(metric_points(spark, sf), CURRENT, BASELINE).select(
        "provider", "resource_id", "metric_name", "current_total", "baseline_total", "current_max",
        "current_points", "baseline_points",
    )


_WINDOW_INTS = f"""
w AS (SELECT provider, resource_id, metric_name, {micro(f"coalesce(sum(value) FILTER (point_date {_IN_CURRENT}), 0)")} AS ct,
  count(*) FILTER (point_date {_IN_CURRENT}) AS cn, {micro(f"coalesce(sum(value) FILTER (point_date {_IN_BASE}), 0)")} AS bt,
  count(*) FILTER (point_date {_IN_BASE}) AS bn FROM points GROUP BY ALL)"""


@query("a15_metric_change", with_(COSTS, EVIDENCE, _WINDOW_INTS) + f"""
SELECT provider, resource_id, metric_name,
  CASE WHEN bt > 0 THEN {half_even('(ct * bn - bt * greatest(cn, 1)) * 1000', 'greatest(bt * greatest(cn, 1), 1)', 1)} END AS average_percent_change
FROM (SELECT provider, resource_id, metric_name, ct, bt, bn, cn FROM w WHERE cn > 0 OR bn > 0)""")
def a15(spark, sf):
    windows = evidence.metric_windows(metric_points(spark, sf), CURRENT, BASELINE)
    shown = windows.filter((F.col("current_points") > 0) | (F.col("baseline_points") > 0))
    return evidence.with_metric_change(shown).select(
        "provider", "resource_id", "metric_name", "average_percent_change"
    )


@query("a16_low_utilisation", with_(COSTS, EVIDENCE, SPECS, _WINDOW_INTS) + f"""
SELECT w.provider, w.resource_id, s.category,
  max(CASE WHEN ct <= CAST(round(s.low_utilization_threshold * 1000000) AS HUGEINT) * greatest(cn, 1) THEN 1 ELSE 0 END) = 1 AS is_idle,
  CAST(sum(cn) AS BIGINT) AS current_points
FROM w JOIN specs s ON s.provider = w.provider AND {contains_any('w.metric_name', 's.low_utilization_metrics')} GROUP BY ALL""")
def a16(spark, sf):
    specs = playbook_table(spark).select("provider", "category", "low_utilization_metrics", "low_utilization_threshold")
    windows = evidence.metric_windows(metric_points(spark, sf), CURRENT, BASELINE)
    watched = windows.join(specs, "provider").filter(
        contains_any_of(F.col("metric_name"), F.col("low_utilization_metrics"))
    )
    idle = F.col("current_average") <= F.col("low_utilization_threshold").cast("decimal(20,6)")
    return watched.groupBy("provider", "resource_id", "category").agg(
        F.max(idle).alias("is_idle"), F.sum("current_points").alias("current_points")
    )


# ------------------------------------------------------------------ joins


@query("j1_candidate_inventory", with_(*CASE_SQL) + """
SELECT c.candidate_id, c.resource_id, i.resource_type, i.state, i.inv_name AS resource_name, i.inv_seq AS seq
FROM cfull c JOIN cinv i USING (candidate_id)""")
def j1(spark, sf):
    return evidence.first_inventory(candidates(spark, sf), inventory(spark, sf)).select(
        "candidate_id", "resource_id", "resource_type", "state", "resource_name", "seq"
    )


@query("j2_candidate_metrics", with_(*CASE_SQL) + """
SELECT candidate_id, metric_name, CAST(cur_total AS DOUBLE) AS current_total, cur_points AS current_points,
  CAST(base_total AS DOUBLE) AS baseline_total FROM cseries""")
def j2(spark, sf):
    return series(spark, sf).select(
        "candidate_id", "metric_name", "current_total", "current_points", "baseline_total"
    )


@query("j3_candidate_audit_events", with_(*CASE_SQL) + "SELECT candidate_id, event_id, event_name, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time FROM cevents")
def j3(spark, sf):
    return evidence.candidate_events(candidates(spark, sf), audit_rows(spark, sf), CURRENT).select(
        "candidate_id", "event_id", "event_name", "event_time"
    )


@query("j4_candidate_recommendations", with_(*CASE_SQL) + """
SELECT candidate_id, recommendation_id, estimated_monthly_savings, item AS item_order FROM (
  SELECT c.candidate_id, r.recommendation_id, r.estimated_monthly_savings,
    row_number() OVER (PARTITION BY c.candidate_id ORDER BY r.seq) AS item
  FROM cfull c JOIN recs r ON r.provider = c.provider AND r.resource_id = c.resource_id) WHERE item <= 2""")
def j4(spark, sf):
    return evidence.first_recommendations(candidates(spark, sf), recommendations(spark, sf)).select(
        "candidate_id", "recommendation_id", "estimated_monthly_savings", F.col("item_order").cast("bigint").alias("item_order")
    )


@query("j9_known_resources", with_(COSTS, EVIDENCE) + """
SELECT provider, count(*) AS resources FROM (
  SELECT provider, resource_id FROM scoped WHERE resource_id IS NOT NULL UNION SELECT provider, resource_id FROM inv) GROUP BY provider""")
def j9(spark, sf):
    return known(spark, sf).distinct().groupBy("provider").agg(F.count(F.lit(1)).alias("resources"))


@query("j8_unknown_resources", with_(COSTS, EVIDENCE) + """
SELECT provider, resource_id, count(*) AS events FROM (
  SELECT provider, r1 AS resource_id FROM audit UNION ALL SELECT provider, r2 FROM audit) t
WHERE NOT EXISTS (SELECT 1 FROM scoped s WHERE s.provider = t.provider AND s.resource_id = t.resource_id)
  AND NOT EXISTS (SELECT 1 FROM inv i WHERE i.provider = t.provider AND i.resource_id = t.resource_id) GROUP BY ALL""")
def j8(spark, sf):
    """Resources named by audit events that neither cost rows nor inventory know."""
    listed = audit_rows(spark, sf).select("provider", F.explode("resource_ids").alias("resource_id"))
    counted = listed.groupBy("provider", "resource_id").agg(F.count(F.lit(1)).alias("events"))
    return counted.join(known(spark, sf), ["provider", "resource_id"], "left_anti")


@query("f4_inventory_filter", with_(COSTS, EVIDENCE) + """
SELECT provider, resource_id, resource_type, state FROM inv WHERE contains(lower(resource_type), 'econ')
ORDER BY seq, provider, resource_id LIMIT 100""")
def f4(spark, sf):
    return filters.inventory_matching(inventory(spark, sf), resource_type="ECON").select(
        "provider", "resource_id", "resource_type", "state"
    )


@query("f5_audit_window", with_(COSTS, EVIDENCE) + f"""
SELECT provider, event_id, event_name, summary FROM audit WHERE CAST(event_time AS DATE) {_IN_CURRENT}
  AND 'res-5' IN (r1, r2) ORDER BY seq, provider, event_id LIMIT 100""")
def f5(spark, sf):
    return filters.audit_in_window(audit_rows(spark, sf), CURRENT, "res-5").select(
        "provider", "event_id", "event_name", "summary"
    )


@query("f6_metric_series_of_resource", with_(COSTS, EVIDENCE) + """
SELECT provider, metric_name, strftime(point_date, '%Y-%m-%d') AS point_date, CAST(value AS DOUBLE) AS value
FROM points WHERE resource_id = 'res-5'""")
def f6(spark, sf):
    return filters.metrics_for(metric_points(spark, sf), ["res-5"]).select(
        "provider", "metric_name", "point_date", "value"
    )


@query("s13_metric_scan_by_resource", with_(*CASE_SQL) + """
SELECT p.provider, p.resource_id, p.metric_name, count(*) AS points, CAST(sum(p.value) AS DOUBLE) AS total
FROM points p SEMI JOIN cfull c ON c.provider = p.provider AND c.resource_id = p.resource_id GROUP BY ALL""")
def s13(spark, sf):
    keys = candidates(spark, sf).filter("resource_id is not null")
    own = filters.only_keys(metric_points(spark, sf), keys, ["provider", "resource_id"])
    return own.groupBy("provider", "resource_id", "metric_name").agg(
        F.count(F.lit(1)).alias("points"), F.sum("value").alias("total")
    )


@query("s13_stored_metric_scan", with_(*CASE_SQL) + """
SELECT p.provider, p.resource_id, p.metric_name, count(*) AS points, CAST(sum(p.value) AS DOUBLE) AS total
FROM points p SEMI JOIN cfull c ON c.provider = p.provider AND c.resource_id = p.resource_id GROUP BY ALL""")
def s13_stored(spark, sf):
    """The same from a store that is laid out by resource and lists the candidates' buckets only."""
    path = scratch_path(spark, "metric-points")
    metric_store.write_points(metric_points(spark, sf), path)
    keys = candidates(spark, sf).filter("resource_id is not null")
    own = metric_store.read_points(spark, path, keys, ("provider", "resource_id"))
    return own.groupBy("provider", "resource_id", "metric_name").agg(F.count(F.lit(1)).alias("points"), F.sum("value").alias("total"))


@query("f10_candidate_allowlist", with_(COSTS, changes("keyed"), CANDIDATES) + """
SELECT candidate_id, key, absolute_change FROM cand c WHERE EXISTS (SELECT 1 FROM (
  SELECT candidate_id, row_number() OVER (PARTITION BY provider ORDER BY kept_position DESC) AS r FROM cand) a
  WHERE a.candidate_id = c.candidate_id AND r <= 2)""")
def f10(spark, sf):
    """Only the candidates a task lists: here the two smallest of each provider."""
    from pyspark.sql import Window

    rows = candidates(spark, sf)
    last = Window.partitionBy("provider").orderBy(F.col("kept_position").desc())
    task = rows.withColumn("r", F.row_number().over(last)).filter("r <= 2")
    return filters.only_keys(rows, task, ["candidate_id"]).select("candidate_id", "key", "absolute_change")


@query("p15_owner_present", with_(COSTS, EVIDENCE) + """
SELECT i.provider, i.resource_id, (coalesce(c.tag_owner, '') <> '' OR coalesce(i.tag_owner, '') <> '') AS has_owner
FROM (SELECT provider, resource_id, arg_min(coalesce(tag_owner, ''), seq) AS tag_owner FROM inv GROUP BY ALL) i
JOIN (SELECT provider, resource_id, max(tag_owner) AS tag_owner FROM scoped WHERE resource_id IS NOT NULL GROUP BY ALL) c
USING (provider, resource_id)""")
def p15(spark, sf):
    owner = F.col("tags")["owner"]
    costs = scoped_costs(spark, sf).filter("resource_id is not null").groupBy("provider", "resource_id").agg(
        F.max(owner).alias("owner")
    )
    tags = F.when(F.col("owner").isNotNull(), F.create_map(F.lit("owner"), F.col("owner")))
    firsts = inventory(spark, sf).groupBy("provider", "resource_id").agg(
        F.min(F.struct("seq", F.coalesce(owner, F.lit("")).alias("owner")))["owner"].alias("listed")
    )
    joined = firsts.join(costs, ["provider", "resource_id"])
    overlay = F.when(F.col("listed") != "", F.create_map(F.lit("Owner"), F.col("listed")))
    return joined.select("provider", "resource_id", has_owner(tags, overlay).alias("has_owner"))


@query("p16_contains_any", with_(COSTS, SPECS) + f"""
SELECT s.provider, s.category, c.service_name, count(*) AS lines FROM costs c JOIN specs s ON s.provider = c.provider
WHERE {contains_any('c.service_name', 's.service_patterns')} GROUP BY ALL""")
def p16(spark, sf):
    lines = cost_rows(spark, sf).groupBy("provider", "service_name").agg(F.count(F.lit(1)).alias("lines"))
    specs = playbook_table(spark).select("provider", "category", "service_patterns")
    return lines.join(specs, "provider").filter(
        contains_any_of(F.col("service_name"), F.col("service_patterns"))
    ).groupBy("provider", "category", "service_name").agg(F.sum("lines").alias("lines"))


# ------------------------------------------------------------------ playbooks


@query("j5_playbook_scores", with_(*CASE_SQL, SPECS, SCORES) + """
SELECT candidate_id, category, score, priority FROM scores""")
def j5(spark, sf):
    rows = candidates(spark, sf)
    events = evidence.leading_events(rows, audit_rows(spark, sf), CURRENT)
    scores = playbooks.match_scores(rows, playbook_table(spark), inventory(spark, sf), series(spark, sf), events)
    return scores.select("candidate_id", F.col("spec_category").alias("category"), "score", F.col("spec_priority").alias("priority"))


@query("w6_best_playbook", with_(*CASE_SQL, SPECS, SCORES) + "SELECT candidate_id, category, risk, cap AS max_confidence, is_fallback FROM picked")
def w6(spark, sf):
    return chosen(spark, sf).select("candidate_id", "category", "risk", "max_confidence", "is_fallback")


@query("w7_first_evidence_of_kind", with_(*CASE_SQL, SPECS, SCORES, CHOSEN_ROWS) + """
SELECT candidate_id, source_type, source_id, CAST(io AS BIGINT) AS item_order FROM ev WHERE source_type IN ('metric', 'audit', 'recommendation')""")
def w7(spark, sf):
    rows = evidence_rows(spark, sf).filter(F.col("source_type").isin("metric", "audit", "recommendation"))
    return rows.select("candidate_id", "source_type", "source_id", F.col("item_order").cast("bigint").alias("item_order"))


@query("w4_evidence_ids", with_(*CASE_SQL, SPECS, SCORES, CHOSEN_ROWS) + f"""
SELECT {_EVIDENCE_ID} AS evidence_id, candidate_id, source_type, source_id FROM evid""")
def w4(spark, sf):
    return evidence_rows(spark, sf).select("evidence_id", "candidate_id", "source_type", "source_id")


@query("c2_evidence_assembly", with_(*CASE_SQL, SPECS, SCORES, CHOSEN_ROWS) + f"""
SELECT {_EVIDENCE_ID} AS evidence_id, provider, candidate_id, source_type, source_id, numeric_value FROM evid""")
def c2(spark, sf):
    return evidence_rows(spark, sf).select(
        "evidence_id", "provider", "candidate_id", "source_type", "source_id", "numeric_value"
    )


@query("c3_evidence_rows", with_(*CASE_SQL, SPECS, SCORES, CHOSEN_ROWS) + f"""
SELECT {_EVIDENCE_ID} AS evidence_id, provider, source_type, source_id, numeric_value, count(*) OVER (PARTITION BY provider, source_type) AS of_kind,
  row_number() OVER (PARTITION BY candidate_id ORDER BY n) AS in_candidate FROM evid""")
def c3_rows(spark, sf):
    """Every evidence row but its wording: which rows there are, their kinds, and their places among their candidate's."""
    kind, own = Window.partitionBy("provider", "source_type"), Window.partitionBy("candidate_id").orderBy(F.length("evidence_id"), "evidence_id")
    return evidence_rows(spark, sf).select(
        "evidence_id", "provider", "source_type", "source_id", "numeric_value", F.count(F.lit(1)).over(kind).alias("of_kind"),
        F.row_number().over(own).alias("in_candidate"),
    )


@query("c3_evidence_statements")
def c3(spark, sf):
    """Statement texts; the wording is ours, so only the row set is comparable."""
    return evidence_rows(spark, sf).select(
        "evidence_id", "source_type", "statement", "numeric_unit", "query_reference", "origin",
        "contains_untrusted_text",
    )


@query("a34_evidence_counts", with_(*CASE_SQL, SPECS, SCORES, CHOSEN_ROWS) + """
SELECT provider, candidate_id, count(*) AS evidence_count FROM evid GROUP BY ALL""")
def a34(spark, sf):
    return evidence_rows(spark, sf).groupBy("provider", "candidate_id").agg(F.count(F.lit(1)).alias("evidence_count"))


@query("p25_confidence_score", with_(*ALL_SQL) + "SELECT candidate_id, CAST(c0 AS DOUBLE) / 100.0 AS score FROM capped")
def p25(spark, sf):
    summary = findings.evidence_summary(evidence_rows(spark, sf))
    joined = candidates(spark, sf).join(summary, evidence.CANDIDATE).join(chosen(spark, sf), evidence.CANDIDATE)
    return joined.select(
        "candidate_id",
        playbooks.confidence(F.col("kinds"), F.col("untrusted"), F.col("is_new"), F.col("max_confidence")).alias("score"),
    )


_CAUSES = ", ".join(
    "('{0}', '{1}')".format(category, cause.replace("'", "''")) for category, (cause, _) in WORDING.items()
)


@query("p21_root_cause_texts", with_(*CASE_SQL, SPECS, SCORES) + f""",
texts AS (SELECT * FROM (VALUES {_CAUSES}) v(category, template))
SELECT c.candidate_id, p.category, replace(replace(replace(replace(replace(replace(replace(t.template,
  '{{key}}', c.key), '{{resource}}', coalesce(c.resource_name, c.resource_id, c.key)), '{{service}}', c.service_name),
  '{{region}}', coalesce(c.region_id, 'an unknown region')),
  '{{spike_date}}', coalesce(strftime(c.spike, '%Y-%m-%d'), 'the start of the period')),
  '{{increase}}', format('{{:,.2f}}', CAST(round({half_even('c.c - c.e', '10000', 0)}) AS BIGINT) / 100.0) || ' USD'), '{{provider}}', upper(c.provider)) AS cause
FROM cfull c JOIN picked p USING (candidate_id) JOIN texts t USING (category)""")
def p21(spark, sf):
    joined = candidates(spark, sf).join(chosen(spark, sf), evidence.CANDIDATE).filter(~F.col("is_fallback"))
    from spendshift.functions.text import fill_template

    return joined.select("candidate_id", "category", fill_template(F.col("root_cause"), findings._placeholders()).alias("cause"))


# ------------------------------------------------------------------ findings


@query("c4_findings", with_(*ALL_SQL) + """
SELECT finding_id, provider, candidate_id, category, risk, confidence, CAST(cents AS DOUBLE) / 100.0 AS actual_cost_increase,
  estimated_monthly_impact, is_uncertain, rule_id, evidence_count, evidence_ids, coalesce(resource_id, '') AS affected_resources
FROM finding""")
def c4(spark, sf):
    return claimed(spark, sf).select(
        "finding_id", "provider", "candidate_id", "category", "risk", "confidence", "actual_cost_increase",
        "estimated_monthly_impact", "is_uncertain", "rule_id", "evidence_count", "evidence_ids", "affected_resources",
    )


@query("w3_finding_ids", with_(*ALL_SQL) + "SELECT finding_id, candidate_id, kept_position FROM finding")
def w3(spark, sf):
    return claimed(spark, sf).select("finding_id", "candidate_id", F.col("kept_position").cast("bigint").alias("kept_position"))


@query("o2_worker_order", with_(*ALL_SQL) + """
SELECT provider, row_number() OVER (PARTITION BY provider ORDER BY cents DESC, kept_position) AS place, finding_id FROM finding""")
def o2(spark, sf):
    from pyspark.sql import Window

    ordered = findings.worker_order(claimed(spark, sf))
    place = Window.partitionBy("provider").orderBy(F.col("actual_cost_increase").desc(), "kept_position")
    return ordered.select("provider", F.row_number().over(place).cast("bigint").alias("place"), "finding_id")


@query("o1_ranked_findings", with_(*ALL_SQL) + """
SELECT row_number() OVER (ORDER BY is_uncertain, cents DESC, confidence DESC, provider, kept_position) AS rank,
  finding_id, category, confidence FROM finding""")
def o1(spark, sf):
    return findings.rank_findings(claimed(spark, sf)).select(
        F.col("rank").cast("bigint").alias("rank"), "finding_id", "category", "confidence"
    )


@query("o4_headline", with_(*ALL_SQL) + """
SELECT finding_id, provider, category, CAST(cents AS DOUBLE) / 100.0 AS actual_cost_increase, confidence FROM finding
ORDER BY is_uncertain, cents DESC, confidence DESC, provider, kept_position LIMIT 1""")
def o4(spark, sf):
    return findings.headline(claimed(spark, sf)).select(
        "finding_id", "provider", "category", "actual_cost_increase", "confidence"
    )


@query("u6_first_citations", with_(*ALL_SQL) + """
SELECT provider, rule_id, min(kept_position) AS seq FROM finding WHERE rule_id IS NOT NULL GROUP BY ALL""")
def u6(spark, sf):
    cited = claimed(spark, sf).filter("rule_id is not null").select(
        "provider", "rule_id", F.col("kept_position").cast("bigint").alias("seq")
    )
    return findings.first_citations(cited)


@query("a30_plan_rows", with_(*CASE_SQL) + """
SELECT provider, array_to_string(list_sort(list_distinct(list(service_name))), '|') AS focus_areas,
  array_to_string(list(key ORDER BY kept_position)[1:3], '|') AS must_explain,
  array_to_string(list(candidate_id ORDER BY kept_position), '|') AS candidate_ids,
  greatest(count(*), 1) AS max_findings, true AS has_work FROM cfull GROUP BY provider""")
def a30(spark, sf):
    return coverage.plan_rows(candidates(spark, sf))


@query("a31_provider_statuses", with_(*ALL_SQL) + """,
cov AS (SELECT provider, min(data_through) AS data_through, 'upload' AS origin FROM provenance GROUP BY provider)
SELECT p.provider, CASE WHEN c.provider IS NULL THEN 'skipped' ELSE 'ok' END AS status,
  coalesce(f.n, 0) AS finding_count, strftime(c.data_through, '%Y-%m-%d %H:%M:%S') AS data_through, c.origin
FROM (VALUES ('aws'), ('azure'), ('gcp'), ('other')) p(provider) LEFT JOIN cov c USING (provider)
LEFT JOIN (SELECT provider, count(*) AS n FROM finding GROUP BY provider) f USING (provider)""")
def a31(spark, sf):
    covered = coverage.provider_coverage(sources(spark, sf))
    return coverage.provider_statuses(claimed(spark, sf), covered, ["aws", "azure", "gcp", "other"])


def claims(spark, sf):
    """Claims made from the evidence: some cite nothing, unknown ids, or a category of their own."""
    summary = findings.evidence_summary(evidence_rows(spark, sf)).select(*evidence.CANDIDATE, "evidence_ids")
    place = candidates(spark, sf).select(*evidence.CANDIDATE, "kept_position")
    ids = F.col("evidence_ids")
    number = F.col("kept_position")
    return summary.join(place, evidence.CANDIDATE).select(
        F.concat(F.lit("claim-"), "candidate_id").alias("claim_id"), "provider",
        F.when(number == 5, F.lit("no-such-candidate")).otherwise(F.col("candidate_id")).alias("candidate_id"),
        F.when(number == 2, F.lit("own_category")).otherwise(F.lit("")).alias("category"),
        F.lit(" stated cause ").alias("suspected_root_cause"), F.lit("").alias("recommendation"),
        F.lit("high").alias("risk"),
        F.when(number == 3, F.array().cast("array<string>"))
        .when(number == 4, F.concat(ids, F.array(F.lit("X-E999"))))
        .otherwise(ids).alias("evidence_ids"),
    )


@query("j12_refused_claims", with_(*CASE_SQL, SPECS, SCORES, CHOSEN_ROWS) + """
SELECT 'claim-' || candidate_id AS claim_id, provider,
  CASE WHEN kept_position = 5 THEN 'no-such-candidate' ELSE candidate_id END AS candidate_id,
  CASE kept_position WHEN 5 THEN 'unknown_candidate' WHEN 4 THEN 'unknown_evidence' ELSE 'no_evidence' END AS reason,
  CASE WHEN kept_position = 4 THEN 'X-E999' ELSE '' END AS unknown_ids
FROM picked WHERE kept_position IN (3, 4, 5)""")
def j12(spark, sf):
    return findings.refused_claims(claims(spark, sf), evidence_rows(spark, sf), candidates(spark, sf))


@query("c11_recorded_claims", with_(*ALL_SQL) + f""",
ownf AS (
  SELECT f.*, CASE WHEN kept_position = 2 THEN 'own_category' ELSE category END AS said FROM finding f
  WHERE kept_position NOT IN (3, 4, 5)),
oq AS (SELECT candidate_id AS qid, provider, 'cost_driver' AS rule_type, service_name AS service, said AS category,
  coalesce(spike, DATE '{CURRENT.end}') AS usage_date FROM ownf),
{rule_choice('oq', 'oa').strip()}
SELECT o.candidate_id, o.said AS category, a.rule_id,
  CAST(least(greatest(5, least(points, CASE WHEN kept_position = 2 THEN least(CAST(round(cap * 100) AS INTEGER), 80)
    ELSE CAST(round(cap * 100) AS INTEGER) END)), CASE WHEN NOT a.found THEN 45 WHEN a.is_stale OR a.is_undated THEN 60 ELSE 1000 END,
    CASE WHEN NOT driven AND said <> 'pricing_change' THEN 70 ELSE 1000 END) AS DOUBLE) / 100.0 AS confidence,
  CASE WHEN kept_position = 2 THEN 'high' ELSE risk END AS risk, evidence_count
FROM ownf o JOIN oa a ON a.qid = o.candidate_id""")
def c11(spark, sf):
    recorded = findings.record_claims(
        claims(spark, sf), candidates(spark, sf), chosen(spark, sf), evidence_rows(spark, sf),
        billing_rules(spark), gaps(spark, sf), CURRENT, F.lit(AS_OF),
    )
    return recorded.select("candidate_id", "category", "rule_id", "confidence", "risk", "evidence_count")


# ------------------------------------------------------------------ validation

VALIDATED = f"""
flawed AS (
  SELECT finding_id, provider, candidate_id, kept_position, category, is_uncertain, c - e AS measured, rule_id, is_stale, rule_valid_from,
    service_name, resource_id, CASE WHEN kept_position = 2 THEN cents * 2 ELSE cents END AS cents,
    CASE WHEN kept_position = 3 THEN 'res-nowhere' WHEN kept_position IN (4, 5) THEN 'res-shared' ELSE resource_id END AS listed,
    CASE WHEN kept_position = 6 THEN 0 ELSE evidence_count END AS evidence_count,
    CASE WHEN kept_position = 8 THEN 90 ELSE least(c0, c1, c2) END AS conf,
    CASE WHEN kept_position = 8 THEN ['cost'] ELSE kinds END AS kinds FROM finding),
judged AS (
  SELECT *, listed = 'res-nowhere' AS unknown, abs(cents * 10000 - measured) * 100 > greatest(greatest(abs(measured), 1000000), 2000000) AS drifted,
    evidence_count = 0 AS no_evidence, rule_id IS NULL AS no_rule, rule_id IS NOT NULL AND coalesce(is_stale, false) AS stale,
    rule_id IS NOT NULL AND kept_position = 7 AS retro FROM flawed),
capd AS (
  SELECT *, least(conf, CASE WHEN coalesce(unknown, false) THEN 40 ELSE 1000 END, CASE WHEN no_rule THEN 45 ELSE 1000 END,
    CASE WHEN stale THEN 60 ELSE 1000 END) AS c5,
    first_value(finding_id) OVER (PARTITION BY listed ORDER BY provider, cents DESC, kept_position) AS claimed_by FROM judged),
val AS (
  SELECT *, c5 >= 80 AND (evidence_count < 3 OR NOT list_has_any(kinds, ['metric', 'audit', 'recommendation'])) AS thin,
    NOT coalesce(unknown, false) AND listed IS NOT NULL AND claimed_by <> finding_id AS doubled FROM capd)"""
_DROPPED = "(no_evidence OR retro)"


@query("c5_validation_issues", with_(*ALL_SQL, VALIDATED) + """
SELECT finding_id, 'missing_evidence' AS code, 'error' AS severity FROM val WHERE no_evidence UNION ALL
SELECT finding_id, 'unsupported_resource_id', 'error' FROM val WHERE unknown UNION ALL
SELECT finding_id, 'cost_attribution_mismatch', 'error' FROM val WHERE drifted UNION ALL
SELECT finding_id, 'missing_rule_citation', 'warning' FROM val WHERE no_rule UNION ALL
SELECT finding_id, 'stale_billing_knowledge', 'warning' FROM val WHERE stale UNION ALL
SELECT finding_id, 'rule_applied_retroactively', 'error' FROM val WHERE retro UNION ALL
SELECT finding_id, 'insufficient_corroboration', 'warning' FROM val WHERE thin UNION ALL
SELECT finding_id, 'duplicate_resource_attribution', 'info' FROM val WHERE doubled""")
def c5_issues(spark, sf):
    return issues(spark, sf).select("finding_id", "code", "severity")


@query("c5_published_findings", with_(*ALL_SQL, VALIDATED) + f"""
SELECT finding_id, category, CAST(CASE WHEN thin THEN least(c5, 70) ELSE c5 END AS DOUBLE) / 100.0 AS confidence,
  CASE WHEN drifted THEN {half_even('measured', '10000', 2)} ELSE CAST(cents AS DOUBLE) / 100.0 END AS actual_cost_increase,
  is_uncertain OR coalesce(unknown, false) OR drifted OR no_rule OR stale AS is_uncertain,
  CASE WHEN coalesce(unknown, false) THEN '' ELSE coalesce(listed, '') END AS affected_resources
FROM val WHERE NOT {_DROPPED}""")
def c5_published(spark, sf):
    return published(spark, sf).select(
        "finding_id", "category", "confidence", "actual_cost_increase", "is_uncertain", "affected_resources"
    )


@query("c5_dropped_findings", with_(*ALL_SQL, VALIDATED) + f"SELECT finding_id, candidate_id FROM val WHERE {_DROPPED}")
def c5_dropped(spark, sf):
    return dropped(spark, sf).select("finding_id", "candidate_id")


@query("c6_cause_rewrite", with_(*ALL_SQL) + """
SELECT finding_id, 'unexplained_increase' AS category, least(confidence, 0.4) AS confidence, true AS is_uncertain,
  category <> 'unexplained_increase' AS was_rewritten FROM finding""")
def c6(spark, sf):
    """The same findings when only cost rows were supplied: no mechanism may be named."""
    rows = claimed(spark, sf)
    only_costs = coverage.available_source_types(coverage.present_kinds({"cost": scoped_costs(spark, sf)}))
    kept, _, noted = findings.validate(rows, None, candidates(spark, sf), only_costs)
    renamed = noted.filter(F.col("code") == "cause_unsupported_by_available_sources").select(
        "finding_id", F.lit(True).alias("was_rewritten")
    )
    return kept.join(renamed, "finding_id", "left").select(
        "finding_id", "category", "confidence", "is_uncertain",
        F.coalesce("was_rewritten", F.lit(False)).alias("was_rewritten"),
    )


@query("j7_finding_candidates", with_(*ALL_SQL) + """
SELECT finding_id, CASE WHEN kept_position = 1 THEN 'no-such-candidate' ELSE candidate_id END AS candidate_id,
  CASE WHEN kept_position > 1 THEN absolute_change END AS absolute_change, CASE WHEN kept_position > 1 THEN key END AS key FROM finding""")
def j7(spark, sf):
    """Each finding's candidate; the first finding of a provider names one that does not exist."""
    own = candidates(spark, sf).select("candidate_id", "absolute_change", "key")
    named = F.when(F.col("kept_position") == 1, "no-such-candidate").otherwise(F.col("candidate_id"))
    return claimed(spark, sf).select("finding_id", named.alias("candidate_id")).join(own, "candidate_id", "left").select(
        "finding_id", "candidate_id", "absolute_change", "key"
    )


@query("w8_duplicate_attribution", with_(COSTS, EVIDENCE) + """,
listed AS (SELECT event_id, r1 AS resource_id, seq FROM audit UNION ALL SELECT event_id, r2, seq FROM audit),
firsts AS (SELECT resource_id, arg_min(event_id, {'s': seq, 'e': event_id}) AS claimed_by FROM listed GROUP BY ALL)
SELECT l.event_id AS finding_id, l.resource_id, f.claimed_by FROM listed l JOIN firsts f USING (resource_id)
WHERE f.claimed_by <> l.event_id""")
def w8(spark, sf):
    """Later audit events naming a resource an earlier one named, by the finding rule."""
    listed = audit_rows(spark, sf).select(
        F.col("event_id").alias("finding_id"), "provider", "seq", F.explode("resource_ids").alias("resource_id")
    )
    return findings.duplicate_claims(listed).drop("provider")


@query("a18_reconciled_findings", with_(*ALL_SQL) + f""",
t AS (SELECT (SELECT sum(c) FROM changes) AS c, (SELECT sum(cents) * 10000 FROM finding) AS a),
p AS (SELECT provider, sum(b) AS b FROM changes GROUP BY provider),
e AS (SELECT sum(CAST(round({half_even(f'b * {CD}', str(BD), 0)}) AS HUGEINT)) AS e FROM p)
SELECT CAST(c - e AS DOUBLE) / 1000000.0 AS total_absolute_change, CAST(a AS DOUBLE) / 1000000.0 AS attributed_change,
  CAST(c - e - a AS DOUBLE) / 1000000.0 AS unattributed_change, abs(c - e - a) * 100 <= 5 * greatest(abs(c - e), 1000000) AS within_tolerance
FROM t, e""")
def a18(spark, sf):
    return findings.reconcile_findings(claimed(spark, sf), overall(spark, sf)).drop("total_percent_change")


def overall(spark, sf):
    def build():
        changed = compare.compare_keys(scoped_costs(spark, sf), CURRENT, BASELINE)
        return compare.overall_comparison(
            compare.provider_comparison(changed, candidates(spark, sf), CURRENT, BASELINE)
        )

    return _once(spark, sf, "overall", build)


@query("a19_support_figures", with_(*ALL_SQL, VALIDATED) + f"""
SELECT round(avg(CASE WHEN evidence_count > 0 AND rule_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS supported_claim_ratio,
  count(*) AS finding_count, (SELECT CAST(sum(CASE WHEN no_evidence THEN 1 ELSE 0 END + CASE WHEN coalesce(unknown, false) THEN 1 ELSE 0 END
    + CASE WHEN drifted THEN 1 ELSE 0 END + CASE WHEN retro THEN 1 ELSE 0 END) AS BIGINT) FROM val) AS unsupported_claims
FROM val WHERE NOT {_DROPPED}""")
def a19(spark, sf):
    return findings.support_figures(published(spark, sf), issues(spark, sf))


@query("o5_report_header", with_(*ALL_SQL) + """,
t AS (SELECT (SELECT sum(cents) FROM finding) AS cents, (SELECT count(*) FROM finding) AS n),
r AS (SELECT provider || ' ' || category AS cause, row_number() OVER (ORDER BY is_uncertain, cents DESC, confidence DESC, provider, kept_position) AS rank FROM finding)
SELECT CAST(cents AS DOUBLE) / 100.0 AS attributed_change, n AS finding_count,
  (SELECT array_to_string(list(cause ORDER BY rank), '|') FROM r WHERE rank <= 3) AS top_causes FROM t""")
def o5(spark, sf):
    ranked = findings.rank_findings(claimed(spark, sf))
    header = findings.report_header(
        ranked, findings.reconcile_findings(ranked, overall(spark, sf)),
        findings.support_figures(ranked, issues(spark, sf)),
    )
    return header.select("attributed_change", "finding_count", "top_causes")


@query("a22_least_verified_origin", with_(COSTS, EVIDENCE) + """
SELECT provider, strftime(min(data_through), '%Y-%m-%d %H:%M:%S') AS data_through,
  arg_min(origin, CASE origin WHEN 'upload' THEN 1 WHEN 'fixture' THEN 2 WHEN 'live' THEN 3 END) AS origin
FROM provenance GROUP BY provider""")
def a22(spark, sf):
    return coverage.provider_coverage(sources(spark, sf)).select("provider", "data_through", "origin")


@query("a21_data_through", with_(COSTS, EVIDENCE) + """
SELECT strftime(min(data_through), '%Y-%m-%d %H:%M:%S') AS data_through, count(*) AS sources FROM provenance""")
def a21(spark, sf):
    return provenance(spark, sf).agg(F.min("data_through").alias("data_through"), F.count(F.lit(1)).alias("sources"))


@query("a23_available_source_types", with_(COSTS, EVIDENCE) + """,
kinds AS (SELECT DISTINCT provider, t FROM (
  SELECT provider, unnest(['cost', 'usage']) AS t FROM scoped UNION ALL SELECT provider, 'inventory' FROM inv UNION ALL
  SELECT provider, 'metric' FROM points UNION ALL SELECT provider, 'audit' FROM audit UNION ALL SELECT provider, 'recommendation' FROM recs))
SELECT provider, array_to_string(list_sort(list(t)), '|') AS source_types FROM kinds GROUP BY provider""")
def a23(spark, sf):
    return available(spark, sf)


@query("u3_missing_cause_sources", with_(COSTS, EVIDENCE) + """,
have AS (SELECT resource_id, max(m) AS m, max(a) AS a FROM (
  SELECT resource_id, 0 AS m, 0 AS a FROM scoped WHERE resource_id IS NOT NULL UNION ALL SELECT resource_id, 1, 0 FROM points UNION ALL
  SELECT r1, 0, 1 FROM audit UNION ALL SELECT r2, 0, 1 FROM audit) GROUP BY ALL)
SELECT CASE WHEN m + a > 0 THEN '' ELSE 'metric|audit|inventory|recommendation' END AS missing, count(*) AS resources FROM have GROUP BY ALL""")
def u3(spark, sf):
    """Which resources have metric or audit data that could show a cause."""
    parts = [
        scoped_costs(spark, sf).filter("resource_id is not null").select("resource_id", F.lit("cost").alias("t")),
        metric_points(spark, sf).select("resource_id", F.lit("metric").alias("t")),
        audit_rows(spark, sf).select(F.explode("resource_ids").alias("resource_id"), F.lit("audit").alias("t")),
    ]
    per = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("resource_id").agg(F.collect_set("t").alias("ts"))
    return per.groupBy(findings.missing_cause_sources(F.col("ts")).alias("missing")).agg(F.count(F.lit(1)).alias("resources"))


@query("u4_evidence_set_tests", with_(*CASE_SQL, SPECS, SCORES, CHOSEN_ROWS) + """,
k AS (SELECT candidate_id, list_sort(list_distinct(list(source_type))) AS kinds FROM evid GROUP BY ALL)
SELECT candidate_id, array_to_string(list_filter(['metric', 'audit', 'recommendation'], lambda x: list_contains(kinds, x)), '|') AS corroborating,
  array_to_string(list_filter(['cost', 'usage', 'metric', 'audit'], lambda x: NOT list_contains(kinds, x)), '|') AS absent FROM k""")
def u4(spark, sf):
    kinds = findings.evidence_summary(evidence_rows(spark, sf))
    wanted = F.array(*[F.lit(k) for k in ("cost", "usage", "metric", "audit")])
    supporting = F.array(*[F.lit(k) for k in findings.CORROBORATING])
    return kinds.select(
        "candidate_id", F.array_intersect(supporting, F.col("kinds")).alias("corroborating"),
        F.array_except(wanted, F.col("kinds")).alias("absent"),
    )


@query("f11_lookups_by_key", with_(*ALL_SQL, VALIDATED) + """
SELECT 'evidence of candidate' AS lookup, count(*) AS rows FROM evid WHERE candidate_id = (SELECT min(candidate_id) FROM cand) UNION ALL
SELECT 'candidates of provider', count(*) FROM cand WHERE provider = 'aws' UNION ALL
SELECT 'issues of finding', CAST(sum(CASE WHEN drifted THEN 1 ELSE 0 END + CASE WHEN no_rule THEN 1 ELSE 0 END) AS BIGINT) FROM val WHERE finding_id = 'AWS-F02'""")
def f11(spark, sf):
    first = candidates(spark, sf).agg(F.min("candidate_id").alias("candidate_id"))
    own = filters.only_keys(evidence_rows(spark, sf), first, ["candidate_id"])
    parts = {
        "evidence of candidate": own,
        "candidates of provider": candidates(spark, sf).filter(F.col("provider") == "aws"),
        "issues of finding": issues(spark, sf).filter(F.col("finding_id") == "AWS-F02"),
    }
    counted = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("lookup"), "rows") for n, df in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("c7_investigation", with_(*ALL_SQL) + """
SELECT row_number() OVER (ORDER BY is_uncertain, cents DESC, confidence DESC, provider, kept_position) AS rank, finding_id, category,
  confidence, CAST(cents AS DOUBLE) / 100.0 AS actual_cost_increase, is_uncertain, rule_id, evidence_count FROM finding""")
def c7(spark, sf):
    out = investigate(spark, REQUEST, tables(spark, sf))
    return out["findings"].select(
        F.col("rank").cast("bigint").alias("rank"), "finding_id", "category", "confidence", "actual_cost_increase",
        "is_uncertain", "rule_id", "evidence_count",
    )
