"""DuckDB text of the derived tables, and small SQL builders for exact rounding."""

from __future__ import annotations

import json
import re

from spendshift.functions.classify import SERVICE_CATEGORIES
from spendshift.sources.reference_tables import _lines
from spendshift.workloads.views import AS_OF, AUDIT_NAMES, BASELINE, CURRENT, METRICS, PART_TYPES, SERVICES, SHIFT_MONTHS


def half_even(numerator: str, denominator: str, places: int, when: str | None = None) -> str:
    """Half-even rounding of an integer quotient, as a double with ``places`` decimals."""
    n, d = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    floor = f"(({n}) // ({d}) - CASE WHEN ({n}) % ({d}) < 0 THEN 1 ELSE 0 END)"
    rest = f"(({n}) - ({floor}) * ({d}))"
    up = f"CASE WHEN 2*{rest} > ({d}) OR (2*{rest} = ({d}) AND ({floor}) % 2 <> 0) THEN 1 ELSE 0 END"
    text = f"(CAST({floor} + {up} AS DOUBLE) / {10 ** places}.0)"
    return f"CASE WHEN {when} THEN {text} END" if when else text


def micro(expression: str) -> str:
    """A six-decimal amount as whole millionths."""
    return f"CAST(({expression}) * 1000000 AS HUGEINT)"


def case_map(names: dict[str, dict[str, str]], provider: str, item: str) -> str:
    lines = [
        f"WHEN {provider}='{owner}' AND {item}='{key}' THEN '{value}'"
        for owner, mapping in names.items()
        for key, value in mapping.items()
    ]
    return "CASE " + " ".join(lines) + " END"


def category_case(service: str) -> str:
    lines = [
        f"WHEN regexp_matches(lower({service}), '{'|'.join(re.escape(k) for k in keys)}') THEN '{name}'"
        for name, keys in SERVICE_CATEGORIES
    ]
    return "CASE " + " ".join(lines) + " ELSE 'Other' END"


_SERVICE_NAMES = {owner: dict(zip(PART_TYPES, names)) for owner, names in SERVICES.items()}

CUR = f"usage_date BETWEEN DATE '{CURRENT.start}' AND DATE '{CURRENT.end}'"
BASE = f"usage_date BETWEEN DATE '{BASELINE.start}' AND DATE '{BASELINE.end}'"
CD, BD = CURRENT.days, BASELINE.days

PROVIDER = "CASE {0} % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'azure' ELSE 'gcp' END"

COSTS = f"""
cost_base AS (
  SELECT {PROVIDER.format('l_suppkey')} AS provider, l.*, p_name, p_type, p_brand, s_name, n_nationkey, n_name
  FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey),
costs AS (
  SELECT provider, 'acct-' || n_nationkey AS billing_account_id, CAST(CAST(l_shipdate AS DATE) + INTERVAL {SHIFT_MONTHS} MONTH AS DATE) AS usage_date,
    {case_map(_SERVICE_NAMES, 'provider', 'p_type')} AS service_name,
    CASE l_returnflag WHEN 'N' THEN 'usage' WHEN 'A' THEN 'adjustment' ELSE 'credit' END AS charge_category,
    p_name AS charge_description,
    CASE WHEN n_nationkey <> 7 THEN n_name END AS region_id,
    CASE WHEN l_partkey % 10 = 0 THEN NULL WHEN l_partkey % 2 = 1 THEN 'res-' || l_suppkey
         ELSE 'res-p' || l_partkey END AS resource_id,
    CASE WHEN l_partkey % 10 <> 0 AND l_partkey % 3 > 0 THEN p_name END AS resource_name,
    CASE WHEN provider = 'aws' AND p_type = 'ECONOMY' THEN 'NatGateway-Bytes' ELSE p_brand END AS sku_id,
    CAST(l_quantity AS DECIMAL(18,6)) AS usage_quantity, 'unit' AS usage_unit,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,6)) AS billed_cost,
    CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,6)) AS effective_cost,
    'USD' AS currency, l_linestatus AS tag_env,
    CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE s_name END AS tag_owner,
    CASE WHEN l_tax >= 0.07 THEN 'cd-' || (l_suppkey % 5) END AS commitment_discount_id,
    l_orderkey || '-' || l_linenumber AS source_record_id,
    l_orderkey * 10 + l_linenumber AS seq
  FROM cost_base),
scoped AS (
  SELECT *, CASE WHEN {CUR} THEN 'current' ELSE 'baseline' END AS win FROM costs
  WHERE charge_category IN ('usage', 'purchase', 'adjustment') AND (({CUR}) OR ({BASE}))),
keyed AS (
  SELECT *, CASE WHEN resource_id IS NOT NULL THEN 'resource' ELSE 'service' END AS dimension,
    coalesce(resource_id, service_name) AS key FROM scoped),
dims AS (
  SELECT *, 'service' AS dimension, service_name AS key FROM scoped UNION ALL
  SELECT *, 'region', coalesce(region_id, 'unknown-region') FROM scoped UNION ALL
  SELECT *, 'account', billing_account_id FROM scoped UNION ALL
  SELECT *, 'resource', resource_id FROM scoped WHERE resource_id IS NOT NULL UNION ALL
  SELECT *, 'tag_owner', coalesce(tag_owner, 'untagged') FROM scoped)"""


def changes(source: str, name: str = "changes") -> str:
    """Totals and changes per key of a keyed table."""
    return f"""
{name}_sums AS (
  SELECT provider, dimension, key,
    coalesce(sum(effective_cost) FILTER (win = 'current'), 0) AS cc,
    coalesce(sum(effective_cost) FILTER (win = 'baseline'), 0) AS bc,
    coalesce(sum(usage_quantity) FILTER (win = 'current'), 0) AS cq,
    coalesce(sum(usage_quantity) FILTER (win = 'baseline'), 0) AS bq,
    min(seq) AS first_seq
  FROM {source} GROUP BY ALL),
{name}_int AS (
  SELECT *, {micro('cc')} AS c, {micro('bc')} AS b, {micro('cq')} AS q, {micro('bq')} AS bqi FROM {name}_sums),
{name}_exp AS (
  SELECT *, CAST(round({half_even(f'b * {CD}', str(BD), 0)}) AS HUGEINT) AS e FROM {name}_int),
{name} AS (
  SELECT provider, dimension, key, first_seq, c, b, e, q, bqi, c - b AS raw,
    CAST(cc AS DOUBLE) AS current_cost, CAST(bc AS DOUBLE) AS baseline_cost,
    CAST(e AS DOUBLE) / 1000000.0 AS expected_baseline_cost,
    CAST(c - e AS DOUBLE) / 1000000.0 AS absolute_change,
    {half_even('(c - e) * 100000', 'e', 3, 'e > 0')} AS percent_change,
    {half_even('b', str(BD), 6)} AS baseline_daily_average,
    {half_even('c', str(CD), 6)} AS current_daily_average,
    CAST(cq AS DOUBLE) AS current_quantity, CAST(bq AS DOUBLE) AS baseline_quantity,
    {half_even(f'(q * {BD} - bqi * {CD}) * 100000', f'bqi * {CD}', 3, 'bqi > 0')} AS quantity_percent_change,
    {half_even('b * 100000000', 'bqi', 8, 'bqi > 0')} AS unit_cost_baseline,
    {half_even('c * 100000000', 'q', 8, 'q > 0')} AS unit_cost_current,
    b <= 0 AND c > 0 AS is_new
  FROM {name}_exp)"""


CANDIDATES = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY provider ORDER BY raw DESC, first_seq, dimension, key) - 1 AS pos
  FROM changes),
material AS (
  SELECT *, row_number() OVER (PARTITION BY provider ORDER BY raw DESC, first_seq, dimension, key) AS kept_position
  FROM ranked WHERE c - e >= 5000000 AND (is_new OR percent_change IS NULL OR percent_change >= 20.0)),
cand AS (
  SELECT *, provider || '-cand-' || CASE WHEN pos < 10 THEN '0' ELSE '' END || pos AS candidate_id
  FROM material WHERE kept_position <= 8)"""

_STAMP = (
    f"CAST(DATE '{BASELINE.start}' + CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 12 AS INTEGER) "
    "AS TIMESTAMP) + to_seconds(CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT))"
)

EVIDENCE = f"""
stretched AS (SELECT *, {_STAMP} AS event_time, {PROVIDER.format('user_id')} AS provider FROM events),
points AS (
  SELECT provider, 'res-' || user_id AS resource_id, {case_map(METRICS, 'provider', 'event_type')} AS metric_name,
    CAST(event_time AS DATE) AS point_date, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DECIMAL(18,6)) AS value,
    min(event_id) AS seq
  FROM stretched GROUP BY ALL),
audit AS (
  SELECT provider, 'evt-' || event_id AS event_id, {case_map(AUDIT_NAMES, 'provider', 'event_type')} AS event_name,
    event_time, 'res-' || user_id AS r1, 'res-' || (user_id + 3) AS r2, 'user-' || user_id AS actor,
    props AS summary, event_id AS seq
  FROM stretched),
inv_base AS (
  SELECT p_partkey AS n, 'res-p' || p_partkey AS resource_id, p_name AS resource_name, p_type AS resource_type,
    p_size % 4 AS st, p_brand AS owner FROM part
  UNION ALL
  SELECT s_suppkey, 'res-' || s_suppkey, s_name, 'SHARED', s_nationkey % 4, s_name FROM supplier),
inv AS (
  SELECT {PROVIDER.format('n')} AS provider, resource_id, resource_name, resource_type,
    CASE WHEN copy = 1 THEN 'deleted' WHEN st = 0 THEN 'stopped' ELSE 'running' END AS state,
    CASE WHEN n % 4 = 0 THEN owner END AS tag_owner, CASE WHEN n % 4 <> 0 THEN owner END AS tag_tier,
    n * 2 + copy AS seq
  FROM inv_base, (VALUES (0), (1)) v(copy) WHERE copy = 0 OR n % 5 = 0),
recs AS (
  SELECT {PROVIDER.format('p_partkey')} AS provider, 'rec-' || p_partkey AS recommendation_id,
    lower(p_type) AS category,
    'res-' || CASE WHEN p_partkey % 2 = 0 THEN 'p' ELSE '' END || p_partkey AS resource_id, p_name AS description,
    CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 0.01 AS DOUBLE) AS estimated_monthly_savings,
    p_partkey AS seq
  FROM part),
provenance AS (
  SELECT provider, kind, provider || '-' || kind || '-export' AS source,
    CAST(last AS TIMESTAMP) + INTERVAL '86399' SECOND AS data_through,
    CASE WHEN kind = 'cost' THEN 'upload' ELSE 'fixture' END AS origin,
    CASE WHEN kind = 'cost' THEN 'query-' || provider ELSE '' END AS query_reference
  FROM (
    SELECT provider, 'cost' AS kind, max(usage_date) AS last FROM costs GROUP BY ALL UNION ALL
    SELECT provider, 'audit', max(CAST(event_time AS DATE)) FROM audit GROUP BY ALL UNION ALL
    SELECT provider, 'metrics', max(point_date) FROM points GROUP BY ALL))"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(part.strip("\n") for part in parts) + "\n"


def pick_first(column: str) -> str:
    """First filled value of a column by (seq, value)."""
    filled = f"{column} IS NOT NULL AND {column} <> ''"
    return f"arg_min({column}, {{'s': seq, 'v': {column}}}) FILTER ({filled})"


# ------------------------------------------------------------------ rules and playbooks as SQL values


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "CAST([" + ", ".join(_literal(v) for v in value) + "] AS VARCHAR[])"
    if isinstance(value, dict):
        return _literal(json.dumps(value))
    return "'" + str(value).replace("'", "''") + "'"


def _values(name: str, records: list[dict], columns: list[str], casts: dict[str, str]) -> str:
    rows = ", ".join(
        "(" + ", ".join([str(seq)] + [_literal(r.get(c)) for c in columns]) + ")"
        for seq, r in enumerate(records)
    )
    picked = ", ".join(
        ["seq"] + [f"CAST({c} AS {casts[c]}) AS {c}" if c in casts else c for c in columns]
    )
    return f"{name} AS (SELECT {picked} FROM (VALUES {rows}) v(seq, {', '.join(columns)}))"


_DATES = {c: "DATE" for c in ("valid_from", "valid_to", "reviewed_at")}
RULES = _values(
    "rules", _lines("rules.jsonl"),
    ["id", "provider", "rule_type", "service", "valid_from", "valid_to", "reviewed_at", "confidence",
     "matches_categories", "matches_services", "source_url", "data"],
    _DATES,
)
SPECS = _values(
    "specs", _lines("playbooks.jsonl"),
    ["provider", "category", "priority", "max_confidence", "risk", "service_patterns", "sku_patterns",
     "metric_names", "audit_event_patterns", "low_utilization_metrics", "low_utilization_threshold",
     "requires_quantity_growth", "requires_rate_change", "requires_missing_owner"],
    {},
)


def contains_any(value: str, patterns: str) -> str:
    return (
        f"coalesce(len(list_filter({patterns}, lambda p: contains(lower({value}), lower(p)))) > 0, false)"
    )


def rule_choice(questions: str, name: str = "answered") -> str:
    """Relational rule selection for a table (qid, provider, rule_type, service, category, usage_date)."""
    return f"""
{name}_keys AS (SELECT DISTINCT provider, rule_type, service, category FROM {questions}),
{name}_scored AS (
  SELECT q.*, r.seq, r.id, r.valid_from, r.valid_to, r.reviewed_at, r.confidence AS status, r.data, r.source_url,
    len(r.matches_services) = 0 AND len(r.matches_categories) = 0 AS generic,
    CASE WHEN q.category IS NOT NULL AND list_contains(r.matches_categories, q.category) THEN 3
      WHEN q.service IS NOT NULL AND lower(r.service) = lower(q.service) THEN 2
      WHEN q.service IS NOT NULL AND len(list_filter(r.matches_services, lambda p:
        contains(lower(q.service), lower(p)) OR contains(lower(p), lower(q.service)))) > 0 THEN 1
      WHEN q.service IS NOT NULL OR q.category IS NOT NULL THEN 0
      WHEN len(r.matches_services) = 0 AND len(r.matches_categories) = 0 THEN 1 ELSE 0 END AS score
  FROM {name}_keys q JOIN rules r ON r.provider = q.provider AND r.rule_type = q.rule_type),
{name}_best AS (SELECT *, max(score) OVER (PARTITION BY provider, rule_type, service, category) AS best FROM {name}_scored),
{name}_dated AS (SELECT DISTINCT provider, rule_type, service, category, usage_date FROM {questions}),
{name}_pool AS (
  SELECT b.*, d.usage_date, valid_from <= d.usage_date AND (valid_to IS NULL OR d.usage_date <= valid_to) AS effective
  FROM {name}_best b JOIN {name}_dated d ON b.provider = d.provider AND b.rule_type = d.rule_type
    AND b.service IS NOT DISTINCT FROM d.service AND b.category IS NOT DISTINCT FROM d.category
  WHERE (best > 0 AND score = best) OR (best = 0 AND generic)),
{name}_pick AS (
  SELECT *, row_number() OVER (PARTITION BY provider, rule_type, service, category, usage_date ORDER BY
    CASE WHEN usage_date IS NULL THEN 0 WHEN effective THEN 0 WHEN valid_from IS NULL THEN 1 ELSE 2 END,
    CASE WHEN usage_date IS NULL OR effective THEN coalesce(valid_from, DATE '0001-01-01') END DESC NULLS LAST,
    seq) AS n FROM {name}_pool),
{name}_one AS (
  SELECT q.qid, id, valid_from, reviewed_at, status, data, source_url, best,
    p.usage_date IS NULL OR effective OR valid_from IS NULL AS found,
    p.usage_date IS NOT NULL AND valid_from IS NULL AS undated
  FROM {questions} q JOIN {name}_pick p ON n = 1 AND q.provider = p.provider AND q.rule_type = p.rule_type
    AND q.service IS NOT DISTINCT FROM p.service AND q.category IS NOT DISTINCT FROM p.category
    AND q.usage_date IS NOT DISTINCT FROM p.usage_date),
{name} AS (
  SELECT q.*, coalesce(o.found, false) AS found, CASE WHEN o.found THEN o.id END AS rule_id,
    coalesce(o.best = 0, false) AS used_generic, coalesce(o.found AND o.undated, false) AS is_undated,
    CASE WHEN o.found THEN coalesce(date_diff('day', o.reviewed_at, DATE '{AS_OF}') > 180, true) END AS is_stale,
    CASE WHEN o.found THEN o.valid_from END AS rule_valid_from,
    CASE WHEN o.found THEN o.reviewed_at END AS rule_reviewed_at, CASE WHEN o.found THEN o.data END AS data
  FROM {questions} q LEFT JOIN {name}_one o USING (qid))"""
