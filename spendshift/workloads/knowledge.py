"""Registered rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendshift.operators import coverage, rules
from spendshift.sources.reference_tables import billing_rules, duplicate_rules
from spendshift.workloads.oracle import COSTS, EVIDENCE, RULES, rule_choice, with_
from spendshift.workloads.registry import query
from spendshift.workloads.views import AS_OF, CURRENT, cost_rows, provenance

# Category asked for each service of the derived cost rows, by a word in its name.
CATEGORY_WORDS = [
    ("Private Cloud", "nat_gateway_misroute"), ("Functions", "functions_retry_loop"), ("SQL", "idle_database"),
    ("Database", "idle_database"), ("Translation", "api_key_abuse"), ("Compute", "idle_compute"),
]


def _as_of():
    return F.lit(AS_OF)


def service_days(spark, sf):
    """Distinct questions the cost rows raise: provider, service and usage day."""
    chain = F
    for word, category in CATEGORY_WORDS:
        chain = chain.when(F.contains(F.col("service_name"), F.lit(word)), F.lit(category))
    days = cost_rows(spark, sf).groupBy("provider", "service_name", "usage_date").agg(
        F.count(F.lit(1)).alias("lines")
    )
    return days.select(
        "provider", F.col("service_name").alias("service"),
        chain.otherwise(F.lit(None).cast("string")).alias("category"),
        "usage_date", "lines",
    )


_CATEGORY_SQL = "CASE " + " ".join(
    f"WHEN contains(service_name, '{word}') THEN '{category}'" for word, category in CATEGORY_WORDS
) + " END"
DAYS = f"""
service_days AS (
  SELECT provider || '|' || service_name || '|' || usage_date AS qid, provider, service_name AS service,
    {_CATEGORY_SQL} AS category, usage_date, count(*) AS lines
  FROM costs GROUP BY provider, service_name, usage_date)"""


def _typed(rule_type: str, columns: str = "service, category") -> str:
    picked = {
        "service, category": "service, category",
        "": "CAST(NULL AS VARCHAR) AS service, CAST(NULL AS VARCHAR) AS category",
        "service": "service, CAST(NULL AS VARCHAR) AS category",
    }[columns]
    return (
        f"questions AS (SELECT qid, provider, '{rule_type}' AS rule_type, {picked}, usage_date, lines FROM service_days)"
    )


_ANSWER = """
SELECT provider, coalesce(rule_id, 'none') AS rule_id, found, used_generic, is_undated, coalesce(is_stale, false) AS is_stale,
  count(*) AS questions, CAST(sum(lines) AS BIGINT) AS lines FROM answered GROUP BY ALL"""


def _answers(df):
    return df.groupBy(
        "provider", F.coalesce("rule_id", F.lit("none")).alias("rule_id"), "found", "used_generic", "is_undated",
        F.coalesce("is_stale", F.lit(False)).alias("is_stale"),
    ).agg(F.count(F.lit(1)).alias("questions"), F.sum("lines").alias("lines"))


@query("j6_rule_selection", with_(COSTS, DAYS, RULES, _typed("cost_driver"), rule_choice("questions")) + """
SELECT provider, service, category, strftime(usage_date, '%Y-%m-%d') AS usage_date, found, rule_id, used_generic,
  is_undated, is_stale, strftime(rule_valid_from, '%Y-%m-%d') AS rule_valid_from FROM answered""")
def j6(spark, sf):
    asked = service_days(spark, sf).withColumn("rule_type", F.lit("cost_driver"))
    answered = rules.select_rules(asked, billing_rules(spark), _as_of())
    return answered.select(
        "provider", "service", "category", "usage_date", "found", "rule_id", "used_generic", "is_undated",
        "is_stale", "rule_valid_from",
    )


@query("c8_cost_driver_lookup", with_(COSTS, DAYS, RULES, _typed("cost_driver"), rule_choice("questions")) + _ANSWER)
def c8_drivers(spark, sf):
    return _answers(rules.rules_of_type(service_days(spark, sf), billing_rules(spark), "cost_driver", _as_of()))


@query("c8_freshness_lookup", with_(COSTS, DAYS, RULES, _typed("data_freshness", ""), rule_choice("questions")) + _ANSWER)
def c8_freshness(spark, sf):
    asked = service_days(spark, sf).drop("service", "category")
    return _answers(rules.rules_of_type(asked, billing_rules(spark), "data_freshness", _as_of()))


@query("c8_export_schema_lookup", with_(COSTS, DAYS, RULES, _typed("export_schema", ""), rule_choice("questions")) + _ANSWER)
def c8_schema(spark, sf):
    asked = service_days(spark, sf).drop("service", "category")
    return _answers(rules.rules_of_type(asked, billing_rules(spark), "export_schema", _as_of()))


@query("c8_api_status_lookup", with_(COSTS, DAYS, RULES, _typed("api_deprecation", "service"), rule_choice("questions")) + _ANSWER)
def c8_api(spark, sf):
    asked = service_days(spark, sf).drop("category")
    return _answers(rules.rules_of_type(asked, billing_rules(spark), "api_deprecation", _as_of()))


@query("c8_pricing_source_lookup", with_(COSTS, DAYS, RULES, _typed("pricing_source", "service"), rule_choice("questions")) + _ANSWER)
def c8_pricing(spark, sf):
    asked = service_days(spark, sf).drop("category")
    return _answers(rules.rules_of_type(asked, billing_rules(spark), "pricing_source", _as_of()))


@query("c8_focus_version_lookup", with_(COSTS, RULES) + f"""
SELECT c.provider, version, count(*) AS lines, r.id AS rule_id,
  CASE WHEN r.id IS NOT NULL THEN date_diff('day', r.reviewed_at, DATE '{AS_OF}') > 180 END AS is_stale
FROM (SELECT provider, CASE WHEN seq % 5 = 0 THEN '1.3' ELSE '1.4' END AS version FROM costs) c
LEFT JOIN rules r ON r.rule_type = 'focus_version' AND json_extract_string(r.data, '$.version') = c.version
GROUP BY ALL""")
def c8_focus(spark, sf):
    versions = cost_rows(spark, sf).groupBy(
        "provider", F.when(F.col("seq") % 5 == 0, "1.3").otherwise("1.4").alias("version")
    ).agg(F.count(F.lit(1)).alias("lines"))
    return rules.focus_rules(versions, billing_rules(spark), _as_of())


@query("s11_rule_corpus_matches", with_(COSTS, RULES) + """
SELECT r.id AS rule_id, r.provider, count(*) AS lines, CAST(sum(c.effective_cost) AS DOUBLE) AS effective_cost
FROM costs c JOIN rules r ON r.provider = c.provider AND len(list_filter(r.matches_services,
  lambda p: contains(lower(c.service_name), lower(p)))) > 0
WHERE r.id NOT IN (SELECT id FROM rules GROUP BY id HAVING count(*) > 1) GROUP BY ALL""")
def s11(spark, sf):
    """Load the rule corpus, drop ids that are not unique, and count the cost lines each rule covers."""
    from spendshift.functions.classify import contains_any

    corpus = billing_rules(spark)
    corpus = corpus.join(duplicate_rules(corpus).select("id"), "id", "left_anti")
    per_service = cost_rows(spark, sf).groupBy("provider", "service_name").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("effective_cost").alias("effective_cost")
    )
    matched = per_service.join(corpus.select("provider", "id", "matches_services"), "provider").filter(
        contains_any(F.col("service_name"), F.col("matches_services"))
    )
    return matched.groupBy(F.col("id").alias("rule_id"), "provider").agg(
        F.sum("lines").alias("lines"), F.sum("effective_cost").alias("effective_cost")
    )


@query("f7_rules_effective_per_day", with_(COSTS, DAYS, RULES) + """
SELECT strftime(d.usage_date, '%Y-%m') AS month, d.provider, count(DISTINCT r.id) AS effective_rules
FROM (SELECT DISTINCT provider, usage_date FROM service_days) d JOIN rules r ON r.provider = d.provider
  AND r.valid_from <= d.usage_date AND (r.valid_to IS NULL OR d.usage_date <= r.valid_to) GROUP BY ALL""")
def f7(spark, sf):
    days = service_days(spark, sf).select("provider", "usage_date").distinct()
    corpus = billing_rules(spark).select("provider", "id", "valid_from", "valid_to")
    live = days.join(corpus, "provider").filter(
        rules.effective_on(F.col("valid_from"), F.col("valid_to"), F.col("usage_date"))
    )
    return live.groupBy(F.date_format("usage_date", "yyyy-MM").alias("month"), "provider").agg(
        F.countDistinct("id").alias("effective_rules")
    )


@query("f8_stale_rules_per_day", with_(COSTS, DAYS, RULES) + """
SELECT strftime(d.day, '%Y-%m-%d') AS as_of, d.provider, count(*) AS stale_rules
FROM (SELECT DISTINCT provider, CAST(usage_date + INTERVAL 12 MONTH AS DATE) AS day FROM service_days) d
JOIN rules r ON r.provider = d.provider
WHERE r.reviewed_at IS NULL OR date_diff('day', r.reviewed_at, d.day) > 180 GROUP BY ALL""")
def f8(spark, sf):
    days = service_days(spark, sf).select("provider", F.add_months("usage_date", 12).alias("as_of")).distinct()
    corpus = billing_rules(spark).select("provider", "reviewed_at")
    stale = days.join(corpus, "provider").filter(rules.is_stale(F.col("reviewed_at"), F.col("as_of")))
    return stale.groupBy("as_of", "provider").agg(F.count(F.lit(1)).alias("stale_rules"))


@query("f9_known_billing_changes", with_(COSTS, DAYS, RULES) + """
, spans AS (SELECT provider, service, min(usage_date) AS "start", max(usage_date) AS last FROM service_days GROUP BY ALL),
ranges AS (SELECT provider, service, "start", CASE WHEN service <> 'Storage' THEN last END AS "end" FROM spans)
SELECT g.provider, g.service, r.id AS rule_id, strftime(r.valid_from, '%Y-%m-%d') AS valid_from
FROM ranges g JOIN rules r ON r.provider = g.provider AND r.rule_type = 'billing_change'
WHERE g."end" IS NULL OR r.valid_from BETWEEN g."start" AND g."end" """)
def f9(spark, sf):
    ranges = service_days(spark, sf).groupBy("provider", "service").agg(
        F.min("usage_date").alias("start"), F.max("usage_date").alias("last")
    ).withColumn("end", F.when(F.col("service") != "Storage", F.col("last")))
    found = rules.known_billing_changes(ranges, billing_rules(spark))
    return found.orderBy("provider", F.col("valid_from").asc_nulls_first()).select(
        "provider", "service", "rule_id", "valid_from"
    )


@query("a20_knowledge_provenance", with_(COSTS, DAYS, RULES, _typed("cost_driver"), rule_choice("questions")) + """
SELECT array_to_string(list_sort(list_distinct(list(rule_id))), '|') AS rule_ids,
  strftime(min(rule_reviewed_at), '%Y-%m-%d') AS oldest_review_date,
  strftime(max(rule_reviewed_at), '%Y-%m-%d') AS newest_review_date,
  array_to_string(coalesce(list_sort(list_distinct(list(rule_id) FILTER (is_stale))), CAST([] AS VARCHAR[])), '|') AS stale_rule_ids
FROM answered WHERE found""")
def a20(spark, sf):
    answered = rules.rules_of_type(service_days(spark, sf), billing_rules(spark), "cost_driver", _as_of())
    return rules.knowledge_provenance(answered.filter("found"))


@query("a27_freshness_gap", with_(COSTS, EVIDENCE, RULES) + f""",
cover AS (SELECT provider, min(data_through) AS data_through FROM provenance GROUP BY provider),
questions AS (SELECT provider AS qid, provider, 'data_freshness' AS rule_type, CAST(NULL AS VARCHAR) AS service,
  CAST(NULL AS VARCHAR) AS category, DATE '{CURRENT.end}' AS usage_date, data_through FROM cover),
{rule_choice('questions').strip()}
SELECT provider, strftime(data_through, '%Y-%m-%d %H:%M:%S') AS data_through, rule_id,
  coalesce(CAST(json_extract_string(data, '$.expected_delay_hours') AS DOUBLE), 48.0) AS expected_delay_hours,
  round(greatest(epoch(CAST(DATE '{CURRENT.end}' AS TIMESTAMP) + INTERVAL '86399' SECOND) - epoch(data_through), 0) / 3600, 1) AS gap_hours,
  epoch(CAST(DATE '{CURRENT.end}' AS TIMESTAMP) + INTERVAL '86399' SECOND) - epoch(data_through) > 0 AS is_incomplete
FROM answered""")
def a27(spark, sf):
    covered = coverage.provider_coverage(provenance(spark, sf)).select("provider", "data_through")
    asked = covered.withColumn("period_end", F.lit(CURRENT.end))
    return rules.freshness_gaps(asked, billing_rules(spark), _as_of()).select(
        "provider", "data_through", "rule_id", "expected_delay_hours", "gap_hours", "is_incomplete"
    )
