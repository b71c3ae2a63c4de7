"""Registered comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendshift.operators import compare, filters
from spendshift.workloads.oracle import (
    BASE, BD, CANDIDATES, CD, COSTS, CUR, changes, half_even, micro, pick_first, with_,
)
from spendshift.workloads.registry import query
from spendshift.workloads.views import BASELINE, CURRENT, cost_rows, scoped_costs

_FIGURES = [
    "baseline_cost", "current_cost", "expected_baseline_cost", "absolute_change", "percent_change",
    "baseline_daily_average", "current_daily_average", "baseline_quantity", "current_quantity",
    "quantity_percent_change", "unit_cost_baseline", "unit_cost_current", "is_new",
]
_FIGURE_LIST = ", ".join(_FIGURES)

TAG_TEXT = (
    "concat_ws('|', 'env=' || tag_env, 'owner=' || tag_owner)"
)

DESCRIBE = f"""
own AS (SELECT k.* FROM keyed k SEMI JOIN cand USING (provider, dimension, key)),
svc AS (SELECT provider, dimension, key, service_name,
    coalesce(sum(effective_cost) FILTER (win = 'current'), 0) AS sc, min(seq) AS ss FROM own GROUP BY ALL),
dom AS (SELECT provider, dimension, key, CASE WHEN max(sc) > 0
    THEN arg_max(service_name, {{'c': sc, 's': -ss, 'n': service_name}})
    ELSE arg_min(service_name, {{'s': ss, 'n': service_name}}) END AS service_name FROM svc GROUP BY ALL),
firsts AS (SELECT provider, dimension, key,
    {pick_first('billing_account_id')} AS billing_account_id, {pick_first('region_id')} AS region_id,
    {pick_first('resource_id')} AS resource_id, {pick_first('resource_name')} AS resource_name,
    {pick_first('tag_env')} AS tag_env, {pick_first('tag_owner')} AS tag_owner,
    array_to_string(list_sort(list_distinct(list(sku_id))), '|') AS sku_ids FROM own GROUP BY ALL),
days AS (SELECT provider, dimension, key, usage_date, sum(effective_cost) AS dc FROM own
    WHERE win = 'current' GROUP BY ALL),
spikes AS (SELECT provider, dimension, key, min(usage_date) FILTER
    ({micro('dc')} * {2 * BD} > b * 3 AND dc > 0.01) AS spike FROM days JOIN cand USING (provider, dimension, key)
    GROUP BY ALL)"""


@query("a3_period_comparison", with_(COSTS, changes("keyed"), CANDIDATES, DESCRIBE) + f"""
SELECT candidate_id, provider, dimension, key, {_FIGURE_LIST}, service_name, billing_account_id, region_id,
  resource_id, resource_name, sku_ids, {TAG_TEXT} AS tags, strftime(spike, '%Y-%m-%d') AS first_spike_date,
  'USD' AS currency
FROM cand JOIN dom USING (provider, dimension, key) JOIN firsts USING (provider, dimension, key)
LEFT JOIN spikes USING (provider, dimension, key)""")
def a3(spark, sf):
    rows = compare.candidates(scoped_costs(spark, sf), CURRENT, BASELINE)
    return rows.select(
        "candidate_id", *compare.KEY, *_FIGURES, "service_name", "billing_account_id", "region_id",
        "resource_id", "resource_name", "sku_ids", "tags", "first_spike_date", "currency",
    )


@query("a3_all_key_changes", with_(COSTS, changes("keyed"))
       + f"SELECT provider, dimension, key, {_FIGURE_LIST} FROM changes")
def a3_all(spark, sf):
    return compare.compare_keys(scoped_costs(spark, sf), CURRENT, BASELINE).select(*compare.KEY, *_FIGURES)


PROVIDER_TOTALS = f"""
prov_int AS (SELECT provider, sum(c) AS c, sum(b) AS b FROM changes GROUP BY provider),
prov_exp AS (SELECT *, CAST(round({half_even(f'b * {CD}', str(BD), 0)}) AS HUGEINT) AS e FROM prov_int),
att AS (SELECT provider, sum(c - e) AS a, count(*) AS n FROM cand GROUP BY provider),
prov AS (SELECT provider, c, b, e, coalesce(a, 0) AS a, coalesce(n, 0) AS candidate_count
  FROM prov_exp LEFT JOIN att USING (provider))"""


def _reconcile_sql(total: str, attributed: str) -> str:
    return (
        f"CAST({attributed} AS DOUBLE) / 1000000.0 AS attributed_change, "
        f"CAST(({total}) - ({attributed}) AS DOUBLE) / 1000000.0 AS unattributed_change, "
        f"abs(({total}) - ({attributed})) * 100 <= 5 * greatest(abs({total}), 1000000) AS within_tolerance"
    )


@query("a17_provider_reconciliation", with_(COSTS, changes("keyed"), CANDIDATES, PROVIDER_TOTALS) + f"""
SELECT provider, CAST(c AS DOUBLE)/1000000.0 AS current_cost, CAST(b AS DOUBLE)/1000000.0 AS baseline_cost,
  CAST(e AS DOUBLE)/1000000.0 AS expected_baseline_cost, CAST(c-e AS DOUBLE)/1000000.0 AS absolute_change,
  {half_even('(c - e) * 100000', 'e', 3, 'e > 0')} AS percent_change, candidate_count,
  {_reconcile_sql('c - e', 'a')} FROM prov""")
def a17(spark, sf):
    changes_ = compare.compare_keys(scoped_costs(spark, sf), CURRENT, BASELINE)
    return compare.provider_comparison(
        changes_, compare.material_candidates(changes_), CURRENT, BASELINE
    )


@query("a6_all_provider_totals", with_(COSTS, changes("keyed"), CANDIDATES, PROVIDER_TOTALS) + f""",
overall AS (SELECT sum(c) AS c, sum(b) AS b, sum(e) AS e, sum(a) AS a FROM prov)
SELECT CAST(c AS DOUBLE)/1000000.0 AS total_current_cost, CAST(b AS DOUBLE)/1000000.0 AS total_baseline_cost,
  CAST(e AS DOUBLE)/1000000.0 AS total_expected_cost, CAST(c-e AS DOUBLE)/1000000.0 AS total_absolute_change,
  {half_even('(c - e) * 100000', 'e', 3, 'e > 0')} AS total_percent_change, {_reconcile_sql('c - e', 'a')}
FROM overall""")
def a6(spark, sf):
    return compare.overall_comparison(a17(spark, sf))


@query("a2_daily_totals", with_(COSTS) + f"""
SELECT p.provider, strftime(d.day, '%Y-%m-%d') AS usage_date, coalesce(CAST(sum(billed_cost) AS DOUBLE), 0.0) AS billed_cost,
  coalesce(CAST(sum(effective_cost) AS DOUBLE), 0.0) AS effective_cost
FROM (SELECT DISTINCT provider FROM scoped) p CROSS JOIN
  (SELECT CAST(unnest(generate_series(DATE '{CURRENT.start}', DATE '{CURRENT.end}', INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN scoped s ON s.provider = p.provider AND s.usage_date = d.day GROUP BY ALL""")
def a2(spark, sf):
    return compare.daily_totals(scoped_costs(spark, sf), CURRENT)


@query("a4_group_changes", with_(COSTS, changes("dims"))
       + f"SELECT provider, dimension, key, {_FIGURE_LIST} FROM changes")
def a4(spark, sf):
    return compare.group_changes(scoped_costs(spark, sf), CURRENT, BASELINE).select(*compare.KEY, *_FIGURES)


@query("a5_length_adjusted_baseline", with_(COSTS, changes("dims")) + """
SELECT provider, dimension, key, baseline_cost, expected_baseline_cost FROM changes WHERE dimension = 'account'""")
def a5(spark, sf):
    rows = compare.group_changes(scoped_costs(spark, sf), CURRENT, BASELINE, ["account"])
    return rows.select(*compare.KEY, "baseline_cost", "expected_baseline_cost")


@query("a7_total_cost", with_(COSTS) + """
SELECT 'effective' AS measure, CAST(sum(effective_cost) AS DOUBLE) AS total_cost FROM costs UNION ALL
SELECT 'billed', CAST(sum(billed_cost) AS DOUBLE) FROM costs""")
def a7(spark, sf):
    return compare.total_costs(cost_rows(spark, sf))


def _keyed(spark, sf):
    return compare.with_partition_key(
        filters.with_window(scoped_costs(spark, sf), CURRENT, BASELINE)
    )


def _facts(spark, sf, *kinds):
    return compare.describe_keys(_keyed(spark, sf), kinds)


@query("a8_dominant_service", with_(COSTS) + """,
svc AS (SELECT provider, dimension, key, service_name,
  coalesce(sum(effective_cost) FILTER (win = 'current'), 0) AS sc, min(seq) AS ss FROM keyed GROUP BY ALL)
SELECT provider, dimension, key, CASE WHEN max(sc) > 0
    THEN arg_max(service_name, {'c': sc, 's': -ss, 'n': service_name})
    ELSE arg_min(service_name, {'s': ss, 'n': service_name}) END AS service_name FROM svc GROUP BY ALL""")
def a8(spark, sf):
    return _facts(spark, sf, "service").select(*compare.KEY, "service_name")


@query("a9_sku_sets", with_(COSTS) + """
SELECT provider, dimension, key, array_to_string(list_sort(list_distinct(list(sku_id))), '|') AS sku_ids
FROM keyed GROUP BY ALL""")
def a9(spark, sf):
    return _facts(spark, sf, "sku").select(*compare.KEY, "sku_ids")


@query("a10_first_seen_attributes", with_(COSTS) + f"""
SELECT provider, dimension, key, {pick_first('billing_account_id')} AS billing_account_id,
  {pick_first('region_id')} AS region_id, {pick_first('resource_id')} AS resource_id,
  {pick_first('resource_name')} AS resource_name, 'USD' AS currency FROM keyed GROUP BY ALL""")
def a10(spark, sf):
    kinds = ("account", "region", "resource", "resource_name", "currency")
    return _facts(spark, sf, *kinds).select(
        *compare.KEY, "billing_account_id", "region_id", "resource_id", "resource_name", "currency"
    )


@query("a11_merged_tags", with_(COSTS) + f""",
firsts AS (SELECT provider, dimension, key, {pick_first('tag_env')} AS tag_env,
  {pick_first('tag_owner')} AS tag_owner FROM keyed GROUP BY ALL)
SELECT provider, dimension, key, {TAG_TEXT} AS tags FROM firsts""")
def a11(spark, sf):
    return _facts(spark, sf, "tag").select(*compare.KEY, "tags")


@query("a12_new_spend", with_(COSTS, changes("keyed"))
       + "SELECT provider, dimension, key, current_cost, is_new FROM changes WHERE is_new")
def a12(spark, sf):
    rows = compare.compare_keys(scoped_costs(spark, sf), CURRENT, BASELINE)
    return rows.filter("is_new").select(*compare.KEY, "current_cost", "is_new")


@query("a13_first_spike_dates", with_(COSTS, changes("keyed")) + f""",
days AS (SELECT provider, dimension, key, usage_date, sum(effective_cost) AS dc FROM keyed
  WHERE win = 'current' GROUP BY ALL)
SELECT provider, dimension, key, strftime(min(usage_date), '%Y-%m-%d') AS first_spike_date
FROM days JOIN changes USING (provider, dimension, key)
WHERE {micro('dc')} * {2 * BD} > b * 3 AND dc > 0.01 GROUP BY ALL""")
def a13(spark, sf):
    keyed = _keyed(spark, sf)
    described = compare.describe(keyed, compare.key_totals(keyed), BASELINE, ["day"])
    return described.select(*compare.KEY, "first_spike_date").filter("first_spike_date is not null")


@query("w1_group_positions", with_(COSTS, changes("dims")) + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY provider, dimension
  ORDER BY raw DESC, first_seq, key) - 1 AS position FROM changes)
SELECT provider || '-' || dimension || '-' || CASE WHEN position < 10 THEN '0' ELSE '' END || position AS candidate_id,
  provider, dimension, key, position, absolute_change FROM numbered""")
def w1(spark, sf):
    rows = compare.with_group_ids(compare.group_changes(scoped_costs(spark, sf), CURRENT, BASELINE))
    return rows.select("candidate_id", *compare.KEY, "position", "absolute_change")


@query("w2_top_material_candidates", with_(COSTS, changes("keyed"), CANDIDATES) + """
SELECT candidate_id, provider, dimension, key, pos AS position, kept_position, absolute_change FROM cand""")
def w2(spark, sf):
    kept = compare.material_candidates(compare.compare_keys(scoped_costs(spark, sf), CURRENT, BASELINE))
    return kept.select(
        "candidate_id", *compare.KEY, "position", F.col("kept_position").cast("bigint"), "absolute_change"
    )


@query("f1_scope_filter", with_(COSTS) + f"""
SELECT provider, billing_account_id, charge_category, count(*) AS rows, CAST(sum(billed_cost) AS DOUBLE) AS billed_cost
FROM costs WHERE provider IN ('aws', 'gcp') AND billing_account_id IN ('acct-1', 'acct-2', 'acct-3', 'acct-7')
  AND charge_category IN ('usage', 'purchase', 'adjustment') AND (({CUR}) OR ({BASE})) GROUP BY ALL""")
def f1(spark, sf):
    rows = filters.scope(
        cost_rows(spark, sf), periods=[CURRENT, BASELINE], providers=["aws", "gcp"],
        accounts=["acct-1", "acct-2", "", "acct-3", "acct-7"],
    )
    return rows.groupBy("provider", "billing_account_id", "charge_category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("billed_cost").alias("billed_cost")
    )


@query("f2_material_changes", with_(COSTS, changes("keyed")) + """
SELECT provider, dimension, key, absolute_change, percent_change, is_new FROM changes
WHERE c - e >= 5000000 AND (is_new OR percent_change IS NULL OR percent_change >= 20.0)""")
def f2(spark, sf):
    rows = compare.compare_keys(scoped_costs(spark, sf), CURRENT, BASELINE).filter(filters.is_material())
    return rows.select(*compare.KEY, "absolute_change", "percent_change", "is_new")


@query("f3_window_membership", with_(COSTS) + f"""
SELECT provider, CASE WHEN {CUR} THEN 'current' ELSE 'baseline' END AS "window", count(*) AS rows,
  CAST(sum(effective_cost) AS DOUBLE) AS effective_cost FROM costs WHERE ({CUR}) OR ({BASE}) GROUP BY ALL""")
def f3(spark, sf):
    rows = filters.with_window(cost_rows(spark, sf), CURRENT, BASELINE)
    return rows.groupBy("provider", "window").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("effective_cost").alias("effective_cost")
    )


@query("u1_union_of_providers", with_(COSTS) + """
SELECT provider, count(*) AS rows, CAST(sum(billed_cost) AS DOUBLE) AS billed_cost, min(seq) AS first_seq
FROM costs GROUP BY provider""")
def u1(spark, sf):
    costs = cost_rows(spark, sf)
    parts = [costs.filter(F.col("provider") == name) for name in ("aws", "azure", "gcp")]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy("provider").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("billed_cost").alias("billed_cost"), F.min("seq").alias("first_seq")
    )


_TOP25 = """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY provider, dimension ORDER BY raw DESC, first_seq, key) AS rn
  FROM changes WHERE dimension = '{0}')"""


@query("c9_cost_breakdown", with_(COSTS, changes("dims")) + _TOP25.format("tag_owner") + """,
own AS (SELECT d.* FROM dims d SEMI JOIN (SELECT * FROM numbered WHERE rn <= 25) USING (provider, dimension, key)),
svc AS (SELECT provider, dimension, key, service_name,
  coalesce(sum(effective_cost) FILTER (win = 'current'), 0) AS sc, min(seq) AS ss FROM own GROUP BY ALL),
dom AS (SELECT provider, dimension, key, CASE WHEN max(sc) > 0
    THEN arg_max(service_name, {'c': sc, 's': -ss, 'n': service_name})
    ELSE arg_min(service_name, {'s': ss, 'n': service_name}) END AS service_name FROM svc GROUP BY ALL),
firsts AS (SELECT provider, dimension, key, """ + f"""{pick_first('region_id')} AS region_id,
  {pick_first('resource_id')} AS resource_id FROM own GROUP BY ALL)
SELECT provider, key, service_name, region_id, resource_id, baseline_cost, expected_baseline_cost, current_cost,
  absolute_change, percent_change, quantity_percent_change, 'USD' AS currency
FROM numbered JOIN dom USING (provider, dimension, key) JOIN firsts USING (provider, dimension, key) WHERE rn <= 25""")
def c9(spark, sf):
    rows = compare.breakdown(scoped_costs(spark, sf), CURRENT, BASELINE, "tag_owner")
    return rows.select(
        "provider", "key", "service_name", "region_id", "resource_id", "baseline_cost",
        "expected_baseline_cost", "current_cost", "absolute_change", "percent_change",
        "quantity_percent_change", "currency",
    )


@query("o3_breakdown_top25", with_(COSTS, changes("dims")) + _TOP25.format("service") + """
SELECT provider, key, rn - 1 AS position, absolute_change FROM numbered WHERE rn <= 25""")
def o3(spark, sf):
    rows = compare.breakdown(scoped_costs(spark, sf), CURRENT, BASELINE, "no-such-dimension")
    return rows.select("provider", "key", "position", "absolute_change")


@query("p12_percent_change", with_(COSTS, changes("dims"))
       + "SELECT provider, dimension, key, percent_change, quantity_percent_change FROM changes")
def p12(spark, sf):
    rows = compare.group_changes(scoped_costs(spark, sf), CURRENT, BASELINE)
    return rows.select(*compare.KEY, "percent_change", "quantity_percent_change")


@query("p13_unit_cost", with_(COSTS, changes("dims"))
       + "SELECT provider, dimension, key, unit_cost_baseline, unit_cost_current FROM changes")
def p13(spark, sf):
    rows = compare.group_changes(scoped_costs(spark, sf), CURRENT, BASELINE)
    return rows.select(*compare.KEY, "unit_cost_baseline", "unit_cost_current")


@query("p14_quantity_driven", with_(COSTS, changes("keyed")) + """
SELECT provider, dimension, key, coalesce(quantity_percent_change >= 10, true) AS is_quantity_driven FROM changes""")
def p14(spark, sf):
    from spendshift.functions.money import is_quantity_driven

    rows = compare.compare_keys(scoped_costs(spark, sf), CURRENT, BASELINE)
    return rows.select(
        *compare.KEY, is_quantity_driven(F.col("quantity_percent_change")).alias("is_quantity_driven")
    )


@query("p20_monthly_impact", with_(COSTS, changes("keyed"), CANDIDATES) + f"""
SELECT candidate_id, {half_even('c - e', f'{CD} * 100', 4)} AS daily_delta,
  {half_even('(c - e) * 304', f'{CD} * 100000', 2)} AS estimated_monthly_impact FROM cand""")
def p20(spark, sf):
    from spendshift.functions.money import daily_delta, monthly_impact

    kept = compare.material_candidates(compare.compare_keys(scoped_costs(spark, sf), CURRENT, BASELINE))
    change = F.col("absolute_change")
    return kept.select(
        "candidate_id", daily_delta(change, CURRENT.days).alias("daily_delta"),
        monthly_impact(change, CURRENT.days).alias("estimated_monthly_impact"),
    )
