"""Static scenario data turned into input tables."""

from __future__ import annotations

import json
from datetime import date, datetime, time, timezone
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendshift.functions.classify import service_category
from spendshift.operators.coverage import KINDS
from spendshift.operators.evidence import metric_points_of
from spendshift.periods import Period
from spendshift.plans.investigate import Request, Tables
from spendshift.schemas import AUDIT, INVENTORY, METRICS, PROVENANCE, RECOMMENDATIONS
from spendshift.sources.reference_tables import billing_rules, playbooks
from tests.rows import cost, cost_table, days

AS_OF = date(2026, 8, 1)


def load() -> dict[str, dict]:
    lines = (Path(__file__).parent / "data" / "scenarios.jsonl").read_text().splitlines()
    return {s["id"]: s for s in map(json.loads, lines)}


def period(pair) -> Period:
    return Period(*map(date.fromisoformat, pair))


def _on(series, day, current, plain, changed):
    starts = date.fromisoformat(series["starts_on"]) if series.get("starts_on") else date.min
    if day in current and series.get(changed) is not None and day >= starts:
        return series[changed]
    return series.get(plain, 0.0)


def _costs(scenario):
    current = set(days(period(scenario["current"])))
    last = date.fromisoformat(scenario["omit_costs_after"]) if scenario["omit_costs_after"] else date.max
    for day in days(period(scenario["baseline"])) + sorted(current):
        for series in scenario["series"]:
            amount = _on(series, day, current, "daily_cost", "current_daily_cost")
            quantity = _on(series, day, current, "daily_quantity", "current_daily_quantity")
            if day > last or (amount == 0 and quantity == 0):
                continue
            yield cost(
                day, amount, quantity, provider=scenario["provider"], billing_account_id=scenario["account"],
                service_name=series["service"], sku_id=series.get("sku"), resource_id=series.get("resource_id"),
                resource_name=series.get("resource_name"), region_id=series.get("region") or scenario["region"],
                tags=series.get("tags", {}),
            )


def _table(spark, rows, schema):
    names = schema.names
    data = [tuple(r.get(n) for n in names) + (seq,) for seq, r in enumerate(rows)]
    return spark.createDataFrame(data, schema.add("seq", T.LongType()) if "seq" not in names else schema)


def tables(spark, scenarios) -> Tables:
    costs, inventory, metrics, audit, advice, sources = [], [], [], [], [], []
    for s in scenarios:
        own = {"provider": s["provider"]}
        current = set(days(period(s["current"])))
        all_days = days(period(s["baseline"])) + sorted(current)
        costs += list(_costs(s))
        inventory += [{**own, **r} for r in s["resources"]]
        for m in s["metrics"]:
            points = [
                (datetime.combine(d, time(12), timezone.utc),
                 float(_on(m, d, current, "baseline_daily_value", "current_daily_value")))
                for d in all_days
            ]
            metrics.append({**own, "unit": "Count", "statistic": "Sum", **m, "points": points})
        audit += [
            {**own, "event_id": f"{s['id']}-{n}", "source": "log", "actor": "someone", "summary": "detail",
             **a, "event_time": datetime.fromisoformat(a["event_time"])}
            for n, a in enumerate(s["audit"])
        ]
        advice += [
            {**own, "source": "advisor", "description": "advice", "currency": "USD",
             "estimated_monthly_savings": float(r["saving"]), **r}
            for r in s["recommendations"]
        ]
        through = s["data_through"] or f"{s['current'][1]} 23:59:59+00:00"
        stamp = datetime.fromisoformat(through)
        sources += [
            {**own, "kind": kind, "source": f"{kind}-export", "schema_version": "1", "observed_at": stamp,
             "retrieved_at": stamp, "data_through": stamp, "origin": "fixture", "query_reference": ""}
            for kind in KINDS
        ]
    import copy

    build = lambda rows, schema: _table(spark, rows, copy.deepcopy(schema))
    cost_df = cost_table(spark, costs).withColumn("service_category", service_category(F.col("service_name")))
    return Tables(
        costs=cost_df, inventory=build(inventory, INVENTORY),
        points=metric_points_of(build(metrics, METRICS)), audit=build(audit, AUDIT),
        recommendations=build(advice, RECOMMENDATIONS), provenance=build(sources, PROVENANCE).drop("seq"),
        rules=billing_rules(spark), playbooks=playbooks(spark),
    )


def request(scenarios) -> Request:
    first = scenarios[0]
    return Request(
        current=period(first["current"]), baseline=period(first["baseline"]), as_of=AS_OF,
        providers=sorted({s["provider"] for s in scenarios}), accounts=[s["account"] for s in scenarios],
    )
