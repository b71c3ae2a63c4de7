"""Golden scenarios: the planted cause is found, measured and backed by evidence."""

from __future__ import annotations

import pytest

from spendshift.plans.investigate import investigate
from tests import scenarios as S

ALL = S.load()


# One investigation covers one scenario per cloud; the late export is judged on its own.
LATE = "aws-delayed-billing-data"
GROUPS = [
    ["aws-nat-gateway-misroute", "azure-functions-retry-loop", "gcp-compromised-api-key"],
    ["aws-cross-region-transfer", "azure-idle-database", "gcp-forgotten-vm"],
    ["aws-missing-ownership-tags", "azure-unattached-disk", "gcp-kubernetes-autoscaling"],
    ["aws-unexpected-ai-inference", "gcp-pricing-change-not-usage"],
    [LATE],
]


def test_groups_cover_all_scenarios():
    assert sorted(name for group in GROUPS for name in group) == sorted(ALL)


@pytest.mark.parametrize("group", GROUPS, ids=lambda group: group[0])
def test_scenarios(spark, group):
    chosen = [ALL[name] for name in group]
    out = investigate(spark, S.request(chosen), S.tables(spark, chosen))
    found = [row.asDict() for row in out["findings"].orderBy("rank").collect()]
    warnings = " ".join(row.warning for row in out["warnings"].collect()).lower()
    errors = [i.code for i in out["issues"].collect() if i.severity == "error"]
    assert errors == []
    for scenario in chosen:
        own = [f for f in found if f["provider"] == scenario["provider"]]
        check(scenario, own, warnings)
    if chosen[0]["expected"]["expect_reconciled"]:
        assert out["reconciliation"].first().within_tolerance
    if group == GROUPS[0]:
        check_report(out)


def check(scenario, found, warnings):
    expected = scenario["expected"]
    for phrase in expected["warnings"]:
        assert phrase.lower() in warnings
    assert not set(expected["forbidden"]) & {f["category"] for f in found[:3]}
    if not expected["expect_findings"]:
        assert found == []
        return
    top = expected["top"]
    places = [
        place for place, f in enumerate(found)
        if f["category"] == top["category"]
        and (not top.get("resource_id") or top["resource_id"] in f["affected_resources"])
    ]
    assert places and places[0] < 3, [(f["category"], f["affected_resources"]) for f in found]
    best = found[places[0]]
    wanted = top["cost_increase"]
    assert abs(float(best["actual_cost_increase"]) - wanted) <= max(top.get("cost_tolerance", 0.02) * wanted, 0.01)
    assert float(best["confidence"]) >= top.get("min_confidence", 0.0)
    assert float(best["confidence"]) <= top.get("max_confidence", 1.0)
    assert best["evidence_count"] >= top.get("min_evidence", 1)
    assert set(top.get("required_evidence_sources", [])) <= set(best["kinds"])
    assert set(top.get("required_rule_ids", [])) <= {best["rule_id"]}
    if top.get("expect_risk"):
        assert best["risk"] == top["expect_risk"]


def check_report(out):
    found = {f.category: f for f in out["findings"].collect()}
    assert float(found["nat_gateway_misroute"].actual_cost_increase) == 126.00
    assert float(found["functions_retry_loop"].actual_cost_increase) == 103.20
    assert float(found["api_key_abuse"].actual_cost_increase) == 161.60
    assert {float(f.confidence) for f in found.values()} == {0.92}
    header = out["header"].first()
    assert header.within_tolerance and header.explained_percent == 100.0
    assert header.top_causes[0] == "gcp api_key_abuse"
    assert {s.provider: s.status for s in out["statuses"].collect()} == {p: "ok" for p in ("aws", "azure", "gcp")}
    plan = {p.provider: p for p in out["plan"].collect()}
    assert plan["aws"].has_work and plan["aws"].must_explain[0].startswith("nat-")
    knowledge = out["knowledge"].first()
    assert "aws-nat-gateway-data-processing" in knowledge.rule_ids and knowledge.stale_rule_ids == []


def test_costs_alone_name_no_cause(spark):
    scenario = ALL["aws-nat-gateway-misroute"]
    t = S.tables(spark, [scenario])
    bare = {name: getattr(t, name).limit(0) for name in ("inventory", "points", "audit", "recommendations")}
    out = investigate(spark, S.request([scenario]), type(t)(**{**t.__dict__, **bare}))
    found = out["findings"].collect()
    assert [f.category for f in found] == ["unexplained_increase"]
    assert float(found[0].confidence) <= 0.40
    assert float(found[0].actual_cost_increase) == 126.00
    assert any("cause cannot be confirmed" in w.warning for w in out["warnings"].collect())
