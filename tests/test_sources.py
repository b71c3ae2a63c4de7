"""Native exports, landing checks, ingest and store on small files."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from spendshift.functions import parsing
from spendshift.functions.classify import reconciled_origin, service_category
from spendshift.operators import coverage
from spendshift.plans.ingest import RefusedUpload, ingest_costs
from spendshift.sources import landing, native, store


def write(tmp_path, name, content):
    folder = tmp_path / name.split(".")[0]
    folder.mkdir()
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))
    return str(folder)


def aws_row(n, hour=None, **fields):
    return {
        "identity_line_item_id": f"aws-{n}", "line_item_usage_account_id": "1111",
        "line_item_usage_start_date": "2026-07-15" if hour is None else f"2026-07-15T{hour:02d}:00:00Z",
        "line_item_line_item_type": "Usage", "product_servicename": "Amazon Virtual Private Cloud",
        "line_item_resource_id": "arn:aws:ec2:us-east-1:1111:natgateway/nat-1", "line_item_usage_type": "NatGateway-Bytes",
        "line_item_usage_amount": 580, "pricing_unit": "GB", "line_item_unblended_cost": 26.1, "line_item_currency_code": "USD",
        "resource_tags": {"env": "prod"}, **fields,
    }


@pytest.mark.parametrize("shape", ["rows", "items", "array"])
def test_aws_containers(spark, tmp_path, shape):
    rows = [aws_row(1), aws_row(2, line_item_line_item_type="SavingsPlanCoveredUsage", resource_tags='{"a":"b"}', line_item_net_amortized_cost="")]
    document = rows if shape == "array" else {shape: [*rows, "stray"]}
    got = native.native_costs(spark, write(tmp_path, "aws.json", document), "aws-cur-json").orderBy("source_record_id").collect()
    assert len(got) == 2
    first, second = got
    assert first.usage_date == date(2026, 7, 15) and first.resource_name == "nat-1" and first.service_category == "Networking"
    assert float(first.effective_cost) == float(first.billed_cost) == 26.1 and first.tags == {"env": "prod"}
    assert second.charge_category == "usage" and second.tags == {"a": "b"} and float(second.effective_cost) == 26.1


def test_azure_columns_decide_not_their_order(spark, tmp_path):
    names = ["Cost", "UsageDate", "MeterCategory", "ResourceId", "Tags", "ChargeType", "UsageQuantity"]
    row = [12.5, 20260713, "Virtual Machines", "/subscriptions/s/vm/web-1", '{"owner":"x"}', "UnusedReservation", "24"]
    short = [1.0, 20260714, "Storage"]
    document = {"properties": {"columns": [{"name": n, "type": "t"} for n in names], "rows": [row, short]}}
    got = native.native_costs(spark, write(tmp_path, "azure.json", document), "azure-cost-management-json").orderBy("source_record_id").collect()
    assert got[0].usage_date == date(2026, 7, 13) and float(got[0].billed_cost) == 12.5 and got[0].resource_name == "web-1"
    assert got[0].tags == {"owner": "x"} and got[0].charge_category == "usage" and float(got[0].usage_quantity) == 24
    assert got[1].service_name == "Storage" and got[1].resource_id is None and got[1].source_record_id == "azure-row-azure.json-1-1"


GCP = (
    "billing_account_id,service.description,sku.id,usage_start_time,usage_end_time,resource.name,usage.amount,cost,currency,credits.amount,labels\n"
    '01,Compute Engine,S1,2026-07-13T00:00:00Z,2026-07-14T00:00:00Z,vm-1,24,41.0,USD,-1.0,"[{""key"":""owner"",""value"":""a""}]"\n'
    "01,Cloud SQL,S2,2026-07-14T00:00:00Z,2026-07-14T14:00:00Z,db-1,14,-3.0,USD,,\n"
)


def test_gcp_credits_are_added(spark, tmp_path):
    got = native.native_costs(spark, write(tmp_path, "gcp.csv", GCP), "gcp-billing-export-csv").orderBy("usage_date").collect()
    assert float(got[0].billed_cost) == 41.0 and float(got[0].effective_cost) == 40.0 and got[0].tags == {"owner": "a"}
    assert got[1].charge_category == "credit"


def test_gcp_partial_day(spark, tmp_path):
    done = ingest_costs(spark, write(tmp_path, "gcp.csv", GCP), "gcp")
    assert done.detected_format == "gcp-billing-export-csv"
    through = done.data_through.first()
    assert through.is_partial and through.data_through == datetime(2026, 7, 13, 23, 59, 59)


def test_aws_partial_day_and_hourly_rollup(spark, tmp_path):
    full = [aws_row(h, h) | {"line_item_usage_start_date": f"2026-07-14T{h:02d}:00:00Z"} for h in range(24)]
    cut = [aws_row(100 + h, h) for h in range(9)]
    bad = [aws_row(200, 3, product_servicename="", line_item_product_code="")]
    done = ingest_costs(spark, write(tmp_path, "aws.json", {"rows": full + cut + bad}), "aws")
    through = done.data_through.first()
    assert through.last_hours == 9 and through.data_through == datetime(2026, 7, 14, 23, 59, 59)
    report = done.report.first()
    assert (report.raw_rows, report.accepted_rows, report.rejected_rows, report.stored_rows) == (34, 33, 1, 2)
    assert [(r.row_number, r.code) for r in done.rejections.collect()] == [(34, "missing_service")]
    assert float(done.costs.agg(F.sum("billed_cost")).first()[0]) == pytest.approx(33 * 26.1)


def test_csv_row_numbers(spark, tmp_path):
    lines = GCP + ",,,2026-07-14T00:00:00Z,,,0,0,USD,,\n"
    done = ingest_costs(spark, write(tmp_path, "gcp.csv", lines), "gcp")
    assert [(r.row_number, r.code) for r in done.rejections.collect()] == [(3, "missing_service")]


def test_wrong_slot_credentials_and_currencies_are_refused(spark, tmp_path):
    path = write(tmp_path, "gcp.csv", GCP)
    with pytest.raises(RefusedUpload, match="provider_format_mismatch"):
        ingest_costs(spark, path, "aws")
    with pytest.raises(RefusedUpload, match="unknown_format"):
        ingest_costs(spark, write(tmp_path, "odd.csv", "a,b\n1,2\n"), "aws")
    with pytest.raises(RefusedUpload, match="client_secret"):
        ingest_costs(spark, write(tmp_path, "leak.json", {"rows": [aws_row(1)], "Client_Secret": "x"}), "aws")
    mixed = {"rows": [aws_row(1), aws_row(2, line_item_currency_code="EUR")]}
    with pytest.raises(RefusedUpload, match="EUR, USD"):
        ingest_costs(spark, write(tmp_path, "mixed.json", mixed), "aws")


def land(tmp_path, name, files):
    folder = tmp_path / name
    folder.mkdir()
    for file, text in files.items():
        (folder / file).write_text(text)
    return str(folder)


def test_json_containers_are_found_by_content(spark, tmp_path):
    rows = [aws_row(n) for n in range(4)]
    shapes = {
        "rows": json.dumps({"rows": rows}), "items": json.dumps({"items": rows}, indent=2), "bare": json.dumps(rows, indent=1),
        "lines": "\n".join(map(json.dumps, rows)), "documents": "\n".join(json.dumps({"rows": [r]}) for r in rows) + "\n\n",
    }
    for name, text in shapes.items():
        done = ingest_costs(spark, land(tmp_path, name, {"a.json": text}), "aws")
        assert done.report.first().raw_rows == 4, name
    both = ingest_costs(spark, land(tmp_path, "both", {"a.json": shapes["bare"], "b.json": shapes["lines"]}), "aws")
    assert both.report.first().raw_rows == 8


@pytest.mark.parametrize("shape", ["bare", "lines"])
def test_row_numbers_of_json_rows(spark, tmp_path, shape):
    rows = [aws_row(n) for n in range(5)]
    for n in (1, 3):
        rows[n] |= {"product_servicename": "", "line_item_product_code": ""}
    text = json.dumps(rows) if shape == "bare" else "\n".join(map(json.dumps, rows))
    done = ingest_costs(spark, land(tmp_path, shape, {"a.json": text}), "aws")
    assert sorted((r.row_number, r.code) for r in done.rejections.collect()) == [(2, "missing_service"), (4, "missing_service")]


def test_csv_files_keep_their_own_header_and_line_breaks(spark, tmp_path):
    header, *lines = GCP.splitlines()
    names = header.split(",")
    turned = ",".join(names[::-1]) + "\n" + ",".join("01,Cloud SQL,S2,2026-07-14T00:00:00Z,2026-07-14T14:00:00Z,db-1,14,-3.0,USD,,".split(",")[::-1]) + "\n"
    broken = header + '\n01,"Compute\nEngine",S1,2026-07-13T00:00:00Z,2026-07-14T00:00:00Z,vm-9,24,5.0,USD,,\n'
    path = land(tmp_path, "csv", {"a.csv": GCP, "b.csv": turned, "c.csv": broken})
    got = native.native_costs(spark, path, "gcp-billing-export-csv").collect()
    assert sorted((r.service_name, float(r.billed_cost)) for r in got) == [
        ("Cloud SQL", -3.0), ("Cloud SQL", -3.0), ("Compute\nEngine", 5.0), ("Compute Engine", 41.0)]
    assert {r.source_record_id for r in got} == {"gcp-row-a.csv-1", "gcp-row-a.csv-2", "gcp-row-b.csv-1", "gcp-row-c.csv-1"}


def test_files_without_a_usable_row_are_refused(spark, tmp_path):
    bad = aws_row(1, product_servicename="", line_item_product_code="")
    path = land(tmp_path, "hollow", {"a.json": json.dumps([aws_row(2)]), "b.json": json.dumps([bad])})
    with pytest.raises(RefusedUpload, match="no_usable_row.*b.json"):
        ingest_costs(spark, path, "aws")
    # A named format does not skip the credential check.
    leak = land(tmp_path, "leak", {"a.json": json.dumps([aws_row(2) | {"client_secret": "x"}])})
    with pytest.raises(RefusedUpload, match="client_secret"):
        ingest_costs(spark, leak, "aws", "aws-cur-json")


def test_item_containers(spark, tmp_path):
    good = [{"resource_id": f"r{n}", "metric_name": "m", "points": []} for n in range(3)]
    shapes = {"items": json.dumps({"items": good}), "bare": json.dumps(good), "lines": "\n".join(map(json.dumps, good))}
    for name, text in shapes.items():
        usable, rejected = landing.evidence_items(landing.read_items(spark, land(tmp_path, name, {"a.json": text})), "aws", "metrics")
        assert usable.count() == 3 and rejected.count() == 0, name
    usable, rejected = landing.evidence_items(landing.read_items(spark, land(tmp_path, "other", {"a.json": '{"things": []}'})), "aws", "metrics")
    assert usable.count() == 0 and [r.code for r in rejected.collect()] == ["schema_mismatch"]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from spendshift.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=Conf, master="spark://host:7077", setCheckpointDir=lambda folder: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=context))


def test_evidence_items(spark, tmp_path):
    good = {"provider": "gcp", "resource_id": "r", "metric_name": "m", "points": [{"timestamp": "2026-07-13T12:00:00Z", "value": 2.5}]}
    bad = {"metric_name": "m", "points": [{"timestamp": "soon", "value": 1}], "secret_value": "hidden"}
    items = landing.read_items(spark, write(tmp_path, "metrics.json", {"items": [good, "x", bad]}))
    usable, rejected = landing.evidence_items(items, "aws", "metrics")
    row = usable.first()
    assert row.provider == "aws" and row.unit == "Count" and row.points[0].value == 2.5 and usable.count() == 1
    notes = {r.row_number: (r.code, r.detail) for r in rejected.collect()}
    assert notes[2][0] == "not_an_object"
    assert notes[3] == ("schema_mismatch", "invalid or missing fields: points (invalid), resource_id (missing), secret_value (unexpected)")


def test_store_replaces_a_slot(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("aws", 1), ("gcp", 2)], "provider string, n int")
    store.replace_slot(rows, path, "d", "cost")
    store.replace_slot(rows.filter("provider = 'aws'").withColumn("n", F.lit(9)), path, "d", "cost")
    assert sorted((r.provider, r.n) for r in store.read_slots(spark, path, "d").collect()) == [("aws", 9), ("gcp", 2)]
    store.replace_slot(rows.limit(0), path, "d", "cost", provider="gcp")
    spark.catalog.refreshByPath(path)
    assert [(r.provider, r.n) for r in store.read_slots(spark, path, "d").collect()] == [("aws", 9)]
    sources = spark.createDataFrame([("d", "cost", 0), ("e", "cost", 3)], "dataset_id string, kind string, stored_rows int")
    store.require_sealed(sources, "e")
    with pytest.raises(ValueError):
        store.require_sealed(sources, "d")


def test_scalar_readers(spark):
    rows = spark.createDataFrame(
        [("2026-07-13T23:00:00-05:00",), ("20260713",), (" 2026-07-13 ",), ("2026-7-1",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(parsing.flexible_date(F.col("t"))).collect()] == [date(2026, 7, 13)] * 3 + [None] * 3
    amounts = spark.createDataFrame([("1.5",), ("",), ("nan",), ("1e2",), (" -3 ",), ("x",), (None,)], "t string")
    assert [float(r[0]) for r in amounts.select(parsing.amount(F.col("t"))).collect()] == [1.5, 0, 0, 100, -3, 0, 0]
    names = spark.createDataFrame([("Amazon Elastic Compute Cloud",), ("AWS Key Management Service",), ("Amazon EC2",)], "s string")
    assert [r[0] for r in names.select(service_category(F.col("s"))).collect()] == ["Other", "Management and Governance", "Compute"]
    flags = spark.createDataFrame([("upload", True), (None, True), (None, False), (None, None)], "o string, f boolean")
    assert [tuple(r) for r in flags.select(*reconciled_origin(F.col("o"), F.col("f"))).collect()] == [
        ("upload", False), ("fixture", True), ("live", False), (None, None)]


def test_focus_projection_and_versions(spark, tmp_path):
    rows = native.native_costs(spark, write(tmp_path, "aws.json", {"rows": [aws_row(1)]}), "aws-cur-json")
    row = native.focus_rows(rows).first()
    assert len(row) == 22 and row.BillingPeriodEnd == date(2026, 7, 31) and row.ChargePeriodEnd == datetime(2026, 7, 16)
    with pytest.raises(ValueError):
        native.focus_rows(rows, "1.5")
    sources = spark.createDataFrame([("aws", "2.0"), ("gcp", "2.0"), ("azure", "2023-11-01")], "provider string, schema_version string")
    assert [r.provider for r in coverage.unsupported_sources(sources).collect()] == ["gcp"]


def test_suggested_periods(spark):
    frame = spark.createDataFrame([(date(2026, 7, 1), date(2026, 7, 7)), (date(2026, 7, 1), date(2026, 7, 1))], "period_start date, period_end date")
    week, day = coverage.suggested_periods(frame).orderBy(F.col("period_end").desc()).collect()
    assert (week.baseline_end, week.current_start) == (date(2026, 7, 3), date(2026, 7, 4))
    assert day.baseline_start == day.current_end == date(2026, 7, 1)
