"""Exports and readers at size: compressed files of bounded length, no sort of whole lines, no element count of files by line."""

import json
from collections import Counter

from pyspark.sql import functions as F

from spendshift.session import with_once
from spendshift.sources import landing, native
from spendshift.sources.json_elements import list_elements
from spendshift.workloads import exports
from spendshift.workloads.views import cost_rows
from tests.conftest import SMALL


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_large_files_by_line_are_not_read_by_element(spark, tmp_path):
    text = "\n".join(json.dumps({"rows": ["stray", {"line_item_usage_type": str(n)}]}) for n in range(50))
    (tmp_path / "lines.json").write_text("﻿\n" + text)
    assert landing.json_lists(spark, str(tmp_path), 20) is None
    rows = native.read_json_rows(spark, str(tmp_path), ["line_item_usage_type"], large=20).collect()
    assert sorted(int(r.line_item_usage_type) for r in rows) == list(range(50))
    # One list stays one, also where a line that the reader cannot take stands before those it tells.
    (tmp_path / "list.json").write_text(json.dumps({"rows": [{"line_item_usage_type": "x"}, {"line_item_usage_type": "y"}]}))
    found = landing.json_lists(spark, str(tmp_path), 20).collect()
    assert sorted((r.source_file.rsplit("/", 1)[-1], r.position) for r in found) == [("list.json", 0), ("list.json", 1)]
    told = spark.read.text(str(tmp_path / "list.json")).select(F.col("_metadata.file_path").alias("source_file"), F.lit("[1]").alias("first_line"))
    assert list_elements(spark, str(tmp_path / "list.json"), 20, by_line=told).count() == 2


def test_exports_are_compressed_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(exports.PACKED, "maxRecordsPerFile", 100)
    exports.forget_written()
    try:
        for written in (exports.aws_csv, exports.aws_json_lines, exports.azure_json_lines, exports.gcp_csv):
            path = written(spark, SMALL)
            files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
            assert len(files) > 1 and all(r.f.endswith(".lz4") and r["count"] <= 101 for r in files)
        own = cost_rows(spark, SMALL).filter("provider = 'azure'")
        names = ["usage_date", "service_name", "sku_id", "resource_id", "region_id", "billing_account_id", "currency", "billed_cost",
                 "effective_cost", "usage_quantity", "commitment_discount_id", "charge_category"]
        tags = F.array_sort(F.map_entries("tags")).cast("string")
        read = native.native_costs(spark, exports.azure_json_lines(spark, SMALL), "azure-cost-management-json")
        assert Counter(read.select(*names, tags).collect()) == Counter(own.select(*names, tags).collect())
    finally:
        exports.forget_written()


def test_first_lines_are_found_without_sorting_lines(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text(f"\n \nusage_start_time,x{n}\n" + "\n".join(f"b,{m}" for m in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = landing.detect_formats(landing.read_lines(spark, str(tmp_path)))
        assert "SortAggregate" not in plan_of(found)
        assert {(r.detected_format, r.found_columns) for r in found.collect()} == {
            ("gcp-billing-export-csv", f"usage_start_time, x{n}") for n in range(3)}
        assert {r.first_line for r in landing.file_shapes(spark, str(tmp_path)).collect()} == {f"usage_start_time,x{n}" for n in range(3)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_costly_columns_are_not_copied_into_filters(spark):
    items = spark.createDataFrame([("{\"event_id\": \"e\"}", "f", 1, 0), ("7", "f", 1, 1), (None, "f", 1, 2)], "item string, source_file string, line long, position long")
    _, rejected = landing.evidence_items(items.withColumn("seq", landing.row_order("line", "position")), "aws", "audit")
    assert rejected.count() == 3
    text = rejected._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json(MapType") == 1
    assert with_once(items, "twice", F.concat("item", "item")).count() == 3
