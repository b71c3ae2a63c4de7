"""CSV folders of many headers in one plan, and an order of rows that no split setting changes."""

import random

import pytest
from pyspark.sql import functions as F

from spendshift.operators.rollup import daily_rollup
from spendshift.plans.ingest import ingest_costs
from spendshift.sources import native

NAMES = ["billing_account_id", "service.description", "sku.id", "sku.description", "usage_start_time", "usage_end_time", "resource.name",
         "usage.amount", "usage.unit", "cost", "currency", "credits.amount", "labels"]


def row(n, **fields):
    """A row of one of three keys; its description and unit tell which row it was."""
    return {
        "billing_account_id": "01", "service.description": "Compute Engine", "sku.id": f"S{n % 3}", "sku.description": f"row {n}",
        "usage_start_time": "2026-07-13T00:00:00Z", "usage_end_time": "2026-07-14T00:00:00Z", "resource.name": "vm-1", "usage.amount": "1",
        "usage.unit": f"u{n}", "cost": "2.5", "currency": "USD", "credits.amount": "", "labels": "", **fields,
    }


def csv_text(rows, names, newline="\n"):
    quoted = lambda value: '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n') else value
    return newline.join([",".join(map(quoted, names)), *[",".join(quoted(one.get(name, "")) for name in names) for one in rows]]) + newline


def folder(tmp_path, name, files):
    path = tmp_path / name
    path.mkdir()
    for file, text in files.items():
        (path / file).write_text(text)
    return str(path)


@pytest.fixture(params=["1m", "16k", "1k"])
def split_size(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def test_first_rows_follow_file_and_place(spark, tmp_path, split_size):
    """The small file comes first by name; Spark deals the large one first."""
    files = {
        "a.csv": csv_text([row(n) for n in range(1)], NAMES), "b.csv": csv_text([row(n) for n in range(1, 700)], NAMES[::-1]),
        "c.csv": csv_text([row(n, **{"resource.name": "vm-2"}) for n in range(700, 1200)], NAMES),
    }
    rows = native.native_costs(spark, folder(tmp_path, "many", files), "gcp-billing-export-csv")
    rolled = {(r.resource_id, r.sku_id): r for r in daily_rollup(rows).collect()}
    firsts = {key: (r.charge_description, r.usage_unit) for key, r in rolled.items()}
    assert firsts == {
        ("vm-1", "S0"): ("row 0", "u0"), ("vm-1", "S1"): ("row 1", "u1"), ("vm-1", "S2"): ("row 2", "u2"),
        ("vm-2", "S1"): ("row 700", "u700"), ("vm-2", "S2"): ("row 701", "u701"), ("vm-2", "S0"): ("row 702", "u702"),
    }
    numbers = rows.orderBy("seq").select("row_number", F.substring_index("source_file", "/", -1).alias("file"), "charge_description").collect()
    assert [r.charge_description for r in numbers] == [f"row {n}" for n in range(1200)]
    assert [r.row_number for r in numbers] == [1, *range(1, 700), *range(1, 501)]


def test_many_files_and_headers_are_one_plan(spark, tmp_path):
    """200 files, 50 orders of the header, some short of columns, some with more, some with quoted line breaks."""
    rnd, files, wanted = random.Random(1), {}, []
    orders = [rnd.sample(NAMES, len(NAMES)) for _ in range(50)]
    for n in range(200):
        names = [name for name in orders[n % 50] if not (n % 7 == 0 and name == "usage.unit")] + (["extra,column"] if n % 5 == 0 else [])
        text = 'two\n\nlines, "quoted"' if n % 20 == 3 else f"plain {n}"
        rows = [row(3 * n + k, **{"sku.description": f"{text} {k}", "extra,column": "x"}) for k in range(3)]
        wanted += [(f"{n:03d}.csv", k + 1, f"{text} {k}", "unit" if n % 7 == 0 else f"u{3 * n + k}") for k in range(3)]
        files[f"{n:03d}.csv"] = ("﻿" if n % 11 == 0 else "") + csv_text(rows, names, "\r\n" if n % 4 == 0 and n % 20 != 3 else "\n") + "\n \n"
    path = folder(tmp_path, "headers", files)
    rows = native.native_costs(spark, path, "gcp-billing-export-csv")
    got = sorted((r.source_file.rsplit("/", 1)[-1], r.row_number, r.charge_description, r.usage_unit) for r in rows.collect())
    assert got == sorted(wanted)
    # One scan of the lines, and one more for the files with line breaks inside quotes; no scan a file or header.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2


def test_no_list_of_files_reaches_the_driver(spark, tmp_path, monkeypatch):
    """What is collected while a folder is read is one row of figures at a time."""
    path = folder(tmp_path, "listed", {f"{n}.csv": csv_text([row(n)], NAMES) for n in range(30)})
    frame, rows = type(spark.range(1)), []
    plain = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: rows.append(plain(self)) or rows[-1])
    native.read_csv(spark, path, NAMES)
    assert all(len(found) <= 1 for found in rows)


def test_odd_folders(spark, tmp_path):
    empty = folder(tmp_path, "empty", {"a.csv": "", "b.csv": ",".join(NAMES) + "\n"})
    assert native.native_costs(spark, empty, "gcp-billing-export-csv").collect() == []
    twice = csv_text([row(1)], NAMES).replace("usage.unit", "cost", 1)
    got = native.native_costs(spark, folder(tmp_path, "twice", {"a.csv": twice}), "gcp-billing-export-csv").collect()
    # Of two columns of one name the last counts; a short row reads as null beyond its end.
    assert float(got[0].billed_cost) == 2.5
    short = csv_text([row(1)], NAMES) + "01,Cloud SQL\n"
    got = native.native_costs(spark, folder(tmp_path, "short", {"a.csv": short}), "gcp-billing-export-csv").orderBy("seq").collect()
    assert got[1].service_name == "Cloud SQL" and got[1].usage_date is None


def test_ingest_is_the_same_under_every_split(spark, tmp_path, split_size):
    files = {f"{n}.csv": csv_text([row(100 * n + k) for k in range(1 + 150 * (n % 2))], NAMES if n % 3 else NAMES[::-1]) for n in range(6)}
    costs = ingest_costs(spark, folder(tmp_path, "ingest", files), "gcp").costs
    got = [(r.source_record_id, r.seq, r.sku_id, r.charge_description, r.usage_unit, float(r.billed_cost)) for r in costs.orderBy("seq").collect()]
    assert got == [
        ("upload-2026-07-13-000000", 0, "S0", "row 0", "u0", 2.5 * 152), ("upload-2026-07-13-000001", 1, "S1", "row 100", "u100", 2.5 * 152),
        ("upload-2026-07-13-000002", 2, "S2", "row 101", "u101", 2.5 * 152),
    ]
