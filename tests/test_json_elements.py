"""Large JSON lists: the same rows and numbers as json.loads gives, whatever the byte ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spendshift.sources import landing, native
from spendshift.sources.json_elements import list_elements


def records(seed, number):
    rnd = random.Random(seed)
    odd = ['a"b', "}{][", "\\", '\\"}', "line\nbreak", "é☃", "", ",", "x" * 300, '"', "}}", "{\"rows\":["]
    for n in range(number):
        if rnd.random() < 0.15:
            yield rnd.choice(["stray }", 7, None, True, 'a{"b', [1, 2]])
        else:
            yield {"n": n, "text": rnd.choice(odd), "deep": {"list": [{"k": rnd.choice(odd)}, [1, [2, {"z": "}"}]]], "e": {}}, "last": []}


@pytest.mark.parametrize("split", ["2k", "700", "1m"])
def test_elements_equal_those_of_a_parser(spark, tmp_path, split):
    files = {}
    for n, (shape, indent) in enumerate([(None, None), ("rows", None), ("items", 2), (None, 1), ("rows", None)]):
        found = list(records(n, 60))
        files[f"{n}.json"] = found
        text = json.dumps(found if shape is None else {shape: found}, indent=indent, ensure_ascii=n % 2 == 0)
        (tmp_path / f"{n}.json").write_text(text + ("\n" if n == 4 else ""), encoding="utf-8")
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"rows": [{"n": n}]}) for n in range(50)))
    (tmp_path / "object.json").write_text(json.dumps({"other": [{"n": 1}], "rows": [{"n": 2}]}))
    (tmp_path / "empty.json").write_text("[]" + " " * 50)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = list_elements(spark, str(tmp_path), above=20)
        got = sorted((r.source_file.rsplit("/", 1)[-1], r.position, r.entry) for r in rows.collect())
        every = list_elements(spark, str(tmp_path), above=20, strays=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(name, at, one) for name, found in files.items() for at, one in enumerate(found) if isinstance(one, dict)]
    assert [(name, at, json.loads(entry)) for name, at, entry in got] == want
    places = sorted((r.source_file.rsplit("/", 1)[-1], r.position, r.entry is None) for r in every)
    assert places == [(name, at, not isinstance(one, dict)) for name, found in files.items() for at, one in enumerate(found)]


def test_small_files_are_left_alone(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}]')
    assert list_elements(spark, str(tmp_path)).filter(F.lit(True)).collect() == []


def test_large_lists_equal_small_ones(spark, tmp_path):
    """The same exports and items with every file read whole and every list read by element."""
    rows = [{"identity_line_item_id": f"id-{n}", "line_item_usage_start_date": "2026-07-13", "product_servicename": "EC2",
             "line_item_unblended_cost": str(n), "resource_tags": {"a": "}"}} for n in range(40)]
    rows[7:7] = ["stray", 3]
    (tmp_path / "a.json").write_text(json.dumps({"rows": rows}))
    (tmp_path / "b.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "c.json").write_text("\n".join(json.dumps(row) for row in rows[:5]))
    names = ["identity_line_item_id", "line_item_unblended_cost", "resource_tags"]
    whole, parts = (native.read_json_rows(spark, str(tmp_path), names, large=large) for large in (1 << 20, 20))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect())) and whole.count() == 85
    items, split = (landing.read_items(spark, str(tmp_path), large=large) for large in (1 << 20, 20))
    told = lambda frame: sorted((r.source_file, r.line, r.position, r.item.startswith("{")) for r in frame.collect())
    assert told(items) == told(split)
