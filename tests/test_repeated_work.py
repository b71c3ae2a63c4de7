"""Small tables are computed once and known by size; large rows are dealt, sorted and looked up no more often than needed."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from spendshift.operators import findings, rollup
from spendshift.operators.ordering import with_position
from spendshift.schemas import COST
from spendshift.session import SCAN_BYTES, prepare
from spendshift.sources import store
from spendshift.sources.snapshots import SnapshotStore
from spendshift.workloads import case
from spendshift.workloads.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_finding_chain_tells_sources_and_cases_once(spark, monkeypatch):
    asked = []
    for name in ("provenance", "case_files"):
        real = getattr(case, name)
        monkeypatch.setattr(case, name, lambda *args, real=real, name=name: asked.append(name) or real(*args))
    case.forget_settled()
    for name in ("c4_findings", "c5_dropped_findings", "a31_provider_statuses"):
        QUERIES[name](spark, SF).collect()
    assert sorted(asked) == ["case_files", "provenance"]


def test_candidates_are_known_to_be_small(spark):
    size = int(str(case.candidates(spark, SF)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size < 10 << 20


def test_known_ids_are_read_in_one_pass(spark, tmp_path):
    listed = "finding_id string, provider string, affected_resources array<string>"
    told = spark.createDataFrame(
        [("f1", "aws", ["res-1", "res-9", None]), ("f2", "gcp", ["res-1"]), ("f3", "azure", ["res-2", "azure:x"])], listed)
    known = spark.createDataFrame(
        [("aws", "res-1"), ("aws", "res-1"), ("aws", None), ("azure", None), (None, "res-9")], "provider string, resource_id string")
    known.write.parquet(str(tmp_path / "known"))
    found = findings.unknown_resources(told, spark.read.parquet(str(tmp_path / "known"))).select("finding_id", "resource_id")
    assert sorted(map(tuple, found.collect())) == [("f1", "res-9"), ("f3", "res-2")]
    assert "FileScan parquet" not in plan_of(found)


def test_positions_without_groups_need_no_second_deal(spark):
    rows = spark.range(100).select((F.col("id") * 37 % 100).alias("v"))
    placed = with_position(rows, [], [F.col("v")])
    assert "SortMergeJoin" not in plan_of(placed) and "BroadcastHashJoin" in plan_of(placed)
    assert all(row.v == row.position for row in placed.collect())


def cost_frame(spark, rows):
    """Cost rows of (provider, service, seq), all else null but the amounts and the description."""
    told = spark.createDataFrame(rows, "provider string, service_name string, seq long")
    own = {"charge_description": F.concat(F.lit("d"), F.col("seq").cast("string"))}
    fields = [f for f in COST.fields]
    return told.select(*[
        (F.col(f.name) if f.name in told.columns else own.get(f.name, F.lit(1 if f.name.endswith(("_cost", "_quantity")) else None)))
        .cast(f.dataType).alias(f.name) for f in fields])


def test_rollup_leaves_unread_texts_out_of_its_shuffle(spark):
    rolled = rollup.daily_rollup(cost_frame(spark, [("aws", "a", 2), ("aws", "a", 1), ("aws", "b", None), ("aws", "b", 3)]))
    narrow = rolled.select("service_name", "seq", "billed_cost")
    assert "charge_description" not in plan_of(narrow)
    assert sorted((r.service_name, r.seq, int(r.billed_cost)) for r in narrow.collect()) == [("a", 1, 2), ("b", None, 2)]
    assert sorted((r.seq or 0, r.charge_description) for r in rolled.collect()) == [(0, None), (1, "d1")]


def test_scans_are_bounded_and_never_raised(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "128m")
        prepare(spark)
        assert int(spark.conf.get(name)) == SCAN_BYTES
        spark.conf.set(name, "4m")
        prepare(spark)
        assert spark.conf.get(name) == "4m"
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("slots", [3, 12])
def test_slots_are_written_side_by_side(spark, tmp_path, monkeypatch, slots):
    writers, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *args: writers.append(int(spark.conf.get(store._WRITERS))) or real(self, *args))
    before = spark.conf.get(store._WRITERS)
    rows = spark.range(240).select(F.concat(F.lit("p"), (F.col("id") % slots).cast("string")).alias("provider"), "id")
    store.replace_slot(rows, str(tmp_path / "s"), "d1", "cost")
    store.replace_slot(rows.filter("provider = 'p1'"), str(tmp_path / "s"), "d1", "cost")
    assert min(writers) >= store.OPEN_SLOTS and spark.conf.get(store._WRITERS) == before
    held = store.read_slots(spark, str(tmp_path / "s"), "d1").select("provider", "id")
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, rows.collect()))


def test_snapshot_writes_look_parts_up_once(spark, monkeypatch):
    read, real = [], SnapshotStore.replace
    monkeypatch.setattr(SnapshotStore, "replace", lambda self, key, rows: read.extend(rows.inputFiles()) or real(self, key, rows))
    assert len(QUERIES["k1_atomic_slot_replace"](spark, SF).collect()) == 3
    assert read and not [name for name in read if name.endswith("part.parquet") or "supplier" in name]
