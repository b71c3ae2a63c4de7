"""The versioned store: atomic switches, repeated batches, retention and expiry on disk."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from spendshift.sources.snapshots import SnapshotStore, WriteConflict


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/store")


def values(frame):
    return sorted(tuple(row) for row in frame.collect())


def disk(store):
    folder = store.path.removeprefix("file://")
    return sum(os.path.getsize(os.path.join(top, name)) for top, _, names in os.walk(folder) for name in names if name.endswith(".parquet"))


def log(spark, rows):
    return spark.createDataFrame(rows, "investigation_id string, sequence long, stage string, event_id long")


def test_replace_and_pinned_readers(spark, store):
    store.replace("d1/aws/cost", spark.range(3))
    store.replace("d1/gcp/cost", spark.range(10, 12))
    old = store.version()
    pinned = store.read("d1/aws/cost", old)
    store.replace("d1/aws/cost", spark.range(5, 6))
    assert values(store.read("d1/aws/cost")) == [(5,)] and values(pinned) == [(0,), (1,), (2,)]
    assert values(store.read("d1/gcp/cost")) == [(10,), (11,)] and store.keys() == ["d1/aws/cost", "d1/gcp/cost"]
    # A slot may be replaced by no rows.
    store.replace("d1/aws/cost", spark.range(0))
    assert store.read("d1/aws/cost").collect() == [] and store.read("d1/aws/cost").columns == ["id"]
    with pytest.raises(KeyError):
        store.read("unknown")


def test_a_write_that_fails_leaves_the_slot(spark, store, monkeypatch):
    store.replace("slot", spark.range(3))
    broken = spark.range(1000).repartition(4).withColumn("id", F.when(F.col("id") == 999, F.raise_error(F.lit("died"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="died"):
        store.replace("slot", broken)
    assert values(store.read("slot")) == [(0,), (1,), (2,)]

    def dies(*_):
        raise OSError("killed before the switch")

    with monkeypatch.context() as patch:
        patch.setattr(store, "_publish", dies)
        with pytest.raises(OSError):
            store.replace("slot", spark.range(50))
    assert values(store.read("slot")) == [(0,), (1,), (2,)]
    # What the two left behind goes, what is valid stays.
    assert store.vacuum(grace=0) == 2 and values(store.read("slot")) == [(0,), (1,), (2,)]


def test_a_killed_process_leaves_the_slot(spark, store):
    """Another driver is killed by the system after its data is written and before the switch."""
    store.replace("slot", spark.range(3))
    script = textwrap.dedent(f"""
        import os, signal, sys
        sys.path.insert(0, {os.getcwd()!r})
        from pyspark.sql import SparkSession
        from spendshift.sources.snapshots import SnapshotStore
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        store = SnapshotStore(spark, {store.path!r})
        store._publish = lambda *_: os.kill(os.getpid(), signal.SIGKILL)
        store.replace("slot", spark.range(70))
    """)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, timeout=300)
    assert done.returncode == -9
    assert values(store.read("slot")) == [(0,), (1,), (2,)] and len(store._numbers()) == 1
    assert store.vacuum(grace=0) == 1


def test_writers_of_one_key_conflict_and_of_two_do_not(spark, store, monkeypatch):
    store.replace("a", spark.range(1))
    other = SnapshotStore(spark, store.path)
    plain = store._publish

    def late(number, parts, key):
        monkeypatch.setattr(store, "_publish", plain)
        other.replace(key, spark.range(7))
        return plain(number, parts)

    monkeypatch.setattr(store, "_publish", lambda number, parts: late(number, parts, "b"))
    store.replace("a", spark.range(2))
    assert store.read("a").count() == 2 and store.read("b").count() == 7
    monkeypatch.setattr(store, "_publish", lambda number, parts: late(number, parts, "a"))
    with pytest.raises(WriteConflict):
        store.replace("a", spark.range(3))
    assert store.read("a").count() == 7


def test_a_batch_counts_once(spark, store):
    first = log(spark, [("i1", 1, "plan", 5), ("i1", 1, "later", 9), ("i1", 2, "work", 6), ("i2", 1, "plan", 7), (None, 1, "odd", 8)])
    unique = ["investigation_id", "sequence"]
    assert store.append("events", first, "b1", unique, first_by=["event_id"], buckets=4)
    number = store.version().number
    assert not store.append("events", first, "b1", unique) and store.version().number == number
    want = [("i1", 1, "plan", 5), ("i1", 2, "work", 6), ("i2", 1, "plan", 7)]
    known = lambda: values(store.read("events").filter("investigation_id IS NOT NULL").select("investigation_id", "sequence", "stage", "event_id"))
    assert known() == want
    # The same events under another batch id are known by their key; new ones are added.
    assert store.append("events", first.union(log(spark, [("i3", 1, "plan", 11)])), "b2", unique)
    assert store.read("events").filter("investigation_id IS NULL").count() == 1
    assert known() == [*want, ("i3", 1, "plan", 11)]
    for n in range(3):
        store.append("events", log(spark, [("i4", n, "x", n)]), f"c{n}", unique)
    before = store.read("events").count()
    assert store.compact("events", most=1) and store.read("events").count() == before
    assert all(len(folders) == 1 for folders in store.version().parts["events"].buckets.values())
    assert store.compact("events", most=1) is None and not store.append("events", first, "b1", unique)


def test_retention_and_expiry_free_the_disk(spark, store):
    rows = log(spark, [(f"i{n % 50}", n, "x" * 200 + str(n), n) for n in range(2_000)])
    store.append("events", rows, "b1", ["investigation_id", "sequence"], buckets=8)
    store.replace("d1/aws/cost", spark.range(20_000))
    old, size = store.version(), disk(store)
    pinned = store.read("events", old)
    keep = spark.createDataFrame([(f"i{n}",) for n in range(5)], "investigation_id string")
    untouched = {name for name, folders in old.parts["events"].buckets.items()}
    assert store.retain("events", keep) and store.retain("events", keep) is None
    assert store.read("events").count() == 200 and pinned.count() == 2_000
    assert store.expire({"d1/aws/cost": 10.0, "events": 99.0}, now=10.0) == ["d1/aws/cost"]
    # Three versions back everything is still there; with the newest alone the files go.
    assert store.vacuum(versions=4, grace=0) == 0 and pinned.count() == 2_000
    assert store.vacuum(versions=1, grace=0) > 0
    assert disk(store) < size / 3 and store.read("events").count() == 200 and store.keys() == ["events"] and untouched


def test_retention_rewrites_affected_buckets_only(spark, store):
    rows = log(spark, [(f"i{n}", 1, "x", n) for n in range(64)])
    store.append("events", rows, "b1", ["investigation_id", "sequence"], buckets=16)
    before = store.version().parts["events"].buckets
    store.retain("events", rows.filter("investigation_id <> 'i7'").select("investigation_id"))
    after = store.version().parts["events"].buckets
    assert sum(before[name] != after.get(name) for name in before) == 1 and store.read("events").count() == 63
