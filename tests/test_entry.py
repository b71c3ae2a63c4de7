"""The driver contract: names, columns and a few whole queries against DuckDB."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["a3_period_comparison", "a1_daily_rollup", "a4_group_changes", "s2_azure_query_result", "j6_rule_selection", "k5_event_log", "p26_page_fingerprints"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def test_entry_has_rows(spark):
    frame = contract.entry(spark)
    assert frame.count() > 0 and "candidate_id" in frame.columns


def test_the_optional_parts_may_be_absent(monkeypatch):
    import importlib
    import sys

    with monkeypatch.context() as patch:
        patch.setitem(sys.modules, "corpus_pipeline", None)
        assert not [name for name in importlib.reload(contract).queries() if re.match(r"op[0-9]+_|pipeline$", name)]
    importlib.reload(contract)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    own = {name for name in contract.queries() if not re.match(r"op[0-9]+_|pipeline$", name)}
    assert own - set(contract.oracle_sql()) == {"c3_evidence_statements"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, db, name):
    frame = contract.queries()[name](spark, SMALL)
    result = db.execute(contract.oracle_sql()[name])
    columns = [item[0] for item in result.description]
    assert sorted(frame.columns) == sorted(columns)
    wanted = sorted(map(repr, result.fetchall()))
    got = sorted(repr(tuple(row)) for row in frame.select(*columns).collect())
    assert got == wanted and wanted
