"""Periodic runs against a brute-force search over every lag."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendshift.llm import periodic
from spendshift.llm.queries import op12_periodic_runs


def brute_runs(words, least=24, times=3):
    found = []
    for period in range(1, len(words) // times + 1):
        start = 0
        while start + period < len(words):
            end = start
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end - start + period >= max(least, times * period):
                found.append((start, end - start + period, period))
            start = end + 1
    inner = lambda s, n, q: any(p < q and t <= s and t + m >= s + n for t, m, p in found)
    return sorted(run for run in found if not inner(*run))


def brute_row(doc_id, text):
    """The row of the contract for one document, looped as it says."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda run: (run[1] / run[2], -run[0], -run[2]), default=None)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(word for i, word in enumerate(words) if i not in dropped)
    figures = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *figures, sha256(told.encode()).hexdigest(), sha256(kept).hexdigest())


@pytest.mark.parametrize(("least", "times"), [(24, 3), (8, 3), (30, 4), (2, 3)])
def test_against_every_lag(least, times):
    rnd = random.Random(least)
    for _ in range(600):
        words = [rnd.randrange(rnd.choice([1, 2, 3, 50])) for _ in range(rnd.randint(0, 180))]
        for _ in range(rnd.randint(0, 3)):
            period, begin = rnd.randint(1, 50), rnd.randint(0, max(0, len(words) - 1))
            for i in range(begin + period, min(len(words), begin + rnd.randint(1, 180))):
                words[i] = words[i - period]
        assert periodic.find_runs(np.array(words, dtype=np.int64), least, times) == brute_runs(words, least, times)


def test_long_uniform_text_is_linear():
    assert periodic.find_runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]


def test_odd_rows(spark):
    loop = "x y z " * 20
    rows = [(1, None, 7), (2, "", 7), (3, loop, 7), (3, loop, 7), (None, loop, None), (4, "é " * 24, 7), (5, "a\tb\x0bc d", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = {(r.doc_id, r.text): r for r in periodic.collapse_runs(docs).collect()}
    assert len(periodic.collapse_runs(docs).collect()) == 7
    assert found[1, None].n_words == 0 and found[1, None].runs == [] and found[1, None].best is None and found[1, None].collapsed == ""
    assert [tuple(run) for run in found[3, loop].runs] == [(0, 60, 3)] and found[3, loop].collapsed == "x y z"
    assert found[4, "é " * 24].collapsed == "é" and found[5, rows[-1][1]].n_words == 3
    assert found[None, loop].runs == found[3, loop].runs
    assert periodic.collapse_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.collapse_runs(docs, times=2)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.col("n_chars") < 6_000)
    short = {r.doc_id: r.text for r in docs.collect()}
    found = [tuple(r) for r in op12_periodic_runs(spark, "/root/testdata/sf0.001").collect() if r.doc_id in short]
    assert sorted(found) == sorted(brute_row(doc_id, text) for doc_id, text in short.items())
    assert any(row[1] for row in found)
