"""The near-copy stage against brute force on planted copies."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spendshift.llm import resemblance, simhash
from tests.llm.test_operators import sentence


def edited(text: str, places: list[int]) -> str:
    words = text.split()
    for n in places:
        words[n] = f"new{n}"
    return " ".join(words)


def planted():
    rnd, rows = random.Random(3), []
    for n in range(30):
        base = sentence(100 + n, 200)
        rows += [(10 * n, base), (10 * n + 1, base.upper()), (10 * n + 2, edited(base, [50])), (10 * n + 3, edited(base, [20, 60, 100, 150])),
                 (10 * n + 4, edited(base, rnd.sample(range(200), 30)))]
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  two"), (None, sentence(100, 200)), (None, "alone here")]
    return rows


def brute_kept(rows):
    sets = [resemblance.shingles((t or "").encode()) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and resemblance.resemblance(sets[a], sets[b]) >= 0.8:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    ids = {}
    for (i, _), g in zip(rows, group):
        ids.setdefault(g, []).append(i)
    return sorted((min((i for i in found if i is not None), default=None) for found in ids.values()), key=repr)


def test_near_copies_go_and_others_stay(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, node string")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id for r in kept), key=repr) == brute_kept(rows)
    # Some differ in more than three bits and go all the same.
    assert {2, 3} & {r.doc_id for r in kept} == set() and {r.node for r in kept} == {"kept"}
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_a_large_group_of_near_copies_is_one(spark):
    base = sentence(9, 150)
    rows = [(n, edited(base, [n % 150])) for n in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]


def templates(seed, groups):
    """Texts that share a template, some of them in pairs of a resemblance just above the limit."""
    rnd, rows = random.Random(seed), []
    for shared, alone, number, both in groups:
        template = sentence(rnd.randrange(10**6), shared)
        for n in range(number):
            own = sentence(rnd.randrange(10**6), alone)
            rows.append(template + " " + own)
            if n % 20 == 0 and both:
                # Most of the own words as well.
                rows.append(template + " " + " ".join([*own.split()[:both], *sentence(rnd.randrange(10**6), alone - both).split()]))
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [256, 16])
def test_no_link_is_lost_in_crowded_groups(spark, block):
    """Templates just below, at and above the limit, copies with scattered edits, and mixtures of passages."""
    rnd = random.Random(8)
    texts = [t for _, t in templates(1, [(200, 26, 120, 10), (200, 20, 100, 5), (200, 24, 100, 3), (60, 6, 60, 3)])]
    base = sentence(77, 120)
    texts += [edited(base, rnd.sample(range(120), rnd.randrange(1, 6))) for _ in range(120)]
    passages = [sentence(500 + n, 25) for n in range(9)]
    texts += [" ".join(rnd.sample(passages, rnd.randrange(6, 9))) for _ in range(150)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=repr)
    groups = resemblance.near_copies(docs, crowd=2, rare=4, block=block)
    small = sorted((r.least for r in groups.groupBy("component").agg(F.min("first").alias("least")).collect()), key=repr)
    assert kept == small == brute_kept(rows)


def test_planted_pairs_above_a_common_template(spark):
    """All pairs of 0.8 or more among many texts that resemble each other by up to 0.79."""
    rows = templates(5, [(200, 24, 1_000, 8)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=repr) == brute_kept(rows)


def test_nodes_and_fingerprints_come_from_one_python_pass(spark):
    texts = ["a b c d e", "a  b c d e", "A B c d f", "", None, "one two"]
    docs = spark.createDataFrame([(i % 3, text) for i, text in enumerate(texts)], "doc_id long, text string")
    found = simhash.fingerprints(docs, named=resemblance.node)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = simhash.fingerprints(resemblance.with_nodes(docs, name="node"), id_col="node")
    assert sorted((bytes(r.doc_id), r.print) for r in found.collect()) == sorted((bytes(r.doc_id), r.print) for r in apart.collect())


def test_crowded_groups_by_both_kinds_of_links(spark):
    """Among texts of 0.79 some fingerprints differ in three bits or fewer; those link as well."""
    rows = templates(1, [(200, 26, 60, 10), (200, 24, 60, 3)])
    sets = [resemblance.shingles(t.encode()) for _, t in rows]
    prints = [simhash.simhash(t.encode()) for _, t in rows]
    group, by_print = list(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a):
            alike, near = resemblance.resemblance(sets[a], sets[b]) >= 0.8, (prints[a] ^ prints[b]).bit_count() <= 3
            by_print += near and not alike
            if alike or near:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert by_print and kept == sorted(set(group))
