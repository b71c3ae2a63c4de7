"""Connected components: what a small edge table costs, and both ways of placing edges."""

import random

import pytest

from spendshift.llm import components


def plain(edges):
    group = {}
    for a, b in edges:
        one, other = group.setdefault(a, {a}), group.setdefault(b, {b})
        if one is not other:
            one |= other
            for node in other:
                group[node] = one
    return {node: min(nodes) for node, nodes in group.items()}


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components_of_paths_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rnd = random.Random(few)
    edges = [(n, n + 1) for n in range(0, 12)] + [(100, n) for n in range(90, 120) if n != 100] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    rows = spark.createDataFrame([*edges, *edges[:5], (7, 7), (None, 3)], "a long, b long").repartition(3)
    got = components.components(rows).collect()
    assert {r.node: r.component for r in got} == plain([edge for edge in edges if edge[0] != edge[1]]) and len(got) == len({r.node for r in got})


def test_few_edges_are_not_dealt_out_in_every_round(spark):
    """One round over dealt edges takes ten times the number of shuffle partitions."""
    name = "spark.sql.shuffle.partitions"
    before, context = spark.conf.get(name), spark.sparkContext
    spark.conf.set(name, "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup("few-edges", "few edges")
    try:
        edges = spark.createDataFrame([(n, n + 1) for n in range(30)], "a long, b long")
        assert components.components(edges).filter("component = 0").count() == 31
    finally:
        context.setJobGroup("", "")
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    told = context.statusTracker()
    stages = {stage for job in told.getJobIdsForGroup("few-edges") for stage in told.getJobInfo(job).stageIds}
    # The first distinct, its count, and the reading of the result deal rows out; no round does.
    assert sum(info.numTasks for info in map(told.getStageInfo, stages) if info and info.numCompletedTasks) < 40 * 6
