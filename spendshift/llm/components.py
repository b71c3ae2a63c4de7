"""Connected components of an edge table, by alternating star contractions.

Every round is two grouped minima and two joins over the edges; no component is ever
gathered in one task. Rounds are cut by checkpoints in the shared folder, their
number grows with the logarithm of the longest path, and they end as soon as the edges
are stars, which one count by node tells. Edges of a few megabytes are one partition, as a small
side of a join would be, so their rounds shuffle nothing: dealing them out costs each round
some two thousand tasks of a few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendshift.llm.tables import settle
from spendshift.session import stored

# Edges (two numbers or digests a row) that are one partition; more are dealt by node.
FEW = 1 << 16
# The size up to which Spark leaves one partition as it is.
_SINGLE = "spark.sql.maxSinglePartitionBytes"


def _unfolded(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(a, b) for each of the pairs of columns; unlike a union the result has the partitions of ``rows``."""
    told = [F.struct(F.col(one).alias("a"), F.col(other).alias("b")) for one, other in pairs]
    return rows.select(F.explode(F.array(*told)).alias("edge")).select("edge.a", "edge.b")


def _minimum(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, itself included."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _unfolded(edges, ("a", "b"), ("b", "a"))
    return (
        both.join(_minimum(both), "a").filter("b > a")
        .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = down.join(_minimum(down), "a")
    return _unfolded(moved, ("b", "m"), ("a", "m")).filter("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has at most one edge down, and none that others point to has any."""
    end = [F.struct(F.col(name).alias("node"), F.lit(down).alias("down"), F.lit(1 - down).alias("up")) for name, down in (("a", 1), ("b", 0))]
    ends = edges.select(F.explode(F.array(*end)).alias("end")).select("end.*")
    counted = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return counted.filter("down > 1 OR (down > 0 AND up > 0)").agg(F.count(F.lit(1))).first()[0] == 0


def _together(edges: DataFrame) -> DataFrame:
    """Few edges as one partition, from a file, whose size Spark knows."""
    return stored(edges.coalesce(1)).coalesce(1)


def _contracted_together(edges: DataFrame) -> DataFrame:
    """The stars that few edges end in, without a shuffle."""
    conf = edges.sparkSession.conf
    before = conf.get(_SINGLE)
    # A join is taken for the product of its sides, so Spark would deal out its one partition nonetheless.
    conf.set(_SINGLE, str((1 << 63) - 1))
    try:
        edges = _together(edges)
        while not _are_stars(edges):
            edges = _together(_small_star(_together(_large_star(edges))))
    finally:
        conf.set(_SINGLE, before)
    return edges


def _contracted(edges: DataFrame) -> DataFrame:
    """The stars that the edges end in, every step dealt by node."""
    while not _are_stars(edges):
        edges = settle(_small_star(_large_star(edges)))
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the component's smallest node.

    Nodes without an edge to another node are not listed; repeated edges, loops and nulls
    change nothing; an empty table gives an empty result.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = settle(edges.distinct())
    # No round makes more edges than it was given.
    edges = _contracted_together(edges) if edges.count() <= FEW else _contracted(edges)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = stars.select("component").distinct().select(F.col("component").alias("node"), "component")
    return stars.union(centres)
