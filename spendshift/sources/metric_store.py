"""Metric points laid out for scans by resource.

Points lie in one folder a bucket of the resource's hash, sorted by resource, with Parquet bloom
filters on it. A scan for some resources lists the folders of their buckets only (at most one number
a bucket comes to the driver); inside a file, row groups are skipped by the sorted column's range
and filter while the wanted resources are few, and a semi-join decides in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
# Wanted resources up to which their names are given to the scan as well.
NAMED = 256


def _bucket(resource: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(resource), F.lit(buckets)).cast("int")


def write_points(points: DataFrame, path: str, buckets: int = BUCKETS, row_group: int = 8 << 20) -> None:
    """Write points (any columns with ``resource_id``); a resource with very many points is one sorted bucket's tail.

    Rows are rebalanced by bucket and range, so that a hot resource is several files.
    """
    dealt = points.withColumn("bucket", _bucket(F.coalesce("resource_id", F.lit("")), buckets)).hint("rebalance", "bucket", "resource_id")
    sorted_rows = dealt.sortWithinPartitions("bucket", "resource_id")
    (
        sorted_rows.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#resource_id", "true")
        .option("parquet.block.size", str(row_group)).parquet(path)
    )


def read_points(spark: SparkSession, path: str, wanted: DataFrame, keys: tuple[str, ...] = ("resource_id",), buckets: int = BUCKETS) -> DataFrame:
    """The stored points of the ``wanted`` resources (columns ``keys``, with ``resource_id``); null ones find nothing."""
    wanted = wanted.select(*keys).filter("resource_id IS NOT NULL").distinct()
    hit = wanted.select(_bucket(F.col("resource_id"), buckets).alias("bucket")).distinct()
    # At most one number a bucket, and a bounded list of names.
    numbers = [row["bucket"] for row in hit.collect()]
    names = [row["resource_id"] for row in wanted.select("resource_id").distinct().limit(NAMED + 1).collect()]
    points = spark.read.parquet(path).filter(F.col("bucket").isin(numbers))
    if len(names) <= NAMED:
        points = points.filter(F.col("resource_id").isin(names))
    return points.drop("bucket").join(wanted, list(keys), "left_semi")
