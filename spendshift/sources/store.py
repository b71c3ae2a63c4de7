"""Dataset store on partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT = ["dataset_id", "provider", "kind"]
OPEN_SLOTS = 8
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def replace_slot(rows: DataFrame, path: str, dataset_id: str, kind: str, provider: str | None = None) -> None:
    """Write the rows of one (dataset, provider, kind) slot; an earlier ingest is replaced.

    With ``provider`` that slot is replaced even by no rows. Without it the slots present in
    ``rows`` are replaced, and other slots stay as they are.
    """
    if provider is not None:
        slot = f"{path}/dataset_id={dataset_id}/provider={provider}/kind={kind}"
        rows.filter(F.col("provider") == provider).drop("provider").write.mode("overwrite").parquet(slot)
        return
    writer = (
        rows.withColumn("dataset_id", F.lit(dataset_id))
        .withColumn("kind", F.lit(kind))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*SLOT)
    )
    # A task writes the few slots of its rows side by side; only rows of more slots than that are sorted first.
    conf = rows.sparkSession.conf
    before = conf.get(_WRITERS)
    conf.set(_WRITERS, str(max(int(before), OPEN_SLOTS)))
    try:
        writer.parquet(path)
    finally:
        conf.set(_WRITERS, before)


def write_by_month(rows: DataFrame, path: str) -> None:
    """Write cost rows in one folder per month, which ``read_costs`` prunes by period.

    Rows are rebalanced by month and provider, so a large month is several even files.
    """
    months = rows.withColumn("month", F.trunc("usage_date", "month")).hint("rebalance", "month", "provider")
    months.write.partitionBy("month").parquet(path)


def read_slots(spark: SparkSession, path: str, dataset_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.filter(F.col("dataset_id") == dataset_id) if dataset_id else rows


def ingest_report(raw: DataFrame, rejected: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per provider: raw, accepted, rejected and stored counts, period and currency."""
    counted = raw.groupBy("provider").agg(F.count(F.lit(1)).alias("raw_rows"))
    refused = rejected.groupBy("provider").agg(F.count(F.lit(1)).alias("rejected_rows"))
    kept = stored.groupBy("provider").agg(
        F.count(F.lit(1)).alias("stored_rows"),
        F.min("usage_date").alias("period_start"),
        F.max("usage_date").alias("period_end"),
        F.array_sort(F.collect_set("currency")).alias("currencies"),
    )
    joined = counted.join(refused, "provider", "left").join(kept, "provider", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "provider",
        "raw_rows",
        (F.col("raw_rows") - F.coalesce("rejected_rows", zero)).alias("accepted_rows"),
        F.coalesce("rejected_rows", zero).alias("rejected_rows"),
        F.coalesce("stored_rows", zero).alias("stored_rows"),
        "period_start",
        "period_end",
        "currencies",
    )


def reported_rejections(rejected: DataFrame, *order: str, limit: int | None = 50) -> DataFrame:
    """The first rejections by row order, as shown in a report (None: all); all of them stay in the table."""
    ordered = rejected.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def sealable(sources: DataFrame) -> DataFrame:
    """Datasets with at least one non-empty cost source; only these may be sealed."""
    ready = sources.filter((F.col("kind") == "cost") & (F.col("stored_rows") > 0))
    return ready.select("dataset_id").distinct()


def require_sealed(sources: DataFrame, dataset_id: str) -> None:
    if not sealable(sources.filter(F.col("dataset_id") == dataset_id)).take(1):
        raise ValueError(f"dataset {dataset_id} has no usable cost source, so it cannot be sealed")


def live_datasets(datasets: DataFrame, as_of: Column) -> DataFrame:
    """Datasets whose expiry lies after the given time."""
    return datasets.filter(F.col("expires_at") > as_of)


def store_totals(sources: DataFrame, excluding: str | None = None) -> DataFrame:
    """Bytes, datasets and records of the store, and the bytes without one dataset."""
    other = F.lit(True) if excluding is None else F.col("dataset_id") != excluding
    return sources.agg(
        F.coalesce(F.sum("byte_size"), F.lit(0)).alias("total_bytes"),
        F.countDistinct("dataset_id").alias("datasets"),
        F.coalesce(F.sum(F.when(other, F.col("byte_size"))), F.lit(0)).alias("other_bytes"),
        F.coalesce(F.max("stored_rows"), F.lit(0)).alias("largest_source"),
    )
