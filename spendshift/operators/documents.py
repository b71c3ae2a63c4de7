"""Documentation change watch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendshift.functions.text import fingerprint


def page_fingerprints(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Hash of each page's visible text; null for a page too short to compare."""
    return pages.select(key, fingerprint(F.col(html)).alias("sha256"))


def fingerprint_changes(current: DataFrame, recorded: DataFrame, key: str = "page_id") -> DataFrame:
    """Compare current hashes with the recorded ones: new, changed, unchanged or unreachable."""
    before = recorded.select(key, F.col("sha256").alias("previous"))
    now = current.withColumn("is_current", F.lit(True))
    joined = now.join(before, key, "full_outer")
    status = (
        F.when(F.col("is_current").isNull(), "not_checked")
        .when(F.col("sha256").isNull(), "unreachable")
        .when(F.col("previous").isNull(), "new")
        .when(F.col("previous") != F.col("sha256"), "changed")
        .otherwise("unchanged")
    )
    return joined.select(key, "sha256", "previous", status.alias("status"))


def change_report(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("pages"))


def next_baseline(changes: DataFrame, key: str = "page_id") -> DataFrame:
    """Recorded hashes after the check: a reachable page takes its new hash, others keep theirs."""
    return changes.select(key, F.coalesce("sha256", "previous").alias("sha256")).filter("sha256 is not null")
