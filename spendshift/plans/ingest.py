"""Ingest of one cost source end to end (C1) and its store (K1-K3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendshift.operators import coverage
from spendshift.operators.rollup import daily_rollup, quarantine, rejection_reason, with_record_ids
from spendshift.session import prepare, settle
from spendshift.sources import landing, native
from spendshift.sources.store import ingest_report


class RefusedUpload(ValueError):
    """The landed files cannot be used; the message names columns and markers, never values."""


@dataclass(frozen=True)
class Ingested:
    costs: DataFrame
    rejections: DataFrame
    report: DataFrame
    data_through: DataFrame
    detected_format: str


def inspect(spark: SparkSession, path: str, provider: str) -> tuple[DataFrame, DataFrame]:
    """(offenders, detected): files that must be refused with the reason, and every file's format."""
    lines = landing.read_lines(spark, path)
    detected = settle(landing.detect_formats(lines))
    secret = landing.credential_findings(lines).select(
        "source_file", F.lit("credential_shaped").alias("reason"), F.array_join("markers", ", ").alias("detail")
    )
    wrong = landing.format_mismatches(detected, provider).select(
        "source_file", "reason", F.concat_ws(" with columns ", F.coalesce("detected_format", F.lit("unknown")), "found_columns").alias("detail")
    )
    return settle(secret.unionByName(wrong)), detected


def detect(spark: SparkSession, path: str, provider: str) -> str:
    """The one format of the landed files; anything else, or a credential, is refused."""
    offenders, detected = inspect(spark, path, provider)
    _refuse(offenders, f"not a usable {provider} export")
    formats = [row.detected_format for row in detected.select("detected_format").distinct().limit(2).collect()]
    if len(formats) != 1:
        raise RefusedUpload(f"expected files of one format, found {len(formats)}")
    return formats[0]


def _refuse(offenders: DataFrame, what: str) -> None:
    """Raise if there are offenders; the message shows a few, ``offenders`` holds all of them."""
    shown = offenders.orderBy("reason", "source_file").limit(5).collect()
    if shown:
        number = offenders.select("source_file").distinct().count()
        first = "; ".join(f"{row.reason} ({row.detail})" for row in shown)
        raise RefusedUpload(f"{number} files are {what}: {first}", offenders)


def ingest_costs(spark: SparkSession, path: str, provider: str, detected_format: str | None = None) -> Ingested:
    """Detect, read, date, quarantine, check the currency and roll up to daily grain.

    Credentials and formats are checked in any case. A file without a usable row is refused.
    Exports that are not text (Parquet) are named by ``detected_format``.
    """
    prepare(spark)
    if detected_format is None or not detected_format.endswith("-parquet"):
        found = detect(spark, path, provider)
        if detected_format not in (None, found):
            raise RefusedUpload(f"expected {detected_format}, found {found}")
        detected_format = found
    rows = native.native_costs(spark, path, detected_format)
    usable, rejected = quarantine(rows)
    per_file = rows.groupBy("source_file").agg(F.count(F.when(rejection_reason().isNull(), 1)).alias("usable"))
    hollow = per_file.filter("usable = 0").select(
        "source_file", F.lit("no_usable_row").alias("reason"), F.substring_index("source_file", "/", -1).alias("detail")
    )
    _refuse(hollow, "without a usable row")
    through = {
        "aws": coverage.aws_data_through, "azure": coverage.azure_data_through, "gcp": coverage.gcp_data_through,
    }[provider](rows)
    rolled = settle(daily_rollup(usable))
    if rolled.isEmpty():
        raise RefusedUpload("the upload has no rows")
    currency = coverage.currencies(rolled).first()
    if currency.is_mixed:
        raise RefusedUpload(f"mixed currencies: {', '.join(currency.currencies)}")
    costs = with_record_ids(rolled, renumber=True)
    number = landing.row_number_of(rejected) if "position" in rejected.columns else F.col("row_number")
    rejections = rejected.select("source_file", number.alias("row_number"), "provider", "code")
    return Ingested(costs, rejections, ingest_report(rows, rejected, rolled), through, detected_format)
