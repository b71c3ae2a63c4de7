"""Inclusive date periods."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    """A period that includes both its first and its last day."""

    start: date
    end: date

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError(f"period ends {self.end} before it starts {self.start}")

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    @property
    def label(self) -> str:
        return f"{self.start.isoformat()}..{self.end.isoformat()}"

    def contains(self, day: Column) -> Column:
        return day.between(F.lit(self.start), F.lit(self.end))

    def spine(self, spark: SparkSession) -> DataFrame:
        """One row per day of the period, column ``usage_date``."""
        days = F.sequence(F.lit(self.start), F.lit(self.end))
        return spark.range(1).select(F.explode(days).alias("usage_date"))


def in_any(periods: list[Period], day: Column) -> Column:
    """True when the day falls in at least one of the periods."""
    hit = F.lit(False)
    for period in periods:
        hit = hit | period.contains(day)
    return hit
