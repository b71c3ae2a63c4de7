"""Tolerant readers for native export values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendshift.schemas import MONEY, STRING_MAP


def first_filled(*columns: Column, default: str | None = None) -> Column:
    """First value that is neither null nor empty."""
    filled = [F.nullif(column.cast("string"), F.lit("")) for column in columns]
    if default is not None:
        filled.append(F.lit(default))
    return F.coalesce(*filled)


def amount(text: Column, default: Column | None = None) -> Column:
    """A money amount; null, empty, NaN and unreadable text take the default (zero).

    Plain numbers keep their written digits; exponents go through a double.
    """
    trimmed = F.trim(text.cast("string"))
    usual = F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), trimmed.try_cast(MONEY))
    as_double = trimmed.try_cast("double")
    finite = F.when(~F.isnan(as_double), as_double.try_cast(MONEY))
    fallback = default if default is not None else F.lit(0).cast(MONEY)
    return F.coalesce(usual, finite, fallback)


def flexible_date(text: Column) -> Column:
    """The date as written: ISO date or datetime (any offset), or ``yyyyMMdd``."""
    trimmed = F.trim(text.cast("string"))
    return F.coalesce(
        F.try_to_date(F.substring(trimmed, 1, 10), "yyyy-MM-dd"),
        F.when(trimmed.rlike(r"^\d{8}(T|$)"), F.try_to_date(F.substring(trimmed, 1, 8), "yyyyMMdd")),
    )


def lenient_timestamp(text: Column) -> Column:
    """Timestamp with offset honoured, no offset read as UTC, unreadable as null."""
    return F.try_to_timestamp(F.nullif(F.trim(text.cast("string")), F.lit("")))


def written_hour(text: Column) -> Column:
    """Hour of day as written in the stamp; a bare date starts at hour 0."""
    trimmed = F.trim(text.cast("string"))
    hour = F.regexp_extract(trimmed, r"^\d{4}-?\d{2}-?\d{2}[T ](\d{2})", 1)
    return F.coalesce(F.nullif(hour, F.lit("")).cast("int"), F.lit(0))


def end_of_day(day: Column) -> Column:
    return F.to_timestamp(day) + F.expr("interval '23:59:59' hour to second")


def tags(text: Column) -> Column:
    """Tag map from a JSON object or a JSON list of key/value objects; else empty."""
    trimmed = F.trim(text)
    as_object = F.when(trimmed.startswith("{"), F.from_json(trimmed, STRING_MAP))
    entries = F.filter(
        F.from_json(trimmed, "array<struct<key:string,value:string>>"),
        lambda entry: entry["key"].isNotNull(),
    )
    as_list = F.when(
        trimmed.startswith("["),
        F.map_from_entries(
            F.transform(
                entries,
                lambda entry: F.struct(
                    entry["key"].alias("key"), F.coalesce(entry["value"], F.lit("")).alias("value")
                ),
            )
        ),
    )
    return F.coalesce(as_object, as_list, empty_tags())


def empty_tags() -> Column:
    return F.from_json(F.lit("{}"), STRING_MAP)


def resource_name_from_id(resource_id: Column) -> Column:
    """Text after the last slash, then after the last colon."""
    tail = F.substring_index(F.substring_index(resource_id, "/", -1), ":", -1)
    return F.nullif(tail, F.lit(""))
