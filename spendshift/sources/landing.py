"""What landed in a folder: formats, credentials, evidence items and row positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendshift.functions.text import credential_markers
from spendshift.schemas import DEFAULTS, EVIDENCE_SCHEMAS, REQUIRED_FIELDS
from spendshift.session import settle, with_once
from spendshift.sources.json_elements import LARGE_FILE, has_large_files, list_elements

# Column names that identify an export.
AWS_MARKERS = ["line_item_usage_start_date", "identity_line_item_id"]
GCP_MARKERS = ["usage_start_time", "service.description"]
AZURE_MARKER = "UsageDate"


# Bytes of a small table (files, splits) up to which it is sent to every executor; beyond it both sides are dealt.
SMALL_TABLE = 64 << 20


def row_order(*parts: Column | str) -> Column:
    """The order of a landed row: file, then its place in the file, compared as a struct.

    It is the same whatever the split sizes and whatever the order in which Spark deals files to tasks.
    """
    place = [part if isinstance(part, Column) else F.col(part) for part in parts]
    place += [F.lit(0)] * (2 - len(place))
    return F.struct(F.col("source_file").alias("file"), *[c.cast("bigint").alias(name) for c, name in zip(place, ("block", "row"), strict=True)])


def small(table: DataFrame) -> DataFrame:
    """A settled table of files or splits, marked for broadcast if its measured size allows that."""
    told = table.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("source_file")).alias("text")).first()
    size = (told["text"] or 0) + told["rows"] * 64 * max(1, len(table.columns))
    return F.broadcast(table) if size <= SMALL_TABLE else table


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of a folder with their file and place."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")
        ).alias("place"),
    )


def first_lines(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """(source_file, value) of the first line of each file, from its splits (source_file, split, first_row; null: none).

    Places are folded as numbers and their lines are looked up in a second scan, so no line is sorted.
    """
    first = F.min(F.struct("split", "first_row"))
    at = splits.filter("first_row IS NOT NULL").groupBy("source_file").agg(first.alias("at"))
    at = settle(at.select("source_file", F.col("at.split").alias("split"), F.col("at.first_row").alias("row")))
    return lines.join(small(at), ["source_file", "split", "row"]).select("source_file", "value")


def detect_formats(lines: DataFrame) -> DataFrame:
    """Format of every file from its columns; unknown files get a null format.

    Flags and the place of the first line are folded per file by partial aggregation, so no file is
    ever gathered in one place.
    """
    lines = lines.select("value", "source_file", F.col("place")["split"].alias("split"), F.col("place")["row"].alias("row"))
    text = F.col("value")
    filled = F.trim(text) != ""
    key_names = [*AWS_MARKERS, *GCP_MARKERS, AZURE_MARKER]

    names = {"has_columns": "columns", "has_rows": "rows"} | {f"has_{i}": name for i, name in enumerate(key_names)}
    splits = settle(lines.groupBy("source_file", "split").agg(
        F.min(F.when(filled, F.col("row"))).alias("first_row"),
        *[F.max(F.contains(text, F.lit(f'"{name}"'))).alias(flag) for flag, name in names.items()],
    ))
    flags = splits.groupBy("source_file").agg(*[F.max(flag).alias(flag) for flag in names])
    per_file = flags.join(first_lines(lines, splits).withColumnRenamed("value", "first"), "source_file", "left")
    header = F.transform(F.split("first", ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    is_json = F.coalesce(F.trim("first").rlike(r"^[\[{]"), F.lit(False))
    in_json = F.array_compact(
        F.array(*[F.when(F.col(f"has_{i}"), F.lit(name)) for i, name in enumerate(key_names)])
    )
    named = per_file.select(
        "source_file", "has_columns", "has_rows", is_json.alias("is_json"),
        F.when(is_json, in_json).otherwise(header).alias("columns"),
    )

    def any_of(markers: list[str]) -> Column:
        return F.arrays_overlap("columns", F.array(*[F.lit(m) for m in markers]))

    tail = F.when(F.col("is_json"), "json").otherwise("csv")
    is_azure = F.col("is_json") & F.col("has_columns") & F.col("has_rows") & F.array_contains(
        "columns", AZURE_MARKER
    )
    detected = (
        F.when(is_azure, F.lit("azure-cost-management-json"))
        .when(any_of(AWS_MARKERS), F.concat(F.lit("aws-cur-"), tail))
        .when(any_of(GCP_MARKERS), F.concat(F.lit("gcp-billing-export-"), tail))
    )
    found = F.array_join(F.array_sort(F.array_distinct("columns")), ", ")
    return named.select("source_file", detected.alias("detected_format"), found.alias("found_columns"))


# Of the rows of ``file_shapes``: whether a file holds one value per line.
_BY_LINE = "is_whole_value AND filled_lines > 1"


def file_shapes(spark: SparkSession, path: str, above: int = -1) -> DataFrame:
    """Per text file of more than ``above`` bytes: its first filled line, whether that is a whole JSON value, and its filled lines.

    Folded per file by partial aggregation; the result has one row per file.
    """
    filled = F.trim("value") != ""
    line = F.regexp_replace("value", "^\ufeff", "")
    lines = _short_lines(spark, path).filter(F.col("_metadata.file_size") > above).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    splits = settle(lines.groupBy("source_file", "split").agg(
        F.min(F.when(filled, F.col("row"))).alias("first_row"), F.count(F.when(filled, 1)).alias("lines"),
    ))
    counted = splits.groupBy("source_file").agg(F.sum("lines").alias("filled_lines"))
    shapes = counted.join(first_lines(lines, splits).select("source_file", line.alias("first")), "source_file", "left")
    first = F.col("first")
    whole = F.json_object_keys(first).isNotNull() | F.json_array_length(first).isNotNull()
    return shapes.select(
        "source_file", first.alias("first_line"), F.coalesce(whole, F.lit(False)).alias("is_whole_value"), "filled_lines"
    )


def json_values(spark: SparkSession, path: str, handled: DataFrame | None = None) -> DataFrame:
    """The JSON values of a folder with their file and line (1 for a value that fills its file).

    A file whose first line is a whole value and that has more lines holds one value per
    line; any other file is one value, put together from its lines. The files of ``handled`` (source_file)
    are left out. Which file is which is a table that is joined, not a list on the driver.
    """
    shapes = file_shapes(spark, path).select("source_file", F.expr(_BY_LINE).alias("by_line"))
    if handled is not None:
        shapes = shapes.join(handled.select("source_file").distinct(), "source_file", "left_anti")
    shapes = small(settle(shapes))
    trimmed = F.trim("value", F.lit(" \t\r\n\ufeff"))
    lines = _short_lines(spark, path).select(
        trimmed.alias("value"), F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"), F.monotonically_increasing_id().alias("seq"),
    )
    told = lines.join(shapes, "source_file").filter("value <> ''")
    by_line = told.filter("by_line")
    numbered = with_row_number(by_line, by_line).withColumnRenamed("row_number", "line").select("value", "source_file", "line")
    pieces = F.sort_array(F.collect_list(F.struct("split_start", "seq", "value")))
    single = told.filter(~F.col("by_line")).groupBy("source_file").agg(pieces.alias("pieces")).select(
        F.array_join(F.transform("pieces", lambda piece: piece["value"]), "\n").alias("value"), "source_file", F.lit(1).cast("bigint").alias("line")
    )
    return single.unionByName(numbered)


def _short_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a folder; longer ones than a large file has bytes belong to lists that are read by element."""
    return spark.read.option("mapreduce.input.linerecordreader.line.maxlength", str(LARGE_FILE)).text(path)


def json_lists(spark: SparkSession, path: str, above: int, keys: Sequence[str] = ("rows", "items"), strays: bool = False) -> DataFrame | None:
    """(source_file, line, position, entry) of the lists in files above a size, or None where there is no such list.

    A large file with a value per line is known by its first line; its elements are not counted for that.
    """
    if not has_large_files(spark, path, above):
        return None
    by_line = settle(file_shapes(spark, path, above).filter(_BY_LINE).select("source_file", "first_line"))
    found = list_elements(spark, path, above, keys, strays, by_line)
    return None if found is None else found.withColumn("line", F.lit(1).cast("bigint"))


def format_mismatches(detected: DataFrame, provider: str) -> DataFrame:
    """Files that are not the named provider's export, with what they look like instead."""
    right = F.coalesce(F.startswith(F.col("detected_format"), F.lit(provider)), F.lit(False))
    return detected.filter(~right).withColumn(
        "reason", F.when(F.col("detected_format").isNull(), "unknown_format").otherwise("provider_format_mismatch")
    )


def credential_findings(lines: DataFrame) -> DataFrame:
    """Files with credential-shaped field names; they must be refused, not stored."""
    hits = lines.select("source_file", F.explode(credential_markers(F.col("value"))).alias("marker"))
    return hits.groupBy("source_file").agg(F.array_sort(F.collect_set("marker")).alias("markers"))


def with_row_number(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Row numbers (from 1) within the file for the wanted rows of a split text source.

    Both inputs carry source_file, split_start and seq; only one row per split is windowed.
    """
    splits = rows.groupBy("source_file", "split_start").agg(
        F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq")
    )
    before = Window.partitionBy("source_file").orderBy("split_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = splits.select(
        "source_file", "split_start", "first_seq",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    return (
        wanted.join(starts, ["source_file", "split_start"], "left")
        .withColumn("row_number", F.col("seq") - F.col("first_seq") + F.col("rows_before") + 1)
        .drop("first_seq", "rows_before")
    )


# ------------------------------------------------------------------ evidence items


def read_items(spark: SparkSession, path: str, large: int = LARGE_FILE) -> DataFrame:
    """Raw items as JSON text with their place: ``{"items": []}``, a bare array, or an item per line.

    A value that is none of these is one item of its own, so that it can be refused by name.
    """
    lists = json_lists(spark, path, large, ("items",), strays=True)
    values = json_values(spark, path, lists)
    held = F.from_json("value", "struct<items:array<string>>")["items"]
    items = (
        F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>"))
        .otherwise(F.coalesce(held, F.array("value")))
    )
    told = values.select("source_file", "line", F.posexplode(items).alias("position", "item"))
    if lists is not None:
        told = told.unionByName(lists.select("source_file", "line", "position", F.coalesce("entry", F.lit("null")).alias("item")))
    return told.withColumn("seq", row_order("line", "position"))


def row_number_of(rows: DataFrame) -> Column:
    """Number of a JSON row in its file: its place in the file's one value, or its line."""
    return F.when(F.col("line") > 1, F.col("line")).otherwise(F.col("position") + 1).cast("bigint")


def _is_bad(raw: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(raw).isNull()
    if isinstance(kind, T.DoubleType):
        return raw.try_cast("double").isNull()
    if isinstance(kind, T.MapType):
        return ~F.startswith(F.ltrim(raw), F.lit("{"))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            parsed = F.from_json(raw, "array<struct<timestamp:string,value:string>>")
            bad_point = lambda p: F.try_to_timestamp(p["timestamp"]).isNull() | p["value"].try_cast("double").isNull()
            return parsed.isNull() | F.exists(parsed, bad_point)
        return ~F.startswith(F.ltrim(raw), F.lit("["))
    return F.lit(False)


def _parsed(raw: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(raw)
    if isinstance(kind, T.DoubleType):
        return raw.try_cast("double")
    if isinstance(kind, (T.MapType, T.ArrayType)):
        return F.from_json(raw, kind)
    return raw


def evidence_items(items: DataFrame, provider: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejections) of one evidence kind; the provider argument wins over the item's.

    Rejections name fields and never carry values.
    """
    schema = EVIDENCE_SCHEMAS[kind]
    raw = with_once(items, "raw", F.from_json("item", "map<string,string>"))
    is_object = F.startswith(F.ltrim(F.col("item")), F.lit("{")) & F.col("raw").isNotNull()
    required, defaults = REQUIRED_FIELDS[kind], DEFAULTS[kind]
    problems = []
    for field in schema.fields:
        if field.name == "provider":
            continue
        value = F.try_element_at("raw", F.lit(field.name))
        if field.name in required:
            problems.append(F.when(value.isNull(), F.lit(f"{field.name} (missing)")))
        problems.append(
            F.when(value.isNotNull() & _is_bad(value, field.dataType), F.lit(f"{field.name} (invalid)"))
        )
    known = F.array(*[F.lit(name) for name in schema.names])
    extra = F.transform(
        F.array_except(F.map_keys("raw"), known), lambda name: F.concat(name, F.lit(" (unexpected)"))
    )
    fields = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*problems)), extra)))
    checked = with_once(raw, "problems", F.when(is_object, fields))
    row_number = row_number_of(items).alias("row_number")
    rejections = checked.filter(~is_object | (F.size("problems") > 0)).select(
        "source_file",
        row_number,
        F.when(~is_object, "not_an_object").otherwise("schema_mismatch").alias("code"),
        F.when(~is_object, F.lit("entries must be objects")).otherwise(
            F.concat(F.lit("invalid or missing fields: "), F.array_join("problems", ", "))
        ).alias("detail"),
    )
    columns = [F.lit(provider).alias("provider")]
    for field in schema.fields[1:]:
        value = _parsed(F.try_element_at("raw", F.lit(field.name)), field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        if isinstance(field.dataType, T.MapType):
            value = F.coalesce(value, F.from_json(F.lit("{}"), field.dataType))
        if isinstance(field.dataType, T.ArrayType):
            value = F.coalesce(value, F.from_json(F.lit("[]"), field.dataType))
        columns.append(value.cast(field.dataType).alias(field.name))
    usable = checked.filter(is_object & (F.size("problems") == 0)).select(*columns, "seq")
    return usable, rejections
