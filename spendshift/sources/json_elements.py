"""Large JSON lists read by several tasks.

A file that holds one list of objects (bare, or under ``rows`` or ``items``) is read in pieces that end
with a closing brace; Spark deals its byte ranges to tasks. What a piece means depends on everything
before it: whether it starts inside a string, and how deep. Both are sums over earlier pieces
(quotes, then braces), so they are summed per byte range, the ranges of a file are summed in one
small window, and the sums within a range are added. An element ends where the depth is that of the
list again; its pieces are put together by its number, across ranges if need be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendshift.session import settle

# Files above this size are read by element.
LARGE_FILE = 64 << 20
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_FLAT_LIST = rf'\[(?:{_STRING}|[^\[\]{{}}"])*+\]'


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _summed(pieces: DataFrame, amount: str, before: str) -> DataFrame:
    """Add the sum of ``amount`` over all earlier pieces of the file."""
    in_file = Window.partitionBy("source_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("source_file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    ranges = settle(pieces.groupBy("source_file", "split").agg(F.sum(amount).alias("__sum")))
    starts = ranges.select("source_file", "split", F.coalesce(F.sum("__sum").over(in_file), F.lit(0)).alias("__start"))
    told = pieces.withColumn("__here", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(starts, ["source_file", "split"])
    return told.withColumn(before, F.col("__here") + F.col("__start")).drop("__here", "__start")


def has_large_files(spark: SparkSession, path: str, above: int = LARGE_FILE) -> bool:
    """Whether a folder has files of more than ``above`` bytes; others are pruned by their size and not read."""
    return not spark.read.text(path).filter(F.col("_metadata.file_size") > above).select(F.lit(1)).limit(1).isEmpty()


def list_elements(
    spark: SparkSession, path: str, above: int = LARGE_FILE, keys: Sequence[str] = ("rows", "items"), strays: bool = False,
    by_line: DataFrame | None = None,
) -> DataFrame | None:
    """(source_file, position, entry): the objects of the one list of every file of more than ``above`` bytes.

    The list is the file's value, or the first field of its one object, under one of the ``keys``.

    Positions count all entries of a list from 0. Entries that are not objects are left out; with ``strays`` they
    are rows with a null entry, if the list has any object. Files that hold something else, or more than one
    value, give no rows.

    ``by_line`` (source_file, first_line) names files that hold a value per line. Where their first line is that one,
    their pieces are not looked at; None if no file is left.
    """
    header = r'^[\s\x{FEFF}]*+(?:\[|\{\s*+"(?:' + "|".join(keys) + r')"\s*+:\s*+\[)'
    text = spark.read.option("lineSep", "}").text(path).filter(F.col("_metadata.file_size") > above)
    pieces = text.select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    heads = settle(
        pieces.groupBy("source_file").agg(F.min(F.struct("split", "row", "value"))["value"].alias("head"), F.max(F.struct("split", "row")).alias("last"))
        .select("source_file", "head", F.regexp_extract("head", header, 0).alias("header"), "last")
    )
    if by_line is not None:
        space = F.lit(" \t\r\n\ufeff")
        # A line longer than a text reader takes may stand before the first line it tells.
        same = F.startswith(F.trim("first_line", space), F.trim("head", space))
        heads = heads.join(by_line.filter("first_line IS NOT NULL"), "source_file", "left").filter(~F.coalesce(same, F.lit(False)))
        if heads.filter("header <> ''").isEmpty():
            return None
    heads = heads.select("source_file", "header", "last")
    known = pieces.join(heads.filter("header <> ''"), "source_file")
    first = (F.col("split") == 0) & F.startswith("value", "header")
    is_first = F.row_number().over(Window.partitionBy("source_file", "split").orderBy("row")) == 1
    known = known.withColumn("first", first & is_first)
    known = known.withColumn("quotes", _count(F.regexp_replace("value", r"\\.", ""), '"'))
    known = _summed(known, "quotes", "quotes_before")

    starts_inside = F.col("quotes_before") % 2 == 1
    ends_inside = (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    # What stands outside strings: a string that is open at the start or at the end goes as well.
    body = F.when(starts_inside, F.concat(F.lit('"'), F.col("value"))).otherwise(F.col("value"))
    outside = F.regexp_replace(F.regexp_replace(body, _STRING, ""), r'(?s)".*', "")
    known = known.withColumn("outside", F.regexp_replace(outside, _FLAT_LIST, ""))
    known = known.withColumn("closed", ~ends_inside & (F.struct("split", "row") != F.col("last")))
    known = known.withColumn(
        "change", _count(F.col("outside"), "{[") - _count(F.col("outside"), "}]") - F.col("closed").cast("int")
    )
    known = _summed(known, "change", "depth")
    level = _count(F.col("header"), "{[")
    after = F.col("depth") + F.col("change")
    # A piece starts at the list's level after an element; the first piece starts before the list.
    at_level = (F.col("depth") == level) | F.col("first")
    commas = _count(F.regexp_extract("outside", r"^[^{]*", 0), ",")
    known = known.withColumn("commas", F.when(at_level, commas).otherwise(0)).withColumn("ends", F.col("closed") & (after == level))
    known = known.withColumn("is_end", F.col("ends").cast("int")).withColumn("starts", at_level)
    # A file with anything after its first value is not one list.
    several = settle(known.filter((after <= 0) & F.col("closed")).groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    known = _summed(_summed(known, "commas", "commas_before"), "is_end", "element").join(several, "source_file", "left_anti")

    plain = F.when(F.col("first"), F.expr("substring(value, length(header) + 1)")).otherwise(F.col("value"))
    parts = known.select(
        "source_file", "element", "split", "row", plain.alias("text"), "ends",
        F.when(F.col("starts"), F.col("commas_before") + F.col("commas")).alias("position"),
        F.when(F.col("starts"), F.col("commas_before")).alias("before"),
    )
    whole = parts.groupBy("source_file", "element").agg(
        F.sort_array(F.collect_list(F.struct("split", "row", "text"))).alias("pieces"), F.max("position").alias("position"),
        F.max("ends").alias("whole"), F.min("before").alias("before"),
    )
    entry = F.concat(F.array_join(F.transform("pieces", lambda piece: piece["text"]), "}"), F.lit("}"))
    # Entries that are not objects stand before the element, with the commas.
    entry = F.regexp_replace(entry, rf'^(?:{_STRING}|{_FLAT_LIST}|[^"{{\[])*+', "")
    found = whole.filter("whole").select("source_file", F.col("position").cast("bigint").alias("position"), entry.alias("entry"))
    if not strays:
        return found
    # The place before an element's first comma is that of the element before; behind the last one there is a tail.
    low = F.when(F.col("element") == 0, 0).otherwise(F.col("before") + 1)
    high = F.when(F.col("whole"), F.col("position") - 1).when(F.col("element") > 0, F.col("position"))
    gaps = whole.filter(high >= low).select("source_file", F.explode(F.sequence(low, high)).alias("position"))
    gaps = gaps.select("source_file", F.col("position").cast("bigint").alias("position"), F.lit(None).cast("string").alias("entry"))
    return found.unionByName(gaps)
