"""Bottom-k sketches of word shingles, with DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles.
Sketches of parts merge into the sketch of the whole, and two sketches estimate resemblance,
containment and the number of distinct shingles.

Defined cases: a null or empty text has an empty sketch; a text with fewer words than a
shingle is one shingle; two empty sketches resemble each other fully, an empty and another
one not at all; equal texts have equal sketches; very long texts are sketched in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendshift.operators.ordering import with_position

SHINGLE, SIZE = 5, 128
_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of a text's shingles, in order; each is built from the hashes of its words."""
    hashed = F.transform(words(text), lambda word: F.xxhash64(word))

    def of(array: Column) -> Column:
        full = F.transform(
            F.sequence(F.lit(1), F.size(array) - shingle + 1),
            lambda at: F.xxhash64(*[F.element_at(array, at + n) for n in range(shingle)]),
        )
        short = F.array(F.xxhash64(F.array_join(array, ",")))
        return F.when(F.size(array) >= shingle, full).when(F.size(array) > 0, short).otherwise(F.array().cast("array<bigint>"))

    # The words are hashed once: the array is bound by a one-element transform.
    return F.element_at(F.transform(F.array(hashed), of), 1)


def sketch(text: Column, shingle: int = SHINGLE, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, shingle))), 1, size)


def as_text(found: Column) -> Column:
    """A sketch as 16 hex digits per hash."""
    return F.array_join(F.transform(found, lambda value: F.lpad(F.hex(value), 16, "0")), "")


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard likeness: the share of the merged sketch that stands in both."""
    both = merged(a, b, size)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) > 0, shared / F.size(both)).otherwise(F.lit(1.0))


def distinct_shingles(found: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    last = F.element_at(found, -1).cast("double") / F.lit(2.0**64) + 0.5
    return F.when(F.size(found) < size, F.size(found).cast("double")).otherwise((size - 1) / last)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that stand in b; 1 for an empty a."""
    shared = resemblance(a, b, size) * distinct_shingles(merged(a, b, size), size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, size)))


def merge_sketches(parts: DataFrame, key: str, column: str, size: int = SIZE) -> DataFrame:
    """One sketch per key from any number of parts; each task keeps k hashes per key before the shuffle."""
    hashes = parts.select(key, F.explode(column).alias("hash")).distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy("hash"))
    least = hashes.withColumn("place", place).filter(F.col("place") <= size)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("hash")).alias(column))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 7) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): every row with the one that follows it.

    Rows are ordered by descending id (null last), then by text; the last is followed by the
    first. Ids are dealt by their leading bits, so a task sorts a few runs of at most 2^bits
    ids with their texts, and only the first row of each run is looked up from another run.
    """
    # Null ids are a run of their own, after all others.
    key = F.coalesce(F.shiftright(F.col(id_col).cast("long"), bits), F.lit(-(2**63)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("run"))
    order = Window.partitionBy("run").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    placed = (
        rows.withColumn("after", F.lead("text").over(order)).withColumn("sketch", sketch(F.col("text")))
        .withColumn("after_sketch", F.lead("sketch").over(order))
    )
    heads = (
        rows.withColumn("before", F.lag(F.lit(1)).over(order)).filter("before IS NULL")
        .select(F.col("run").alias("next_run"), F.col("text").alias("head"))
    )
    runs = with_position(rows.select("run").distinct(), [], [F.col("run").desc()])
    last = runs.agg(F.max("position")).first()[0]
    following = runs.select(
        F.when(F.col("position") == 0, F.lit(last)).otherwise(F.col("position") - 1).alias("position"), F.col("run").alias("next_run")
    )
    starts = (
        runs.join(following, "position").select("run", "next_run").join(heads, "next_run")
        .select("run", "head", sketch(F.col("head")).alias("head_sketch"))
    )
    return placed.join(starts, "run", "left").select(
        "doc_id", "text", "sketch", F.coalesce("after", "head").alias("next_text"),
        F.coalesce("after_sketch", "head_sketch").alias("next_sketch"),
    )
