"""Reading the text tables, the shared folder, and words of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendshift.session import checkpoint_dir

__all__ = ["bounded_batches", "held_out", "read", "settle", "text_slices", "unused", "words_of"]

# The word separators of all word operators: space, and tab to carriage return.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# Whether Spark removes a query's shuffle files as soon as it has ended.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Compute a table that several later steps read once, cut its lineage and free its shuffle files.

    Nothing reads those files again once the table is written, so iterative operators hold
    the shuffles of one step on disk and not those of all.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        # The setting holds for plans made from here on, therefore a new one.
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_FREE, before)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id's text falls into one remainder; a null id is never held out."""
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % parts
    return F.coalesce(remainder == part, F.lit(False))


# Rows of an Arrow batch of whole texts: a batch and its copies in a Python worker stay within tens of MB.
BATCH_ROWS = 2_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches have been bounded for rows that carry whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of ``df`` has it."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes: first row, last row, their bytes, and the rows' offsets in them.

    A null text reads as empty. One longer text is a run of its own, so memory follows the
    longest text and not the batch.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    rows = len(texts)
    if not rows:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + rows + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of a run, and each row's place in the word list."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    edges = edges[edges > 0] - 1
    ends[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)
