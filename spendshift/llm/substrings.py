"""Removal of word passages that repeat across documents, by level-wise doubling.

A window is ``words`` consecutive words. The levels look at parts of a window: a length of at most 16 words
first, then twice as many, until the full length (13, 25 and 50 words for 50). Every full window
names one part per level: at the first level the part with the smallest hash inside the window, at every
later one the longer part that starts there (or ends with the window), so equal windows name
equal parts. Parts that stand in two documents at one level are extended to the next,
no other part is looked at again, and the levels end as soon as no part survives. At the
full length the windows' words themselves are compared, by a BLAKE2 digest of 128 bits.
Windows that repeat longer than ``words`` are covered by their parts.

The first document of a passage (the smallest id) keeps it. Windows are judged on the
input, not on what is left.

Defined cases: a null text has no words. A row with a null id loses nothing and is no
earlier document. Rows that share an id never remove words from each other, and equal rows
come back as often as they stand. Texts equal to that of a smaller id are settled by their
digest alone. Very long texts are worked through in full, one text in memory at a time. Ids may be of any
type with an order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendshift.llm.tables import bounded_batches, settle, words_of
from spendshift.llm.wordhash import window_hashes
from spendshift.session import scratch_path

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
FIRST_LEVEL = 16


class WordHashes(dict):
    """XXH64 hashes of words; the table stops growing at ``most`` words.

    Words that collide only make more parts to look at: windows are compared by their words' digests.
    """

    def __init__(self, most: int = 150_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.most and len(word) <= 48:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def levels(words: int) -> list[int]:
    """The lengths looked at, rising to ``words``; each at most twice the one before."""
    found = [words]
    while found[-1] > FIRST_LEVEL:
        found.append(-(-found[-1] // 2))
    return found[::-1]


def _smallest(values: np.ndarray, length: int) -> np.ndarray:
    """Place of the smallest of each ``length`` consecutive values, the first of equal ones; by doubling."""
    places, size = np.arange(len(values)), 1
    while size < length:
        step = min(size, length - size)
        one, other = values[:-step], values[step:]
        places = np.where(one <= other, places[:-step], places[step:])
        values = np.minimum(one, other)
        size += step
    return places


def _least(values: np.ndarray, length: int) -> np.ndarray:
    """The smallest of each ``length`` consecutive values; by doubling."""
    size = 1
    while size < length:
        step = min(size, length - size)
        values = np.minimum(values[:-step], values[step:])
        size += step
    return values


def _turns(*columns: np.ndarray) -> np.ndarray:
    """Marks the places where one of the columns differs from the place before."""
    turns = np.zeros(len(columns[0]), dtype=bool)
    turns[:1] = True
    for column in columns:
        turns[1:] |= column[1:] != column[:-1]
    return turns


def _named(hashes: np.ndarray, lengths: list[int], *wanted: int) -> list[np.ndarray]:
    """For every full window of a text the hash of the part it names, at each wanted level."""
    words, first = lengths[-1], lengths[0]
    if len(hashes) < words:
        return [np.zeros(0, dtype=np.int64) for _ in wanted]
    at = _smallest(window_hashes(hashes, first), words - first + 1)
    starts = [np.minimum(at, np.arange(len(at)) + words - lengths[level]) for level in wanted]
    return [window_hashes(hashes, lengths[level])[start].view(np.int64) for level, start in zip(wanted, starts, strict=True)]


def _windows(place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and word number of every window that lies within one row of a run."""
    counts = np.maximum(np.diff(place) - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return rows, np.repeat(place[:-1], counts) + np.arange(int(counts.sum())) - np.repeat(before, counts)


def _distinct_parts(texts: list[np.ndarray], lengths: list[int]) -> list[np.ndarray]:
    """The distinct first-level parts of each text of a run, found in one pass over all its words."""
    place = np.concatenate(([0], np.cumsum([len(one) for one in texts])))
    rows, at = _windows(place, lengths[-1])
    # The first-level part of a window is the one with the smallest hash, and neighbours mostly share it.
    named = _least(window_hashes(np.concatenate(texts), lengths[0]), lengths[-1] - lengths[0] + 1).view(np.int64)[at] if len(at) else at
    some = _turns(rows, named)
    rows, named = rows[some], named[some]
    order = np.lexsort((named, rows))
    rows, named = rows[order], named[order]
    fresh = _turns(rows, named)
    rows, named = rows[fresh], named[fresh]
    return np.split(named, np.searchsorted(rows, np.arange(1, len(texts))))


def _bytes_of(column: pa.Array, row: int) -> bytes:
    return column[row].as_py() or b""


def _summaries(lengths: list[int]):
    """Per text: number of words, digest of the words, and the distinct parts its windows name at the first level."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            counts, shas, parts, run, held = [], [], [], [], 0
            for row in range(batch.num_rows):
                words = _bytes_of(texts, row).split()
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                run.append(table.of(words))
                held += len(words)
                # Short texts are worked through together, about 64,000 words at a time.
                if held >= 1 << 16 or row == batch.num_rows - 1:
                    parts += _distinct_parts(run, lengths)
                    run, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(parts, pa.list_(pa.int64()))],
                ["doc_id", "digest", "n_words", "words_sha256", "parts"],
            )

    return summed


def _extended(lengths: list[int], level: int):
    """The distinct parts that a text's windows name at a level, where the part of the level before is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            texts, parts = batch.column(2).cast(pa.large_binary()), []
            for row in range(batch.num_rows):
                hashes = table.of(_bytes_of(texts, row).split())
                wanted = batch.column(3)[row].values.to_numpy(zero_copy_only=False)
                before, named = _named(hashes, lengths, level - 1, level)
                some = _turns(before, named)
                parts.append(np.unique(named[some][np.isin(before[some], wanted)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.int64()))], ["row", "doc_id", "parts"]
            )

    return run


def _full_windows(lengths: list[int]):
    """The digests of the full windows whose part of the last level but one is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for row in range(batch.num_rows):
                words = _bytes_of(texts, row).split()
                wanted = batch.column(3)[row].values.to_numpy(zero_copy_only=False)
                level = max(len(lengths) - 2, 0)
                (named,) = _named(table.of(words), lengths, level)
                some = _turns(named)
                starts = np.flatnonzero(np.isin(named[some], wanted)[np.cumsum(some) - 1])
                joined = memoryview(b" ".join(words))
                sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                ends = np.cumsum(sizes + 1) - 1
                begins = ends - sizes
                for cut in range(0, len(starts), 1 << 16):
                    some = starts[cut : cut + (1 << 16)]
                    spans = zip(begins[some].tolist(), ends[some + lengths[-1] - 1].tolist(), strict=True)
                    digests = [hashlib.blake2b(joined[begin:end], digest_size=16).digest() for begin, end in spans]
                    taken = pa.array(np.full(len(some), row))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(digests, pa.binary()), pa.array(some.astype(np.int32))],
                        ["row", "doc_id", "window", "start"],
                    )

    return run


def _covered(starts: np.ndarray, n_words: int, words: int) -> np.ndarray:
    """Marks the words that lie in a window with one of the given starts."""
    steps = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + words, -1)
    return np.cumsum(steps[:-1]) > 0


def _cut(words: int):
    """The text without the covered words, and the digest of the words that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, kept = [], [], []
            for row in range(batch.num_rows):
                text = (batch.column(1)[row].as_py() or "").encode()
                data = np.frombuffer(text, dtype=np.uint8)
                begins, ends, _ = words_of(data, np.array([0, len(data)]))
                starts = batch.column(2)[row].values.to_numpy(zero_copy_only=False)
                gone = _covered(starts, len(begins), words)
                left = np.flatnonzero(~gone)
                shas.append(hashlib.sha256(b" ".join([text[begins[i] : ends[i]] for i in left])).hexdigest())
                removed.append(int(gone.sum()))
                # What stands between two kept words stays; a cut run leaves its last separator.
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                parts, at = [], 0
                for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    parts.append(text[at : begins[begin]])
                    at = int(begins[end]) if end < len(begins) else len(text)
                parts.append(text[at:])
                kept.append(b"".join(parts).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(shas), pa.array(kept)],
                ["row", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def drop_repeats(docs: DataFrame, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_words, n_removed, kept_sha256, kept_text) per row of ``docs``.

    ``digest`` is the SHA-256 of the text (null for a null text), ``kept_sha256`` that of the
    kept words joined by one space, ``kept_text`` the text without the removed words; it is
    null where nothing was removed.
    """
    if words < 2:
        raise ValueError("a window has two words or more")
    lengths, kind = levels(words), docs.schema[id_col].dataType.simpleString()
    rows = bounded_batches(docs).select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)).alias("digest"), F.col(text_col).alias("text"),
    )
    found = settle(
        rows.mapInArrow(_summaries(lengths), f"doc_id {kind}, digest binary, n_words long, words_sha256 string, parts array<long>")
    )
    long_enough = (F.col("n_words") >= words) & F.col("doc_id").isNotNull()
    firsts = settle(found.filter(long_enough).groupBy("digest").agg(F.min("doc_id").alias("first")))

    def repeated(listed: DataFrame) -> DataFrame:
        """Parts that stand in two documents; settled, so that a join deals both sides and may split a hot part."""
        spans = listed.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        return settle(spans.filter("low < high").select("part"))

    def wanted(listed: DataFrame, *key: str) -> DataFrame:
        return listed.join(repeated(listed), "part").groupBy(*key).agg(F.collect_set("part").alias("parts"))

    listed = (
        found.filter(long_enough).join(firsts, (found["digest"] == firsts["digest"]) & (F.col("doc_id") == F.col("first")))
        .select("doc_id", found["digest"], F.explode("parts").alias("part"))
    )
    # One row per candidate text, numbered once it is written.
    spark = docs.sparkSession
    path = scratch_path(spark, "candidate-texts")
    texts = rows.join(wanted(listed, "doc_id", "digest").withColumnRenamed("parts", "wanted"), ["doc_id", "digest"])
    texts = texts.dropDuplicates(["doc_id", "digest"]).withColumn("row", F.monotonically_increasing_id())
    texts.select("row", "doc_id", "digest", "text", "wanted").write.parquet(path)
    stored = spark.read.parquet(path)
    open_to = stored.select("row", "doc_id", "text", "wanted")
    for level in range(1, len(lengths) - 1):
        parts = settle(open_to.mapInArrow(_extended(lengths, level), f"row long, doc_id {kind}, parts array<long>"))
        listed = parts.select("row", "doc_id", F.explode("parts").alias("part"))
        surviving = settle(wanted(listed, "row").withColumnRenamed("parts", "wanted"))
        open_to = stored.select("row", "doc_id", "text").join(surviving, "row").select("row", "doc_id", "text", "wanted")
        if surviving.isEmpty():
            break

    # Digests are made once and written: they are read for the earliest documents and again for the later ones.
    path = scratch_path(spark, "windows")
    open_to.mapInArrow(_full_windows(lengths), f"row long, doc_id {kind}, window binary, start int").write.parquet(path)
    windows = spark.read.parquet(path)
    earliest = settle(
        windows.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("window", "low")
    )
    later = windows.join(earliest, "window").filter("doc_id > low").groupBy("row").agg(F.collect_list("start").alias("starts"))
    cut = stored.select("row", "text").join(later, "row").select("row", "text", "starts").mapInArrow(
        _cut(words), "row long, n_removed long, kept_sha256 string, kept_text string"
    )
    cut = cut.join(stored.select("row", "doc_id", "digest"), "row").drop("row")

    copies = found.join(firsts, "digest", "left")
    whole = F.coalesce((F.col("n_words") >= words) & (F.col("doc_id") > F.col("first")), F.lit(False))
    return copies.drop("parts").join(cut, ["doc_id", "digest"], "left").select(
        "doc_id", "digest", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, EMPTY_SHA).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
        F.when(whole, "").otherwise(F.col("kept_text")).alias("kept_text"),
    )
