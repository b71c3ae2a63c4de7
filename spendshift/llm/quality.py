"""Document quality by histogram gradient-boosted trees over document statistics.

Each text becomes a few dozen statistics (sizes, shares of character classes, repetition of
words). Trees are grown level by level on binned statistics with logistic loss, all to the
same depth, and kept as flat arrays: the children of node n are 2n + 1 and 2n + 2, so a
batch of texts walks a tree with one numpy step per level.

The trees are fitted in the driver on a bounded sample: the ``SAMPLE`` labelled rows with
the smallest hash of their id. Scoring covers every row and every whole text.

Defined cases: a null text is empty; an empty text gets the score of its statistics; labels
other than 0 and 1 and null ids teach nothing; several labels of one document all count;
without labels every score is 0.5; repeated rows come back as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendshift.llm.tables import text_slices, words_of
from spendshift.llm.wordhash import SEEDS, word_hashes

SAMPLE, TREES, DEPTH, BINS, RATE, KEEP = 20_000, 80, 4, 64, 0.15, 0.7
_SMOOTH, _LEAST_WEIGHT = 1.0, 2.0

# Character classes by byte: other, lower, upper, digit, blank, line end, beyond ASCII, then signs one by one.
_SIGNS = ".,!?|*$%&#<>{}()[]:;-_=+/\\@'\""
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[0x20, 0x09]] = 4
_CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 5
_CLASS[128:] = 6
for _n, _sign in enumerate(_SIGNS):
    _CLASS[ord(_sign)] = 7 + _n
CLASSES = 7 + len(_SIGNS)
FEATURES = CLASSES + 8


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of the texts of a run, one row per text."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(rows), sizes)
    classes = np.bincount(_CLASS[data] + owner * CLASSES, minlength=rows * CLASSES).reshape(rows, CLASSES)
    starts, ends, place = words_of(data, offsets)
    words = np.diff(place)
    hashes = word_hashes(data, starts, ends, SEEDS[0])
    of = np.repeat(np.arange(rows), words)
    order = np.lexsort((hashes, of))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][fresh], minlength=rows)
    # The most frequent word: the longest run of equal hashes.
    firsts = np.flatnonzero(fresh)
    runs = np.diff(np.append(firsts, len(order)))
    most = np.zeros(rows)
    np.maximum.at(most, of[order][firsts], runs)
    same = np.zeros(len(of))
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    repeated = np.bincount(of, same, minlength=rows)
    lengths = (ends - starts).astype(float)
    long_words = np.bincount(of, lengths > 20, minlength=rows)
    safe_words, safe_size = np.maximum(words, 1), np.maximum(sizes, 1)
    return np.column_stack([
        classes / safe_size[:, None], np.log1p(sizes), np.log1p(words), np.bincount(of, lengths, minlength=rows) / safe_words,
        distinct / safe_words, most / safe_words, repeated / safe_words, long_words / safe_words,
        words / np.maximum(classes[:, 5] + 1, 1),
    ]).astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """Flat trees: the statistic and limit of each inner node, the values of the leaves."""

    feature: np.ndarray  # trees x (2^depth - 1)
    limit: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    start: float

    def score(self, table: np.ndarray) -> np.ndarray:
        total = np.full(len(table), self.start)
        rows = np.arange(len(table))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(table), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (table[rows, feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def grow(table: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees for labels 0 and 1."""
    inner = 2**depth - 1
    if not len(labels):
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, 2**depth)), 0.0)
    edges = [np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower")) for column in table.T]
    binned = np.stack([np.searchsorted(edge, column) for edge, column in zip(edges, table.T, strict=True)], axis=1)
    width = binned.shape[1]
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    total = np.full(len(labels), start)
    columns = (np.arange(width) * bins)[None, :]
    grown = []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-total))
        slope, weight = labels - chance, chance * (1 - chance)
        node = np.zeros(len(labels), dtype=np.int64)
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * bins) + columns + binned).ravel()
            g = np.bincount(cell, np.repeat(slope, width), minlength=count * width * bins).reshape(count, width, bins)
            h = np.bincount(cell, np.repeat(weight, width), minlength=count * width * bins).reshape(count, width, bins)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + _SMOOTH) + (ga - gl) ** 2 / (ha - hl + _SMOOTH) - ga**2 / (ha + _SMOOTH)
            gain[(hl < _LEAST_WEIGHT) | (ha - hl < _LEAST_WEIGHT)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                at, cut = divmod(int(best[k]), bins)
                if gain[k, at, cut] > 1e-6 and cut < len(edges[at]):
                    feature[first + k], limit[first + k] = at, edges[at][cut]
            node = 2 * node + 1 + (table[np.arange(len(node)), feature[node]] > limit[node])
        slot = node - inner
        leaf = rate * np.bincount(slot, slope, minlength=2**depth) / (np.bincount(slot, weight, minlength=2**depth) + _SMOOTH)
        total += leaf[slot]
        grown.append((feature, limit, leaf))
    return Trees(*(np.stack(part) for part in zip(*grown, strict=True)), start)


def _slices(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_slices(texts):
        yield statistics(data, offsets)


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample: int = SAMPLE,
) -> Trees:
    """Learn from the labelled rows of ``docs`` where ``usable`` (over the id) holds.

    The driver holds the statistics of at most ``sample`` label rows' documents.
    """
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL")
    if usable is not None:
        known = known.filter(usable)
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    # The sample bounds the broadcast, so the texts are never shuffled.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))), "id"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = np.concatenate(list(_slices(batch.column(1))))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["id", "label", "told"])

    # A drawn id may stand on many rows, so the joined rows are bounded again.
    kind = docs.schema[id_col].dataType.simpleString()
    joined = texts.select("id", "text", "label").mapInArrow(run, f"id {kind}, label int, told array<float>")
    told = joined.orderBy(F.xxhash64("id", "label", "told"), "id", "label").limit(sample).toArrow()
    # The driver's order of arrival must not matter.
    if not told.num_rows:
        return grow(np.zeros((0, FEATURES), np.float32), np.zeros(0))
    table = told.column("told").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    label = told.column("label").to_numpy()
    _, ids = np.unique(np.array(told.column("id").to_pylist(), dtype=object), return_inverse=True)
    order = np.lexsort((*table.T, label, ids))
    return grow(table[order], label[order].astype(float))


def score(docs: DataFrame, model: Trees, text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """The rows of ``docs`` with a score from 0 to 1, higher is better; a column of that name is replaced."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(table) for table in _slices(batch.column(at))]
            column = pa.array(np.concatenate(scores) if scores else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
