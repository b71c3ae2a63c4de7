"""Language identification by nearest centroids of TF-IDF character n-grams.

A text becomes a vector over ``DIMENSIONS`` hashed byte n-grams (one to three bytes, ASCII
letters lower-cased, everything but letters read as one space), weighted by inverse document
frequency and scaled to length one. Each language has several centroids, found by spherical
k-means; a text takes the language of the centroid with the largest cosine. A text whose
largest cosine is below ``reject`` is too far from every language and is marked as rejected; it keeps the
nearest language. Without that argument the limit is learnt: ``MARGIN`` times a low quantile of the cosines of the centroid's
own training texts, thinned at random to the text's number of n-grams, because short texts are
farther from every centroid. It is never below ``REJECT``.

Document frequencies are counted over all labelled training rows. The centroids are fitted on
a bounded sample: at most ``SAMPLE`` training rows per language, drawn by a hash of their id. Each language
is fitted in a task of its own; the driver holds centroids and limits only (64 KB a language).

Defined cases: a text that is null or has no letter is ``und`` with score 0 and is rejected, no other text is ``und``;
rows with a null language teach nothing; without any training row every text is ``und``;
very long texts are counted in full; a repeated row counts as often as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendshift.llm.tables import bounded_batches, settle, text_slices

DIMENSIONS, SAMPLE, CENTROIDS, ROUNDS = 1 << 12, 1_500, 4, 12
# The least limit, the quantile and the share of it that make the others, and the texts that a quantile needs.
REJECT, QUANTILE, MARGIN, FEWEST = 0.08, 0.01, 0.6, 50
# Numbers of n-grams that have a limit of their own: 16, 32, ..., 8192.
_SIZES = 1 << np.arange(4, 14)
UNKNOWN = "und"
# Sampled ids up to which they are broadcast (about 20 MB).
SMALL_IDS = 300_000
_LETTER = re.compile(r"[^\W\d_]")

# ASCII letters fold to lower case, bytes of other letters stay, everything else is a space.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts of the texts of a run, one row per text."""
    rows = len(offsets) - 1
    # Two spaces before each text keep n-grams of neighbours apart.
    padded = np.full(len(data) + 2 * rows + 2, 32, dtype=np.uint8)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    padded[np.arange(len(data)) + 2 * row + 2] = _FOLD[data]
    owner = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    letters = padded.astype(np.uint32)
    grams, size = letters[: len(owner)], len(owner)
    found = np.zeros(rows * DIMENSIONS, dtype=np.float32)
    for length in (1, 2, 3):
        if length > 1:
            grams = grams * np.uint32(257) + letters[length - 1 : length - 1 + size]
        mixed = grams * np.uint32(2654435761) + np.uint32(length * 97)
        place = (mixed >> np.uint32(20)).astype(np.int64) + owner * DIMENSIONS
        # Runs of spaces tell nothing.
        told = letters[:size] != 32 if length == 1 else (letters[:size] != 32) | (letters[1 : size + 1] != 32)
        found += np.bincount(place[told], minlength=rows * DIMENSIONS).astype(np.float32)
    return found.reshape(rows, DIMENSIONS)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times inverse document frequency, of length one."""
    return unit(np.log1p(found) * idf)


@dataclass(frozen=True)
class Languages:
    """Names, one per centroid; centroids of length one; inverse document frequencies; limits by centroid and size."""

    names: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray

    def least(self, best: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The learnt limits of texts with these nearest centroids and n-gram counts."""
        size = np.searchsorted(_SIZES, grams.sum(axis=1), side="right") - 1
        return self.limits[best, np.maximum(size, 0)]


def _runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for first, last, data, offsets in text_slices(texts, 1 << 19):
        # Counts are dense, so a run of short texts is cut to a bounded number of rows.
        for at in range(0, last - first, 256):
            to = min(at + 256, last - first)
            yield first + at, first + to, counts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per dimension of one task, and their number under -1."""
    total, rows = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for batch in batches:
        for first, last, found in _runs(batch.column(0)):
            total += (found > 0).sum(axis=0)
            rows += last - first
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(-1, DIMENSIONS), pa.int32()), pa.array(np.concatenate(([rows], total)), pa.int64())],
        ["dimension", "rows"],
    )


def _clusters(vectors: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """Spherical k-means from evenly spaced starts; empty clusters are dropped."""
    centres = vectors[np.linspace(0, len(vectors) - 1, min(number, len(vectors))).astype(int)]
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(axis=1)
        centres = unit(np.stack([vectors[nearest == n].sum(axis=0) for n in range(len(centres)) if (nearest == n).any()]))
    return centres


def _limits(found: np.ndarray, idf: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Limits of one language's centroids by size.

    A centroid with too few texts of a size takes the limit of all texts of the language, and where
    these are too few as well that of the size before.
    """
    rnd, totals = np.random.default_rng(0), found.sum(axis=1)

    def nearest(rows: np.ndarray, size: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and cosine of texts, thinned to ``size`` n-grams if that is given; 128 texts at a time."""
        best, cosine = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
        for at in range(0, len(rows), 128):
            some = rows[at : at + 128]
            counts = found[some]
            if size:
                counts = rnd.binomial(counts.astype(np.int32), (size / totals[some])[:, None]).astype(np.float32)
            cosines = weighted(counts, idf) @ centres.T
            best[at : at + 128], cosine[at : at + 128] = cosines.argmax(axis=1), cosines.max(axis=1)
        return best, cosine

    owner, _ = nearest(np.arange(len(found)))
    limits = np.full((len(centres), len(_SIZES)), REJECT)
    for n, size in enumerate(_SIZES.tolist()):
        limits[:, n] = limits[:, max(n - 1, 0)]
        large = np.flatnonzero(totals >= size)
        if len(large) < FEWEST:
            continue
        _, cosines = nearest(large, size)
        for k in range(len(centres)):
            own = cosines[owner[large] == k]
            limits[k, n] = max(REJECT, MARGIN * float(np.quantile(own if len(own) >= FEWEST else cosines, QUANTILE)))
    return limits


def fit(
    docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample: int = SAMPLE, centroids: int = CENTROIDS,
) -> Languages:
    """Learn from the rows of ``docs`` where ``usable`` holds and the language is not null.

    A task holds ``sample`` texts of one language, the driver the centroids and ``DIMENSIONS`` sums.
    """
    taught = bounded_batches(docs).filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sums = taught.select(F.col(text_col).alias("text")).mapInArrow(_frequencies, "dimension int, rows long")
    summed = {row[0]: row[1] for row in sums.groupBy("dimension").agg(F.sum("rows")).collect()}
    rows = summed.get(-1, 0)
    frequency = np.array([summed.get(n, 0) for n in range(DIMENSIONS)])
    idf = np.log((1 + rows) / (1 + frequency)).astype(np.float32) + 1

    # About four samples of each language, by hash of the id; the smallest hashes of those are the sample.
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / F.lit(1 << 30)
    known = taught.groupBy(F.col(lang_col).alias("__known")).agg((4 * sample / F.count(F.lit(1))).alias("__share"))
    drawn = taught.select(id_col, lang_col).join(known, F.col(lang_col) == F.col("__known")).filter(place <= F.col("__share")).select(id_col, lang_col)
    order = Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col)
    chosen = drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample)
    # The chosen ids are sent to all tasks while they are few; with very many languages both sides are dealt.
    ids = settle(chosen.select(id_col, lang_col).distinct())
    few = ids.count() <= SMALL_IDS
    texts = taught.select(id_col, lang_col, text_col).join(F.broadcast(ids) if few else ids, [id_col, lang_col])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, found in _runs(batch.column(1)):
                rows, places = np.nonzero(found)
                bounds = pa.array(np.searchsorted(rows, np.arange(last - first + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], batch.column(2)[first:last],
                     pa.ListArray.from_arrays(bounds, pa.array(places.astype(np.int16), pa.int16())),
                     pa.ListArray.from_arrays(bounds, pa.array(found[rows, places], pa.float32()))],
                    ["lang", "hash", "places", "amounts"],
                )

    counted = texts.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("hash")).mapInArrow(
        sparse, "lang string, hash long, places array<smallint>, amounts array<float>"
    )
    # A drawn id may stand on many rows; each task passes on a sample of each language at most.
    again = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    bounded = counted.withColumn("place", again).filter(F.col("place") <= sample).drop("place")

    def learn(key: tuple, told: pa.Table) -> pa.Table:
        """Centroids and limits of one language, from its sample."""
        told = told.sort_by("hash")
        places, amounts = told.column("places"), told.column("amounts")
        vectors = np.zeros((told.num_rows, DIMENSIONS), dtype=np.float32)
        for n in range(told.num_rows):
            vectors[n, places[n].values.to_numpy()] = amounts[n].values.to_numpy()
        centres = _clusters(weighted(vectors, idf), centroids, ROUNDS)
        return pa.table(
            [pa.array([key[0].as_py()] * len(centres)), pa.array(range(len(centres)), pa.int32()),
             pa.array(list(centres.astype(np.float32)), pa.list_(pa.float32())), pa.array(list(_limits(vectors, idf, centres)), pa.list_(pa.float64()))],
            names=["lang", "number", "centre", "limits"],
        )

    learnt = bounded.groupBy("lang").applyInArrow(learn, "lang string, number int, centre array<float>, limits array<double>")
    told = learnt.toArrow().sort_by([("lang", "ascending"), ("number", "ascending")])
    centres = told.column("centre").combine_chunks().flatten().to_numpy().reshape(-1, DIMENSIONS)
    limits = told.column("limits").combine_chunks().flatten().to_numpy().reshape(-1, len(_SIZES))
    return Languages(told.column("lang").to_pylist(), centres, idf, limits)


def identify(
    docs: DataFrame, model: Languages, text_col: str = "text",
    names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_rejected"), reject: float | None = None,
) -> DataFrame:
    """The rows of ``docs`` with the language, its score (the largest cosine, 0 to 1), and whether it is rejected.

    Rejected are texts with a score below ``reject``, or without it below the model's limits, and those that are
    ``und``. Columns of ``docs`` that have one of the three names are replaced.
    """
    docs = bounded_batches(docs).drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages = np.array([*model.names, UNKNOWN], dtype=object)
        for batch in batches:
            found, scores, rejected = [], [], []
            texts = batch.column(at)
            for first, last, grams in _runs(texts):
                lettered = np.array([bool(_LETTER.search(texts[row].as_py() or "")) for row in range(first, last)])
                if model.names:
                    cosines = weighted(grams, model.idf) @ model.centroids.T
                    best = cosines.argmax(axis=1)
                    score = np.clip(cosines[np.arange(len(best)), best].astype(float), 0, 1)
                    near = score >= (model.least(best, grams) if reject is None else reject)
                else:
                    best, score = np.zeros(last - first, dtype=int), np.zeros(last - first)
                    near = np.zeros(last - first, dtype=bool)
                found.append(languages[np.where(lettered, best, len(model.names))])
                scores.append(np.where(lettered, score, 0.0))
                rejected.append(~(lettered & near))
            columns = [
                pa.array(np.concatenate(told) if told else [], kind)
                for told, kind in ((found, pa.string()), (scores, pa.float64()), (rejected, pa.bool_()))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True)]])
    return docs.mapInArrow(run, schema)
