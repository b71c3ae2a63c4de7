"""Periodic runs of words within a document, by seed and extend along diagonals.

A run is a stretch of consecutive words whose smallest period is q (words q apart are
equal), of at least ``max(least, times * q)`` words, that no neighbouring word extends.
Along the diagonal of lag q such a run matches itself over at least
``max(least - q, (times - 1) * q)`` words. Lags are taken in classes from 2^j to 2^(j+1) - 1, and
the k-grams of a class have the largest power of two within the overlap that its lags
guarantee; with three periods or more k is above the lag. By the theorem of Fine and Wilf the next occurrence of a
k-gram inside a run of smallest period q is then exactly q words on, so each k-gram is paired with
its next occurrence only: pairs grow with the words, even in a text of one repeated word.
A table with the furthest covered word of each lag skips seeds inside a stretch that is extended.

k-grams are compared by exact ranks (pairs of ranks of half the length), not by hashes.
The levels end as soon as no k-gram repeats, which most texts reach at two to eight words.

Defined cases: a null text has no words and no runs; a text shorter than ``least`` words has
no runs; overlapping runs of different periods all count; repeated rows come back as often as
they stand; very long texts are worked through whole, one text in memory at a time; other
columns of the table, whatever their names, are passed on; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAST, TIMES = 24, 3
RUN = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))
_ARROW_RUN = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items are equal, looked at in growing steps."""
    at, step = 0, 64
    while at < len(a):
        differs = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(differs):
            return at + int(differs[0])
        at, step = at + step, step * 2
    return len(a)


def _classes(words: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """Smallest lag, largest lag and k-gram length of each class, for a text of so many words."""
    low, most = 1, words // times
    # The short lags share one class: each guarantees the overlap of the worst of them.
    while low <= most:
        high = low * 2 - 1
        k = 1
        while k * 2 <= min(max(least - q, (times - 1) * q) for q in {low, high, *[q for q in (least // times, least // times + 1) if low <= q <= high]}):
            k *= 2
        yield low, high, k
        low = high + 1


def find_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a text given as word numbers, by start and period."""
    runs: list[tuple[int, int, int]] = []
    ranks, length = words, 1
    for low, high, k in _classes(len(words), least, times):
        while length < k:
            if len(ranks) <= length:
                return sorted(runs)
            paired = ranks[:-length] * np.int64(len(words) + 1) + ranks[length:]
            distinct, ranks = np.unique(paired, return_inverse=True)
            length *= 2
            if len(distinct) == len(paired):
                return sorted(runs)
        order = np.argsort(ranks, kind="stable")
        same = ranks[order[1:]] == ranks[order[:-1]]
        seeds = order[:-1][same]
        lags = order[1:][same] - seeds
        wanted = (lags >= low) & (lags <= high)
        seeds, lags = seeds[wanted], lags[wanted]
        order = np.lexsort((seeds, lags))
        seeds, lags = seeds[order], lags[order]
        # Neighbouring seeds of one lag stand in one stretch.
        fresh = np.ones(len(seeds), dtype=bool)
        fresh[1:] = (lags[1:] != lags[:-1]) | (seeds[1:] != seeds[:-1] + 1)
        furthest: dict[int, int] = {}
        for seed, lag in zip(seeds[fresh].tolist(), lags[fresh].tolist(), strict=True):
            if seed < furthest.get(lag, 0):
                continue
            begin = seed - _equal(words[:seed][::-1], words[lag : seed + lag][::-1])
            end = seed + _equal(words[seed : len(words) - lag], words[seed + lag :]) + lag
            furthest[lag] = end - lag
            if end - begin >= max(least, times * lag):
                runs.append((begin, end - begin, lag))
    return sorted(runs)


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length for its period; ties to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse_runs(
    docs: DataFrame, text_col: str = "text", names: tuple[str, str, str, str] = ("n_words", "runs", "best", "collapsed"),
    least: int = LEAST, times: int = TIMES,
) -> DataFrame:
    """The rows of ``docs`` with their number of words, runs, best run (by length over period) and collapsed text.

    The collapsed text holds one space between its words; words that a run contains after its
    first period are left out. Columns of ``docs`` that have one of the four names are replaced.
    """
    if least < 2 or times < 3:
        raise ValueError("a run has two words and three periods or more")
    kept = [column for column in docs.columns if column not in names]
    docs = docs.select(*[f"`{column}`" for column in kept])
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, best, texts = [], [], [], []
            for text in batch.column(at).cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                runs: list[tuple[int, int, int]] = []
                if len(words) >= least:
                    numbers: dict[bytes, int] = {}
                    told = np.array([numbers.setdefault(word, len(numbers)) for word in words], dtype=np.int64)
                    runs = find_runs(told, least, times)
                    if runs:
                        steps = np.zeros(len(words) + 1, dtype=np.int64)
                        for start, length, period in runs:
                            steps[start + period] += 1
                            steps[start + length] -= 1
                        words = [words[n] for n in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
                    counts.append(len(told))
                else:
                    counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), one, strict=True)) for one in runs])
                one = best_run(runs)
                best.append(None if one is None else dict(zip(("start", "length", "period"), one, strict=True)))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(found, _ARROW_RUN), pa.array(best, _ARROW_RUN.value_type),
                 pa.array(texts, pa.binary()).cast(pa.string())],
                [*batch.schema.names, *names],
            )

    added = [T.LongType(), RUN, RUN.elementType, T.StringType()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, kind in zip(names, added, strict=True)]])
    return docs.mapInArrow(run, schema)
