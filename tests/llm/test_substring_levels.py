"""Substring dedup: levels, colliding word bytes, other id types."""

import random
import uuid

import numpy as np
import pytest

from spendshift.llm import substrings
from tests.llm.test_operators import sentence


def test_levels_double_up_to_the_full_length():
    assert substrings.levels(50) == [13, 25, 50] and substrings.levels(2) == [2] and substrings.levels(16) == [16]
    assert all(b <= 2 * a for n in range(2, 300) for a, b in zip(substrings.levels(n), substrings.levels(n)[1:]))


@pytest.mark.parametrize("words", [2, 17, 50, 70])
def test_equal_windows_name_equal_parts(words):
    rnd = np.random.default_rng(words)
    passage = rnd.integers(0, 6, 120).astype(np.uint64)
    texts = [np.concatenate((rnd.integers(0, 6, n).astype(np.uint64), passage, rnd.integers(0, 6, 30).astype(np.uint64))) for n in (0, 5, 91)]
    lengths = substrings.levels(words)
    for level in range(len(lengths)):
        named = {}
        for text in texts:
            for at, part in enumerate(substrings._named(text, lengths, level)[0].tolist()):
                assert named.setdefault(text[at : at + words].tobytes(), part) == part


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_colliding_polynomials_are_told_apart(spark):
    """Polynomials modulo 2^64 cannot tell a Thue-Morse word from its opposite."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    base = sentence(5, 49).split()
    rows = [(1, " ".join([*base[:20], one, *base[20:]])), (2, " ".join([*base[:20], other, *base[20:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substrings.drop_repeats(docs).collect()] == [0, 0]


@pytest.mark.parametrize("kind", ["int", "string", "decimal(12,0)", "smallint"])
def test_ids_of_other_types(spark, kind):
    rnd = random.Random(1)
    shared = sentence(9, 60)
    rows = [(str(n), f"{sentence(rnd.randrange(999), 5)} {shared} {sentence(rnd.randrange(999), 5)}", "x", 1, "y") for n in range(1, 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, row string, part int, wanted string")
    docs = docs.withColumn("doc_id", docs.doc_id.cast(kind))
    found = {str(r.doc_id): (r.n_words, r.n_removed) for r in substrings.drop_repeats(docs).collect()}
    assert found == {"1": (70, 0), "2": (70, 60), "3": (70, 60), "4": (70, 60)}


def test_levels_end_where_nothing_survives(spark):
    """13 words repeat, 25 do not."""
    shared = sentence(3, 20)
    docs = spark.createDataFrame([(n, f"{sentence(10 + n, 40)} {shared} {sentence(50 + n, 40)}") for n in range(6)], "doc_id long, text string")
    assert {r.n_removed for r in substrings.drop_repeats(docs).collect()} == {0}


def test_windows_are_digested_once(spark, tmp_path, monkeypatch):
    """Both the earliest documents and the later ones are found from one pass over the texts."""
    made, folder = substrings._full_windows, str(tmp_path)

    def counted(lengths):
        run = made(lengths)

        def counting(batches):
            for batch in run(batches):
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                    file.write(str(batch.num_rows))
                yield batch

        return counting

    monkeypatch.setattr(substrings, "_full_windows", counted)
    shared = sentence(9, 60)
    docs = spark.createDataFrame([(n, f"{sentence(10 + n, 5)} {shared} {sentence(50 + n, 5)}") for n in range(3)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substrings.drop_repeats(docs).collect()) == [0, 60, 60]
    # A text of 70 words has 21 windows.
    assert 3 * 11 <= sum(int(file.read_text()) for file in tmp_path.iterdir()) <= 3 * 21


@pytest.mark.parametrize("length", [1, 2, 5, 38, 100])
def test_smallest_of_consecutive_values(length):
    values = np.random.default_rng(length).integers(0, 9, 100).astype(np.uint64)
    spans = [values[at : at + length] for at in range(len(values) - length + 1)]
    assert substrings._smallest(values, length).tolist() == [at + int(span.argmin()) for at, span in enumerate(spans)]
    assert substrings._least(values, length).tolist() == [int(span.min()) for span in spans]


@pytest.mark.parametrize("words", [2, 17, 50])
def test_distinct_parts_of_a_run_of_texts(words):
    """Texts shorter than a window, empty, of one word only, and equal neighbours."""
    rnd, lengths = np.random.default_rng(words), substrings.levels(words)
    one = rnd.integers(0, 4, 200).astype(np.uint64)
    texts = [one[:0], one[: words - 1], one, one, np.zeros(3 * words, dtype=np.uint64), one[50 : 50 + words], one[:0]]
    wanted = [np.unique(substrings._named(text, lengths, 0)[0]).tolist() for text in texts]
    assert [part.tolist() for part in substrings._distinct_parts(texts, lengths)] == wanted
    assert [part.tolist() for part in substrings._distinct_parts(texts[:2], lengths)] == [[], []]
