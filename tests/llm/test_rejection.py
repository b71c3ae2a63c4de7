"""Noise and unlearned languages are rejected and keep their nearest language, short clean texts are not."""

from __future__ import annotations

import base64
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spendshift.llm import language
from tests.conftest import SMALL

POLISH = (
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem "
    "i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
)


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.read.parquet(f"{SMALL.replace('sf0.001', 'sf0.01')}/documents.parquet")
    return docs, language.fit(docs, F.col("doc_id") % 5 != 0)


def strange():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9)))
    for n in (20, 80, 400):
        yield " ".join(word() for _ in range(n))
        yield base64.b64encode(rnd.randbytes(4 * n)).decode()
        yield (POLISH * 20)[: 6 * n]
        yield "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(3 * n))


def test_noise_and_unlearned_languages_are_unknown(spark, learnt):
    docs, model = learnt
    table = spark.createDataFrame([(n, t) for n, t in enumerate(strange())], "doc_id long, text string")
    told = language.identify(table, model).collect()
    assert all(r.lang_rejected for r in told) and "und" not in {r.lang_pred for r in told}
    assert not any(r.lang_rejected for r in language.identify(table, model, reject=0.0).collect())
    mixed = docs.select("doc_id", "text", "lang").union(table.select(F.col("doc_id") + 10**6, "text", F.lit(None).cast("string")))
    kept = corpus_pipeline.language_id(spark, mixed, "")
    assert kept.filter(f"doc_id >= {10**6}").count() == 0 and kept.count() >= 980


@pytest.mark.parametrize("size", [30, 60, 120, 100_000])
def test_clean_texts_stay(learnt, size):
    docs, model = learnt
    cut = docs.filter("doc_id % 5 = 0 AND length(text) > 30").select("doc_id", "lang", F.substring("text", 1, size).alias("text"))
    found = language.identify(cut.filter(F.col("text").rlike("[a-zA-Z]{3}")), model).collect()
    assert sum(not r.lang_rejected for r in found) / len(found) >= 0.97


def plain_grams(text):
    """Hashed n-gram counts of one text, byte by byte."""
    fold = [b if b >= 128 else (b | 32 if chr(b).isalpha() else 32) for b in text.encode()]
    letters = [32, *fold, 32, 32, 32]
    found = {}
    for length in (1, 2, 3):
        for at in range(len(fold) + 1):
            told = letters[at : at + length]
            if told[0] == 32 and (length == 1 or told[1] == 32):
                continue
            gram = 0
            for letter in told:
                gram = (gram * 257 + letter) % 2**32
            place = (gram * 2654435761 + length * 97) % 2**32 >> 20
            found[place] = found.get(place, 0) + 1
    return found


def plain_unit(found, idf):
    weights = {place: math.log1p(n) * idf[place] for place, n in found.items()}
    size = math.sqrt(sum(w * w for w in weights.values())) or 1.0
    return {place: w / size for place, w in weights.items()}


def test_scores_against_plain_python(spark):
    """Frequencies, TF-IDF, centroids (one a language, so their mean) and cosines, rebuilt without arrays."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 4000").limit(60)
    rows = [r for r in docs.collect() if r.text]
    table = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    model = language.fit(table, F.lit(True), centroids=1)
    taught = [r for r in rows if r.lang is not None]
    grams = {r.doc_id: plain_grams(r.text) for r in rows}
    frequency = Counter(place for r in taught for place in grams[r.doc_id])
    idf = [math.log((1 + len(taught)) / (1 + frequency[place])) + 1 for place in range(language.DIMENSIONS)]
    centres = {}
    for lang in {r.lang for r in taught}:
        total = Counter()
        for r in taught:
            if r.lang == lang:
                total.update(plain_unit(grams[r.doc_id], idf))
        size = math.sqrt(sum(w * w for w in total.values()))
        centres[lang] = {place: w / size for place, w in total.items()}
    for r in language.identify(table.select("doc_id", "text"), model).collect():
        vector = plain_unit(grams[r.doc_id], idf)
        cosines = {lang: sum(w * centre.get(place, 0.0) for place, w in vector.items()) for lang, centre in centres.items()}
        assert r.lang_score == pytest.approx(max(cosines.values()), abs=1e-4)
        assert cosines[r.lang_pred] == pytest.approx(max(cosines.values()), abs=1e-4)


def test_only_texts_without_a_letter_are_und(spark, learnt):
    _, model = learnt
    texts = ["ok", "Bonjour", "word " * 50, "漢字", "a", None, "", "12 ... ", "_"]
    found = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()
    assert [r.lang_pred == "und" for r in sorted(found)] == [False] * 5 + [True] * 4
