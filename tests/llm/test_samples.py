"""One id on very many rows does not widen what the driver collects."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendshift.llm import language, quality
from tests.llm.test_operators import sentence


def test_a_hot_id_stays_within_the_samples(spark, monkeypatch):
    rows = [(n, sentence(n, 30), "xx") for n in range(40)] + [(7, sentence(n, 30), "xx") for n in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)], "doc_id long, quality int")
    sizes = []

    def grow(table, label, plain=quality.grow):
        sizes.append(len(table))
        return plain(table, label)

    monkeypatch.setattr(quality, "grow", grow)
    # With a sample of all ids but not of all rows, the hot id is drawn for certain.
    quality.fit(docs, labels, sample=50)
    assert sizes == [50]
    # The languages are fitted in tasks: there are at most as many centroids as sampled rows, whatever an id stands on.
    assert 1 < len(language.fit(docs, F.lit(True), sample=60, centroids=400).names) <= 60
    sizes.clear()
    quality.fit(docs.filter("doc_id <> 7"), labels, sample=50)
    assert sizes == [39]
