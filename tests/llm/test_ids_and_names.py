"""Ids of every usual type, column names that clash, the longest rule, and recall at the production share."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spendshift.llm import bpe, neighbours, packing, quality, url_rules
from tests.llm.test_operators import sentence

KINDS = ["int", "string", "decimal(12,0)", "smallint"]
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, kind):
    rows = [(str(n), sentence(n, 30 + n), "clash", 1) for n in range(40)] + [(None, "a b", "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, piece string, label int")
    return docs.withColumn("doc_id", docs.doc_id.cast(kind))


@pytest.mark.parametrize("kind", KINDS)
def test_ids_keep_their_type(spark, kind):
    docs = docs_of(spark, kind)
    of = docs.schema["doc_id"].dataType
    packed, told = packing.pack(docs, WORD), bpe.digests(docs, BYTE)
    assert packed.schema["doc_id"].dataType == told.schema["doc_id"].dataType == of
    assert {str(r.doc_id) for r in packed.collect()} == {str(r.doc_id) for r in told.collect()} == {str(r.doc_id) for r in docs.collect()}
    # A text with a long unsplit run takes the way through leaves and joins.
    long = docs.select("doc_id", F.repeat(F.lit("ab"), 300).alias("text"))
    assert {r.n_tokens for r in bpe.digests(long, BYTE, leaf=64).collect()} == {bpe.digests(long, BYTE).first().n_tokens}
    labels = docs.filter("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id").cast("int") % 2).alias("quality"))
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == 41


def test_urls_with_clashing_names(spark):
    pages = spark.createDataFrame([("http://a.com/x", "1", "2", "3"), (None, "1", "2", "3")], "url string, __url string, judged_url string, judged string")
    rules = spark.createDataFrame([("com", "/", "block")], url_rules.RULE_COLUMNS)
    found = url_rules.apply_rules(pages, rules, name="told").collect()
    assert sorted((r["__url"], r.judged_url, r.judged, r.told.verdict) for r in found) == [("1", "2", "3", "allow"), ("1", "2", "3", "block")]


def test_the_longest_whole_rule_wins(spark):
    pages = spark.createDataFrame([("http://www.example.com/a/b/c/d/e/f/g/h/",)], "url string")
    rules = spark.createDataFrame([("www.example.com", "/", "allow"), ("com", "/a/b/c/d/e/f/g/h/", "block")], url_rules.RULE_COLUMNS)
    assert url_rules.apply_rules(pages, rules).first().judged.rule == "com/a/b/c/d/e/f/g/h/"


@pytest.mark.parametrize("clusters", [0, 60])
def test_recall_at_the_production_share(spark, clusters):
    rnd = np.random.default_rng(clusters)
    vectors = rnd.normal(size=(3_000, 64))
    if clusters:
        vectors = np.repeat(vectors[:clusters], 50, 0) + 0.35 * vectors
    rows = [(n, v.tolist()) for n, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for n in range(0, len(units), 50):
        cosines = units @ units[n]
        cosines[n] = -2
        hits += len(found[n] & set(np.argsort(-cosines)[:5].tolist()))
    assert hits / 300 >= 0.9
