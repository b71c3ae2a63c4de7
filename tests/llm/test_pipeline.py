"""The pipeline stage by stage on the small documents table, and the registered queries' columns."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from spendshift.llm import bpe, language, simhash
from spendshift.llm.tables import held_out
from tests.conftest import SMALL
from tests.llm.test_operators import WORDS, brute_repeats
from tests.llm.test_resemblance import brute_kept

COLUMNS = {
    "op1_url_filter": "page_id host path rule verdict",
    "op2_quality_classifier": "doc_id held_out score predicted",
    "op3_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op4_nearest_neighbours": "query_id rank vec_id score",
    "op5_document_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op9_language_id": "doc_id held_out lang_pred score",
    "op10_simhash": "doc_id fingerprint component_id",
}
KINDS = {"op1": "bigint string string string string", "op2": "bigint boolean double int", "op3": "bigint bigint bigint string",
         "op4": "bigint int bigint double", "op5": "bigint bigint string string string double double",
         "op6": "bigint bigint bigint bigint bigint bigint bigint", "op7": "bigint bigint string string",
         "op8": "bigint bigint string string bigint", "op9": "bigint boolean string double", "op10": "bigint string bigint"}


@pytest.fixture(scope="module")
def source(spark):
    """The documents with an extra column whose name the stages use inside."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("print", F.lit("kept")).withColumn("kept_text", F.col("doc_id"))
    path = corpus_pipeline.scratch_path(spark, "source")
    table.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns(spark, name):
    frame = contract.queries()[name](spark, SMALL)
    wanted = COLUMNS[name].split()
    assert frame.columns[: len(wanted)] == wanted
    assert [kind for _, kind in frame.dtypes][: len(wanted)] == KINDS[name.split("_")[0]].split()
    assert frame.count() > 0


@pytest.mark.parametrize("name", ["op1_url_filter", "op3_substring_dedup", "op8_warc"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    result = db.execute(contract.oracle_sql()[name])
    columns = [item[0] for item in result.description]
    got = contract.queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, result.fetchall()))


def test_held_out_rows_are_crc_remainders(spark):
    import zlib

    rows = spark.createDataFrame([(n,) for n in [*range(50), -7, None]], "doc_id long")
    for r in rows.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_accuracy_on_held_out_rows(spark):
    folder = SMALL.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = contract.queries()["op9_language_id"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = contract.queries()["op2_quality_classifier"](spark, folder).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.95


def test_stages(spark, source):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "near_dedup", "substring_dedup", "packing"]
    kept = {"input": source}
    for (name, stage), before in zip(corpus_pipeline.STAGES[:-1], ["input", *names]):
        path = corpus_pipeline.scratch_path(spark, name)
        stage(spark, kept[before], SMALL).write.parquet(path)
        kept[name] = spark.read.parquet(path)
        assert kept[name].columns == source.columns
    rows = {name: frame.select("doc_id", "text", "print", "kept_text").collect() for name, frame in kept.items()}
    texts = {name: {r.doc_id: r.text for r in found} for name, found in rows.items()}
    assert all(r.print == "kept" and r.kept_text == r.doc_id for found in rows.values() for r in found)

    # Languages: what the operator finds near a centroid.
    model = language.fit(source, F.lit(True))
    near = {r.doc_id for r in language.identify(source, model).collect() if not r.lang_rejected}
    assert set(texts["language_id"]) == near
    # Quality: the labelled documents of high quality stay, nearly all others go.
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    judged = [(marks[i], i in texts["quality_classifier"]) for i in texts["language_id"] if i in marks]
    assert np.mean([stays == bool(mark) for mark, stays in judged]) > 0.95
    # Near duplicates: the smallest id of every group of a 5-word resemblance of 0.8 or more, by brute force.
    assert sorted(texts["near_dedup"], key=repr) == brute_kept(sorted(texts["quality_classifier"].items()))
    # Passages: the kept words, by brute force.
    want = {i: (n - gone, sha) for i, n, gone, sha in brute_repeats(list(texts["near_dedup"].items()), 50)}
    for i, t in texts["substring_dedup"].items():
        words = WORDS.findall(t or "")
        assert (len(words), hashlib.sha256(" ".join(words).encode()).hexdigest()) == want[i]
    assert set(texts["substring_dedup"]) == set(want)
    lengths = kept["substring_dedup"].filter("n_chars <> length(text)").count()
    assert lengths == source.filter("n_chars <> length(text)").count()
    # Packing: every token of every kept text.
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(dict)
    for r in corpus_pipeline.STAGES[-1][1](spark, kept["substring_dedup"], SMALL).collect():
        pieces[r.doc_id][r.start] = r.ids
    for i, t in texts["substring_dedup"].items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert b"".join(pieces[i][start] for start in sorted(pieces[i])) == np.array(ids, dtype="<u4").tobytes()


def test_near_dedup_links_by_fingerprints_and_by_resemblance(spark):
    """Texts that repeat one phrase have equal SimHash fingerprints, however few of their 5-word shingles are the same."""
    phrase, own = ("alpha beta gamma " * 200).strip(), lambda tag: " ".join(f"{tag}{n}" for n in range(12))
    long = [f"w{n}" for n in range(300)]
    rows = [
        (5, f"{phrase} {own('x')}"), (3, f"{phrase} {own('y')}"), (7, " ".join(long)), (8, " ".join([*long[:-9], *"abcdefghi"])),
        (9, own("z")), (None, own("z")), (None, "alone on its own line"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.simhash(rows[0][1].encode()) ^ simhash.simhash(rows[1][1].encode()) == 0
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL).collect()
    assert sorted(map(repr, (r.doc_id for r in kept))) == sorted(map(repr, [3, 7, 9, None]))


def test_run_and_registration(spark):
    assert "pipeline" in contract.queries() and "pipeline" not in contract.oracle_sql()
    assert contract.queries()["pipeline"](spark, SMALL).count() > 0


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(contract.__file__).parent
    own = {"corpus_pipeline.py", "__spark_entry__.py"}
    for path in [*root.glob("*.py"), *root.glob("spendshift/**/*.py"), *root.glob("tests/*.py"), *root.glob("tools/*.py")]:
        if path.name not in own and "llm" not in path.parts:
            assert not re.search(r"(from|import)\s+(\S*llm|corpus_pipeline)", path.read_text()), path


def test_bpe_decodes_what_it_encodes(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    one = bpe.Bpe(path)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs, path).collect():
        assert one.decode(np.frombuffer(r.ids, dtype="<u4")) == (texts[r.doc_id] or "")
