"""Registered queries of the training-data operators, with DuckDB text where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendshift.llm import alignment, bpe, language, lattice, neighbours, packing, periodic, quality, simhash, sketches, substrings, url_rules, warc
from spendshift.llm.tables import held_out, read
from spendshift.session import scratch_path

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_rules.RULE_COLUMNS)
    judged = url_rules.apply_rules(read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), ~held_out(F.col("id"), 4, 2))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.KEEP).cast("int").alias("predicted"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many of the following text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = sketches.with_next(read(spark, sf_dir, "documents"))
    edited = linked.withColumn("edited", _edited(F.col("text"), F.col("next_text")))
    told = edited.withColumn("edited_sketch", sketches.sketch(F.col("edited")))
    return told.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketches.as_text(F.col("sketch")).alias("fingerprint"), sketches.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        sketches.distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
        sketches.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs, ~held_out(F.col("doc_id"), 5, 0))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def _looped(text: Column, doc_id: Column) -> Column:
    """Every tenth text (by crc32 of the id) goes round in its own words from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return F.array_join(F.transform(places, lambda i: F.get(words, i)), " ")

    # The words are split once: the array is bound by a one-element transform.
    words = sketches.words(text)
    planted = F.element_at(F.transform(F.array(words), lambda array: F.when(F.size(array) > 0, tail(array))), 1)
    return F.when(h % 10 == 0, planted).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = periodic.collapse_runs(docs.select("doc_id", _looped(F.col("text"), F.col("doc_id")).alias("text")))
    lines = F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    build.__name__: build
    for build in (
        op1_url_filter, op2_quality_classifier, op3_substring_dedup, op4_nearest_neighbours, op5_document_fingerprints,
        op6_packing, op7_bpe, op8_warc, op9_language_id, op10_simhash, op11_token_alignment, op12_periodic_runs, op13_embedding_near_dedup,
    )
}

_HEX_TEN = "('0x' || substr(h, 1 + 10 * g, 10))::BIGINT"
ORACLES: dict[str, str] = {
    "op1_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50),
y AS (SELECT doc_id, s, md5(array_to_string(ws[s : s + 49], ' ')) AS k FROM x),
f AS (SELECT k, min(doc_id) AS m FROM y GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM y JOIN f USING (k) WHERE doc_id > m),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS latest FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(4), lambda g: array_to_string(list_transform(range(8),
    lambda n: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_HEX_TEN} >> (35 - 5 * n)::BIGINT) & 31)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM d""",
    # crc32 bit by bit; runs are islands of equal words q apart that no run of a smaller period contains.
    "op12_periodic_runs": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, doc_id::VARCHAR AS s FROM documents),
c AS (SELECT doc_id, ws, len(ws) AS n, xor(4294967295::UBIGINT, list_reduce(
  list_prepend(4294967295::UBIGINT, list_transform(range(1, len(s) + 1), lambda i: ascii(substr(s, i, 1))::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)))::BIGINT AS h FROM d),
g AS (SELECT doc_id, ws, n, h % 10 = 0 AND n > 0 AS looped, CASE WHEN n > 0 THEN h // 10 % n END AS a,
  CASE WHEN n > 0 THEN 1 + (n - h // 10 % n) // (3 + h // 10 % 8) END AS p FROM c),
t AS (SELECT doc_id, n, CASE WHEN looped THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM g),
e AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i FROM t),
m AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM e l JOIN e r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i WHERE 3 * (r.i - l.i) <= l.n),
o AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
x AS (SELECT doc_id, min(i) AS s, count(*) + q AS len, q FROM o GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
k AS (SELECT doc_id, count(*) AS n_runs, arg_max({'s': s, 'len': len, 'q': q}, [len / q, -s, -q]) AS best,
  string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS told FROM r GROUP BY doc_id),
v AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
u AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept FROM e ANTI JOIN v ON e.doc_id = v.doc_id AND e.i = v.i GROUP BY e.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.q::BIGINT AS period,
  (1000 * best.len // best.q)::BIGINT AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN k USING (doc_id) LEFT JOIN u USING (doc_id)""",
}
