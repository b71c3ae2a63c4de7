"""Each operator against brute force on small tables, with nulls, ties, copies and odd texts."""

from __future__ import annotations

import hashlib
import random
import re
import struct
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendshift.llm import bpe, chunks, components, language, neighbours, packing, quality, simhash, sketches, substrings, url_rules, warc
from spendshift.session import scratch_path

DOCS = "doc_id long, text string, print string, version string, lang string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def sentence(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9))) for _ in range(words))


SHARED = sentence(1, 70)
TEXTS = [
    (1, sentence(2, 80) + " " + SHARED),
    (2, SHARED + "\n" + sentence(3, 40)),
    (3, sentence(4, 20) + "\t" + SHARED + "  " + sentence(5, 10) + " " + SHARED),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "one"),
    (8, "ONE"),
    (9, sentence(2, 80) + " " + SHARED),  # a copy of 1
    (9, sentence(2, 80) + " " + SHARED),  # a repeated row
    (10, sentence(6, 49)),
    (11, sentence(6, 49)),
    (12, sentence(6, 50)),
    (13, "é ü ñ " * 30 + "日本語 \x85 \u00a0 x"),
    (None, SHARED),
    (14, "tail " + sentence(7, 3000)),
    (15, "tail " + sentence(7, 3000) + " end"),
    (16, "x" * 40_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", None, "en", 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------ urls


def test_url_rules(spark):
    rules = [("COM", "/", "allow"), ("example.com", "/en/", "block"), ("a.example.com", "/en/x", "allow"),
             ("tie.org", "/a", "allow"), ("tie.org", "/a", "block"), (None, "/", "block"), ("net", "", "block")]
    urls = ["http://www.Example.com/en/1?x", "https://a.example.com/en/xyz#t", "https://a.example.com/en/y", "http://example.com",
            "http://com/", "ftp://x.net", "http://tie.org/abc", "http://xcom/", "no scheme", None, "", "http://b.com/" + "d/" * 500, "a://b://c.com/"]
    table = spark.createDataFrame([(n, u, "kept") for n, u in enumerate(urls)] + [(0, urls[0], "kept")], "page_id long, url string, judged string")

    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        return host.lower(), re.match(r"[^?#]*", rest[len(host):]).group()

    def wanted(url):
        host, path = parts(url)
        fits = [(len(h), len(p), v == "block", h.lower() + p, v) for h, p, v in rules
                if h and host and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        return (host, path, *(max(fits)[3:] if fits else (None, "allow")))

    found = url_rules.apply_rules(table, spark.createDataFrame(rules, url_rules.RULE_COLUMNS))
    got = sorted(((r.page_id, *r.judged) for r in found.collect()), key=repr)
    assert got == sorted(((n, *wanted(u)) for n, u in [*enumerate(urls), (0, urls[0])]), key=repr)
    none = url_rules.judge(table, spark.createDataFrame([], url_rules.RULE_COLUMNS))
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert url_rules.judge(table.limit(0), spark.createDataFrame(rules, url_rules.RULE_COLUMNS)).count() == 0


# ------------------------------------------------------------------ quality


def test_trees_learn_and_walk():
    rnd = np.random.default_rng(0)
    table = rnd.normal(size=(600, 5)).astype(np.float32)
    labels = ((table[:, 1] > 0.3) ^ (table[:, 3] > 0)).astype(float)
    trees = quality.grow(table, labels)
    assert ((trees.score(table) > 0.5) == labels).mean() > 0.97

    def walk(row):
        total = trees.start
        for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(table[:50]), [walk(row) for row in table[:50]])
    assert quality.grow(table[:0], labels[:0]).score(table[:2]).tolist() == [0.5, 0.5]


def test_statistics_of_runs_are_those_of_single_texts():
    texts = [t or "" for _, t in TEXTS]
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    together = quality.statistics(data, offsets)
    for n, text in enumerate(texts):
        own = np.frombuffer(text.encode(), dtype=np.uint8)
        assert np.allclose(together[n], quality.statistics(own, np.array([0, len(own)]))[0])
        words = text.encode().split()
        assert together[n][quality.CLASSES + 1] == pytest.approx(np.log1p(len(words)))
        assert together[n][quality.CLASSES + 3] == pytest.approx(len(set(words)) / max(1, len(words)))


def test_quality_over_tables(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (3, None, 1), (99, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.fit(docs, labels), name="print").collect()
    assert len(scored) == len(TEXTS) and all(0 <= r["print"] <= 1 for r in scored)
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0
    assert {r.quality_score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


# ------------------------------------------------------------------ repeated passages


def brute_repeats(rows, words):
    first, told = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORDS.findall(t or "")
        for s in range(len(w) - words + 1):
            first.setdefault(tuple(w[s : s + words]), i)
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = set()
        for s in range(len(w) - words + 1):
            if i is not None and first[tuple(w[s : s + words])] < i:
                gone.update(range(s, s + words))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        told.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(told, key=repr)


@pytest.mark.parametrize("words", [50, 7])
def test_repeats(docs, words):
    found = substrings.drop_repeats(docs, words=words).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=repr) == brute_repeats(TEXTS, words)
    for r in found:
        if r.kept_text is not None:
            assert hashlib.sha256(" ".join(WORDS.findall(r.kept_text)).encode()).hexdigest() == r.kept_sha256


def test_repeats_of_nothing(empty):
    assert substrings.drop_repeats(empty).count() == 0


# ------------------------------------------------------------------ neighbours


def test_neighbours(spark):
    rnd = np.random.default_rng(3)
    rows = [(n, rnd.normal(size=8).tolist(), 0) for n in range(300)]
    rows += [(n, [1.0] * 8, 1) for n in range(300, 420)]  # one hot vector
    rows += [(n, [2.0] * 8, 1) for n in range(420, 425)]
    rows += [(500, None, 0), (550, [0.0] * 8, 0), (600, [float("nan")] * 8, 0), (650, [None] * 8, 0), (700, [1.0], 0), (None, [1.0] * 8, 0), (50, rows[50][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, digest int")
    # With every cell visited, and blocks of a few rows, the result is exact.
    found = neighbours.nearest(table, F.col("vec_id") % 50 == 0, share=1.0, block=16, queries=2)
    got = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    valid = {n: np.array(np.float32(v), dtype=float) for n, v, _ in rows if n is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    assert set(got) == {n for n in valid if n % 50 == 0}
    for n, listed in got.items():
        q = valid[n]
        scores = {m: float((q * v).sum() / np.sqrt((q * q).sum()) / np.sqrt((v * v).sum())) for m, v in valid.items() if m != n}
        want = sorted(scores, key=lambda m: (-round(scores[m], 12), m))[:5]
        assert [m for m, _ in listed] == want
        assert np.allclose([s for _, s in listed], [scores[m] for m in want], atol=1e-12)
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_index_walk_order():
    rnd = np.random.default_rng(1)
    index = neighbours.Index(rnd.normal(size=(6, 3)), rnd.normal(size=(5, 3)), rnd.integers(0, 9, size=(6, 5)))
    query = rnd.normal(size=6)
    sums = ((index.first - query[:3]) ** 2).sum(1)[:, None] + ((index.second - query[3:]) ** 2).sum(1)
    for wanted in (0, 1, 20, 60, 10_000):
        order, held, flags = np.argsort(sums, axis=None), 0, np.zeros(30, dtype=bool)
        for cell in order:
            if held >= wanted:
                break
            flags[cell] = True
            held += index.sizes.ravel()[cell]
        assert (index.visited(query, wanted).ravel() == flags).all()


# ------------------------------------------------------------------ sketches


def hashes_of(text, shingle=sketches.SHINGLE):
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    words = WORDS.findall(text or "")
    if not words:
        return set()
    own = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    if len(own) < shingle:
        return {signed(xxhash.xxh64_intdigest(",".join(map(str, own)).encode(), 42))}
    found = set()
    for at in range(len(own) - shingle + 1):
        value = 42
        for h in own[at : at + shingle]:
            value = xxhash.xxh64_intdigest(struct.pack("<q", h), value)
        found.add(signed(value))
    return found


def test_sketches(docs, empty):
    linked = sketches.with_next(docs, bits=2)
    rows = linked.select(
        "doc_id", "text", "sketch", "next_text", sketches.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near"),
        sketches.containment(F.col("sketch"), F.col("next_sketch")).alias("inside"), sketches.distinct_shingles(F.col("sketch")).alias("n"),
    ).collect()
    order = sorted(((i, t or "") for i, t in TEXTS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = [(*row, order[(n + 1) % len(order)][1]) for n, row in enumerate(order)]
    assert sorted(((r.doc_id, r.text, r.next_text) for r in rows), key=repr) == sorted(want, key=repr)
    for r in rows:
        own, following = hashes_of(r.text), hashes_of(r.next_text)
        assert r.sketch == sorted(own)[: sketches.SIZE]
        if len(own | following) <= sketches.SIZE:
            assert r.near == pytest.approx(len(own & following) / len(own | following) if own | following else 1.0)
        else:
            assert r.near == pytest.approx(len(own & following) / len(own | following), abs=0.2)
        if len(own | following) < sketches.SIZE:
            assert r.n == len(own) and r.inside == pytest.approx(len(own & following) / len(own) if own else 1.0)
    merged = sketches.merge_sketches(linked.withColumn("key", F.lit(1)), "key", "sketch").first().sketch
    assert merged == sorted(set().union(*[hashes_of(t) for _, t in TEXTS]))[: sketches.SIZE]
    assert sketches.with_next(empty).count() == 0


# ------------------------------------------------------------------ packing


def test_best_cuts_are_the_cheapest():
    rnd = random.Random(2)
    for _ in range(300):
        size = rnd.randrange(5, 20)
        places, at = [], 0
        for _ in range(rnd.randrange(1, 14)):
            at += rnd.randrange(1, size + 1)
            places.append(at)
        penalties = [rnd.choice([0, 0, 1.0, 3.0]) for _ in places]

        costs = [0.0]
        for j, place in enumerate(places):
            starts = zip(costs, [0, *places[:j]])
            costs.append(min(c + size - (place - s) + penalties[j] for c, s in starts if place - s <= size))

        cuts = packing.best_cuts(places, penalties, size, closed=True)
        assert cuts[-1] == places[-1]
        cost, before = 0.0, 0
        for cut in cuts:
            assert cut - before <= size
            cost += size - (cut - before) + penalties[places.index(cut)]
            before = cut
        assert cost == pytest.approx(costs[-1])


@pytest.mark.parametrize("stretch", [1 << 18, 300])
def test_packing_loses_no_token(docs, stretch):
    size = 256
    library = Tokenizer.from_file(WORD)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, WORD, size=size, stretch=stretch).collect():
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[i, len(ids)], key=lambda r: (r.sequence_id, r.offset))
        copies = sum(1 for j, u in TEXTS if (j, u) == (i, t))
        joined = b"".join(r.ids for r in pieces)
        assert joined == np.array(ids * copies, dtype="<u4").tobytes()
        assert all(len(r.ids) == 4 * r.length for r in pieces)
        at = 0
        for r in pieces:
            assert r.start == at % len(ids)
            at += r.length
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size


def test_packing_nothing(empty):
    assert packing.pack(empty, WORD).count() == 0


# ------------------------------------------------------------------ byte-pair encoding


def test_vocabulary_entries_encode_to_themselves():
    """What merging by rank rests on."""
    for path in (BYTE, WORD):
        library = Tokenizer.from_file(path)
        ranks, _, mark = chunks.token_bytes(path)
        tokens = {number: token for token, number in library.get_vocab().items()}
        for number in ranks.values():
            token = tokens[number]
            if not mark or token.endswith(mark):
                assert [t.id for t in library.model.tokenize(token.removesuffix(mark) if mark else token)] == [number]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_encode_like_the_library(path):
    encoder, library, rnd = chunks.ChunkEncoder(path, most=500), Tokenizer.from_file(path), random.Random(4)
    letters = [*"ab E's't1 9\n\r\t  .,!é ñΣς\u00a0 \x1c\x85\u0301ſİ", "<|endoftext|>", "<|startoftext|>", "\n\n", "   ", "日本", "😀", "\u3000"]
    for _ in range(2_000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(40)))
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_tree_concatenation():
    one, library, rnd = bpe.Bpe(BYTE), Tokenizer.from_file(BYTE), random.Random(5)
    for _ in range(400):
        letters = rnd.choice(["abetionrsh", "a", "=-*#", "日本語é한국"])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 300)))
        leaves = [one.merge(part) for part in bpe.halves(text.encode(), rnd.choice([4, 8, 16, 64]))]
        assert one.tree(leaves) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [1 << 14, 64])
def test_bpe_digests(spark, docs, empty, leaf):
    library = Tokenizer.from_file(BYTE)
    texts = [*TEXTS, (20, "a\n\n" + "b" * 300 + "  <|endoftext|>" + "\n" * 300 + "c" * 90 + "'s"), (20, "a\n\n" + "b" * 300), (20, "a\n\n" + "b" * 300)]

    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    table = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, ids int")
    got = bpe.digests(table, BYTE, leaf=leaf).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((want(*row) for row in texts), key=repr)
    ids = {r.doc_id: r.ids for r in bpe.encode(docs.filter("doc_id = 16"), BYTE, leaf=leaf).collect()}
    assert np.frombuffer(ids[16], dtype="<u4").tolist() == library.encode("x" * 40_000, add_special_tokens=False).ids
    assert bpe.digests(empty, BYTE).count() == 0


# ------------------------------------------------------------------ archive


def test_archive_round_trip(spark):
    import base64

    rows = [(1, "http://a/", "body"), (2, "http://b/\r\nX: 1", "body"), (3, None, "other é"), (4, "u", None), (5, "v", ""), (None, "n", "body"),
            (None, "n", "alone"), (3, None, "other é"), (7, "w", "z" * 100_000)]
    table = spark.createDataFrame([(*row, 9) for row in rows], "page_id long, url string, html string, payload int")
    folder = scratch_path(spark, "warc")
    warc.write(table, folder)

    def want(page, html):
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        latest = max(same, default=None)
        again = latest is not None and page != latest
        data = (html or "").encode()
        return (page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", latest if again else None)

    found = warc.read(spark, folder).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr)
    assert got == sorted((want(p, h) for p, _, h in rows), key=repr)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h in rows})
    for r in warc.records(spark, folder).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        block = rest[: int(fields[b"Content-Length"])]
        assert head.startswith(b"WARC/1.1\r\n") and rest[len(block):] == b"\r\n\r\n"
        assert base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()) == fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:")
        if fields[b"WARC-Type"] == b"response":
            assert block.partition(b"\r\n\r\n")[2] == bytes(r.payload)
        else:
            assert block == b""
    warc.write(table.limit(0), folder + "-none")
    assert warc.read(spark, folder + "-none").count() == 0


def test_damaged_payload_is_found(spark):
    folder = scratch_path(spark, "warc")
    warc.write(spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string"), folder)
    bad = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit(b"bodY"))
    bad.write.parquet(f"{folder}-bad/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}-bad/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, f"{folder}-bad").collect()


# ------------------------------------------------------------------ languages


def test_languages(spark, docs, empty):
    rnd = random.Random(6)
    kinds = {"xx": "abcde", "yy": "fghij", "zz": "àéîõü"}
    rows = [(n, " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(12)), lang)
            for n, (lang, letters) in enumerate(list(kinds.items()) * 60)]
    rows += [(900, None, "xx"), (901, "123 !!", "yy"), (902, "", None), (903, "abcab " * 5000, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(table, F.col("doc_id") % 5 != 0)
    found = {r.doc_id: r for r in language.identify(table.withColumn("lang_pred", F.lit(1)), model).collect()}
    assert len(found) == len(rows)
    for n, text, lang in rows:
        if text is None or not re.search(r"[^\W\d_]", text):
            assert (found[n].lang_pred, found[n].lang_score) == ("und", 0.0)
        elif lang:
            assert found[n].lang_pred == lang and 0 < found[n].lang_score <= 1
    assert found[903].lang_pred == "xx"
    assert {r.lang_pred for r in language.identify(docs, language.fit(empty, F.lit(True))).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


# ------------------------------------------------------------------ fingerprints


def brute_simhash(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORDS.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[n : n + 3]) for n in range(max(1, len(words) - 2))]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashed) > len(hashed))


def brute_groups(prints):
    """Index of the group of each fingerprint."""
    group = list(range(len(prints)))

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group[root(a)] = root(b)
    return [root(n) for n in range(len(prints))]


def test_simhash_groups(docs, empty):
    found = simhash.near_duplicates(docs).collect()
    prints = [brute_simhash(t) for _, t in TEXTS]
    groups = brute_groups(prints)
    names = {g: min((i for (i, _), h in zip(TEXTS, groups) if h == g and i is not None), default=None) for g in groups}
    want = sorted(((i, p, names[g]) for (i, _), p, g in zip(TEXTS, prints, groups)), key=repr)
    assert sorted(((r.doc_id, r.print % 2**64, r.component_id) for r in found), key=repr) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_every_near_pair_is_linked(spark):
    rnd = random.Random(8)
    values = [0, 2**64 - 1]
    for _ in range(60):
        base = rnd.getrandbits(64)
        values += [base] + [base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 6))) for _ in range(6)]
    values = sorted(set(values))
    signed = {v - 2**64 if v >= 2**63 else v: v for v in values}
    table = spark.createDataFrame([(s,) for s in signed], "print long")
    for distance in (0, 1, 2, 3):
        got = {frozenset((signed[r.a], signed[r.b])) for r in simhash.links(table, distance).collect()}
        want = {frozenset((a, b)) for n, a in enumerate(values) for b in values[:n] if (a ^ b).bit_count() <= distance}
        assert got == want
    with pytest.raises(ValueError):
        simhash.links(table, 4)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(n, n + 1) for n in range(40)] + [(100, 100), (200, 201), (201, 200), (200, 201), (None, 5)]
    edges += [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    parent = {n: n for edge in edges for n in edge if n is not None}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    assert got == {n: root(n) for n in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
