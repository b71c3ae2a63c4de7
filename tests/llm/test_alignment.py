"""Alignment of two tokenizers' tokens against a brute-force version of its contract."""

from collections import Counter
from hashlib import sha256

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from spendshift.llm import alignment
from spendshift.llm.chunks import token_bytes
from spendshift.llm.queries import op11_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text, token by token."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_a = {number: token for token, number in token_bytes(A)[0].items()}

    def bytes_b(number):
        piece = model.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(number) else piece.replace("▁", " ").encode()

    told = []
    for text in texts:
        ids_a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = model.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(bytes_a[n] for n in ids_a) != whole or b"".join(map(bytes_b, ids_b)) != whole:
            ids_a, ids_b = [], []
        spans = []
        for ids, of in ((ids_a, bytes_a.__getitem__), (ids_b, bytes_b)):
            at, found = 0, []
            for number in ids:
                found.append((at, at + len(of(number)), number))
                at = found[-1][1]
            spans.append(found)
        links = [(a, b) for i, j, a in spans[0] for k, m, b in spans[1] if i < m and k < j]
        cuts = sorted({m for _, m, _ in spans[0]} & {m for _, m, _ in spans[1]})
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(n) for _, m, n in found if begin < m <= cut) for found in spans))
            begin = cut
        told.append((len(ids_a), len(ids_b), links, groups))
    counts = Counter(pair for _, _, links, _ in told for pair in set(links))
    largest = {}
    for (a, _), count in counts.items():
        largest[a] = max(largest.get(a, 0), count)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[pair] == largest[pair[0]] for pair in links), sum(counts[pair] for pair in links),
         sha256(";".join(groups).encode()).hexdigest() if n_a else "")
        for n_a, n_b, links, groups in told
    ]


ODD = [
    None, "", " ", "a", "a", " a  b ", "\n\tx \r\n", "<|endoftext|> and <s> </s> <unk> <0x41>", "café naïve ☃ 漢字 \U0001f600",
    "under▁score", "　wide", "it's 12 o'clock, isn't it?", "x" * 700, "\x00\x1c\x85", "word " * 300, "� é",
]


def rows_of(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, batch string, pair int, n_a string")
    found = alignment.align(docs, A, B, **more).orderBy("doc_id").collect()
    return [tuple(row)[1:8] for row in found]


def test_odd_texts(spark):
    wanted = brute(ODD)
    assert rows_of(spark, ODD) == wanted
    # Every text a batch of its own.
    assert rows_of(spark, ODD, batch=1) == wanted
    assert sum(row[0] == 0 for row in wanted) >= 3 and rows_of(spark, []) == []


def test_ids_of_other_types_and_repeated_rows(spark):
    docs = spark.createDataFrame([("x", "a b"), ("x", "a b"), (None, "a b")], "id string, body string")
    found = alignment.align(docs, A, B, id_col="id", text_col="body", with_groups=True).collect()
    wanted = brute(["a b"] * 3)[0]
    assert [tuple(row)[1:8] for row in found] == [wanted] * 3 and sorted(str(row.doc_id) for row in found) == ["None", "x", "x"]
    assert sha256(found[0].groups.encode()).hexdigest() == found[0].groups_sha256


def test_pieces_in_chunks_are_those_of_whole_texts(spark):
    encoder = alignment.PieceEncoder(B, most=50)
    texts = [row.text for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if row.text] + ODD[1:]
    assert [ids.tolist() for ids in encoder.encode(texts)] == [encoder.model.encode(text) or [int(encoder.model.piece_to_id("▁"))] for text in texts]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    found = [tuple(row) for row in op11_token_alignment(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()]
    assert [row[1:] for row in found] == brute([row.text for row in docs]) and [row[0] for row in found] == [row.doc_id for row in docs]
