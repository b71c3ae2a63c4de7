"""Windows may end after every sentence, and anywhere in long stretches without one."""

from __future__ import annotations

import random

import numpy as np
from tokenizers import Tokenizer

from spendshift.llm import packing
from tests.llm.test_operators import WORD


def lengths(spark, text: str, size: int) -> list[int]:
    held = {}
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    for r in packing.pack(docs, WORD, size=size).collect():
        held[r.sequence_id] = held.get(r.sequence_id, 0) + r.length
    return [held[n] for n in sorted(held)]


def test_every_sentence_end_is_offered(spark):
    rnd, size = random.Random(5), 256
    text = " ".join(" ".join(rnd.choice(["the", "cat", "house", "and"]) for _ in range(rnd.randrange(2, 12))) + "." for _ in range(500))
    ids = np.array(Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids + [1])
    _, ends = packing._encoder(WORD)
    places = sorted({*(np.flatnonzero(ends[ids]) + 1).tolist(), len(ids)})
    costs = {0: 0.0}
    for place in places:
        costs[place] = min(c + size - (place - s) + (0 if place == len(ids) else 4) for s, c in costs.items() if 0 < place - s <= size)
    got = lengths(spark, text, size)
    assert sum(size - n for n in got) + 4 * (len(got) - 1) == costs[len(ids)]


def test_a_stretch_without_sentences_is_filled(spark):
    size = 250
    got = lengths(spark, "cat and house " * 500, size)
    assert all(n == size for n in got[:-1]) and sum(got) == 1501
