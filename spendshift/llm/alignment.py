"""Alignment of two tokenizers' tokens over the same bytes, by an as-of merge per batch of documents.

Every text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B). For the start
of each A token ``pandas.merge_asof``, keyed by document, gives the B token that covers it, and the
other way round; the union of both directions is every pair of tokens whose bytes overlap
(a link). Where an A and a B token end together, a group ends.

What a pair of ids counts for is the number of documents that hold it linked. A task folds the
pairs of a batch of documents into one row, so a pair that every document holds is shuffled
once a batch and not once a document. The counts are joined back to the batches' distinct
pairs, and each batch of documents meets its counts in one bounded group.

Defined cases: texts that are null or empty, and texts that a vocabulary doesn't give back byte
for byte, have no tokens and zeros; special tokens' strings are ordinary text; a repeated row
counts as a document of its own; a very long text is a batch by itself; an empty table
gives no rows. Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendshift.llm.chunks import ChunkEncoder, token_bytes
from spendshift.llm.tables import bounded_batches, settle, text_slices
from spendshift.session import scratch_path

# Bytes of text that are aligned and folded together.
BATCH = 1 << 20
_SPACED = re.compile(" +[^ ]*")


class PieceEncoder(dict):
    """Texts to ids of a piece vocabulary; itself the table of known chunks (spaces and what follows them).

    No piece has a space after another character, so nothing is merged across the chunks.
    The fresh chunks of a batch of texts are encoded in one call. The table stops growing at ``most``
    chunks; results do not depend on it.
    """

    def __init__(self, path: str, most: int = 150_000) -> None:
        super().__init__()
        self.model, self.most = sentencepiece.SentencePieceProcessor(model_file=path), most
        pieces = [self.model.id_to_piece(n) for n in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", piece) for piece in pieces):
            raise ValueError("a piece holds a space after another character")
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(n) else piece.replace("▁", " ").encode() for n, piece in enumerate(pieces)
        ]
        # The model adds the first space of a chunk itself, but gives nothing for that space alone.
        self[" "] = array("I", [self.model.piece_to_id("▁")]).tobytes()
        self.fresh: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        return self.fresh[chunk]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the model puts a space before it."""
        chunks = [_SPACED.findall(" " + text) for text in texts]
        fresh = list(set().union(*chunks).difference(self))
        ids = self.model.encode([chunk[1:] for chunk in fresh], num_threads=1) if fresh else []
        self.fresh = {chunk: array("I", told).tobytes() for chunk, told in zip(fresh, ids, strict=True)}
        if len(self) + len(fresh) <= self.most:
            self.update(self.fresh)
        return [np.frombuffer(b"".join(map(self.__getitem__, found)), dtype="<u4") for found in chunks]


class Vocabulary:
    """Lengths, bytes and decimal digits of the ids of one side."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.bytes = tokens
        self.lengths = np.array([len(token) for token in tokens], dtype=np.int64)
        digits = [str(number).encode() for number in range(len(tokens))]
        self.width = np.array([len(one) for one in digits], dtype=np.int64)
        self.digits = np.zeros((len(tokens), int(self.width.max()) + 1), dtype=np.uint8)
        for number, one in enumerate(digits):
            self.digits[number, : len(one)] = list(one)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


@cache
def _encoders(path_a: str, path_b: str) -> tuple[ChunkEncoder, Vocabulary, PieceEncoder, Vocabulary]:
    ranks, special, _ = token_bytes(path_a)
    tokens = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for token, number in [*ranks.items(), *((token.encode(), number) for token, number in special.items())]:
        tokens[number] = token
    pieces = PieceEncoder(path_b)
    return ChunkEncoder(path_a, plain=True), Vocabulary(tokens), pieces, Vocabulary(pieces.bytes)


class Side:
    """The tokens of one vocabulary in a batch of documents, one after another."""

    def __init__(self, found: list[np.ndarray], vocabulary: Vocabulary, bases: np.ndarray) -> None:
        self.ids = np.concatenate([*found, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.counts = np.array([len(one) for one in found], dtype=np.int64)
        self.docs = np.repeat(np.arange(len(found)), self.counts)
        lengths = vocabulary.lengths[self.ids]
        # Places in the bytes of the whole batch, so that starts rise across documents as well.
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        if len(self.starts):
            firsts = np.concatenate(([0], np.cumsum(self.counts)[:-1]))
            shift = bases - np.where(self.counts > 0, self.starts[np.minimum(firsts, len(self.starts) - 1)], 0)
            self.starts, self.ends = self.starts + shift[self.docs], self.ends + shift[self.docs]


def links(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """The token numbers (of A, of B) of every overlapping pair."""

    def covering(one: Side, other: Side) -> np.ndarray:
        left = pd.DataFrame({"start": one.starts, "doc": one.docs})
        right = pd.DataFrame({"start": other.starts, "doc": other.docs, "token": np.arange(len(other.ids))})
        return pd.merge_asof(left, right, on="start", by="doc")["token"].to_numpy().astype(np.int64)

    if not len(a.ids):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    over_a, over_b = covering(a, b), covering(b, a)
    # Tokens that start together are found from both sides.
    alone = a.starts[over_b] != b.starts
    return np.concatenate((np.arange(len(a.ids)), over_b[alone])), np.concatenate((over_a, np.flatnonzero(alone)))


def _group_texts(a: Side, b: Side, names: tuple[Vocabulary, Vocabulary]) -> tuple[np.ndarray, list[bytes]]:
    """Per document: its number of groups, and ``a1,a2|b1;a3|b2`` with the ids of each group."""
    docs = len(a.counts)
    ends_a, ends_b = np.isin(a.ends, b.ends, assume_unique=True), np.isin(b.ends, a.ends, assume_unique=True)
    groups = np.bincount(a.docs[ends_a], minlength=docs)
    # Tokens in the order of their group, A before B; a comma, bar, semicolon or nothing follows each.
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    order = np.argsort(np.concatenate((group_a * 2, group_b * 2 + 1)), kind="stable")
    after = np.concatenate((np.where(ends_a, ord("|"), ord(",")), np.where(ends_b, ord(";"), ord(",")))).astype(np.uint8)
    last = np.concatenate((np.zeros(len(a.ids), dtype=bool), np.append(b.docs[1:] != b.docs[:-1], True)[: len(b.ids)]))
    width = max(names[0].digits.shape[1], names[1].digits.shape[1])
    cells = np.zeros((len(order), width), dtype=np.uint8)
    cells[: len(a.ids), : names[0].digits.shape[1]] = names[0].digits[a.ids]
    cells[len(a.ids) :, : names[1].digits.shape[1]] = names[1].digits[b.ids]
    widths = np.concatenate((names[0].width[a.ids], names[1].width[b.ids]))
    rows = np.arange(len(order))
    cells[rows, widths] = after
    cells[rows[last], widths[last]] = 0
    cells, sizes = cells[order], (widths + ~last)[order]
    told = cells[cells != 0].tobytes()
    bounds = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(a.counts + b.counts)))]
    return groups, [told[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def align(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH,
    with_groups: bool = False,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]), one row per row of ``docs``.

    ``n_best`` counts the links whose pair has its A id's largest count, ``count_sum`` adds up the counts of
    the links; ``groups`` is the text that the digest is of. Both paths must be open to every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    figures = ["n_a", "n_b", "n_groups", "n_links"]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per document, with its pairs as places in the batch's list; then the batch's list itself."""
        encoder, names_a, pieces, names_b = _encoders(tokenizer_a, tokenizer_b)
        for rows in batches:
            texts = rows.column(1)
            for first, last, data, offsets in text_slices(texts, batch):
                data = data.tobytes()
                told = [data[i:j].decode() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                found_a, found_b, sizes = [], [], []
                for text, ids_b in zip(told, pieces.encode(told), strict=True):
                    ids_a = np.frombuffer(encoder.encode(" " + text), dtype="<u4") if text else np.zeros(0, dtype="<u4")
                    whole = (" " + text).encode()
                    if not text or names_a.joined(ids_a) != whole or names_b.joined(ids_b) != whole:
                        ids_a, ids_b, whole = ids_a[:0], ids_b[:0], b""
                    found_a.append(ids_a)
                    found_b.append(ids_b)
                    sizes.append(len(whole))
                bases = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                a, b = Side(found_a, names_a, bases), Side(found_b, names_b, bases)
                at_a, at_b = links(a, b)
                groups, group_texts = _group_texts(a, b, (names_a, names_b))
                # A document's distinct pairs and how often it holds each.
                pairs, owners = a.ids[at_a] << 32 | b.ids[at_b], a.docs[at_a]
                distinct, places = np.unique(pairs, return_inverse=True)
                held, times = np.unique(owners * len(distinct) + places, return_counts=True)
                owner, place = held // max(len(distinct), 1), held % max(len(distinct), 1)
                bounds = np.searchsorted(owner, np.arange(last - first + 1)).astype(np.int32)
                key = uuid.uuid4().bytes
                counts = [a.counts, b.counts, groups, np.bincount(owners, minlength=last - first)]
                shas = [hashlib.sha256(text).hexdigest() if n else "" for text, n in zip(group_texts, a.counts.tolist(), strict=True)]
                number = last - first
                shown = pa.array([text.decode() for text in group_texts] if with_groups else [None] * number, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * number, pa.binary()), rows.column(0)[first:last], *[pa.array(one, pa.int64()) for one in counts],
                     pa.array(shas, pa.string()), shown, pa.ListArray.from_arrays(pa.array(bounds), pa.array(place.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(times.astype(np.int32))), pa.nulls(number, pa.list_(pa.int64())),
                     pa.nulls(number, pa.list_(pa.int32()))],
                    names,
                )
                for cut in range(0, len(distinct), 1 << 16):
                    some = slice(cut, cut + (1 << 16))
                    holders = np.bincount(place, minlength=len(distinct))[some].astype(np.int32)
                    listed = [pa.array([one], type=wanted) for one, wanted in (
                        (np.arange(len(distinct), dtype=np.int32)[some], pa.list_(pa.int32())), (holders, pa.list_(pa.int32())),
                        (distinct[some], pa.list_(pa.int64())), (holders, pa.list_(pa.int32())))]
                    # In the batch's own rows the places and holders stand for its pairs.
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key], pa.binary()), pa.nulls(1, rows.schema[0].type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()),
                         pa.nulls(1, pa.string()), listed[0], listed[1], listed[2], listed[3]],
                        names,
                    )

    names = ["batch", "doc_id", *figures, "groups_sha256", "groups", "places", "times", "pairs", "holders"]
    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    path = scratch_path(spark, "aligned")
    rows.mapInArrow(
        aligned,
        f"batch binary, doc_id {kind}, {', '.join(f'{name} long' for name in figures)}, groups_sha256 string, groups string, "
        "places array<int>, times array<int>, pairs array<long>, holders array<int>",
    ).write.parquet(path)
    told = spark.read.parquet(path)
    lists = told.filter("pairs IS NOT NULL").select("batch", F.explode(F.arrays_zip("places", "pairs", "holders")).alias("held"))
    listed = lists.select("batch", F.col("held.places").alias("place"), F.col("held.pairs").alias("pair"), F.col("held.holders").alias("holders"))
    counts = settle(listed.groupBy("pair").agg(F.sum("holders").alias("count")))
    # The largest count of an A id: one maximum an id, joined back; both sides may be split.
    id_a = F.shiftright("pair", 32).cast("int")
    largest = settle(counts.groupBy(id_a.alias("id_a")).agg(F.max("count").alias("largest")))
    judged = settle(
        counts.withColumn("id_a", id_a).join(largest, "id_a").select("pair", "count", (F.col("count") == F.col("largest")).alias("best"))
    )
    counted = listed.select("batch", "place", "pair").join(judged, "pair").select(F.col("batch").alias("held_by"), "place", "count", "best")
    out = [*figures, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    schema = ", ".join(f"{name} {'string' if name.startswith('groups') else 'long'}" for name in out)

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        """A batch of documents and the counts of its pairs."""
        counts, best = np.zeros(right.num_rows, dtype=np.int64), np.zeros(right.num_rows, dtype=bool)
        at = right.column("place").to_numpy()
        counts[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy()
        places, times = left.column("places").combine_chunks(), left.column("times").combine_chunks()
        bounds = places.offsets.to_numpy()
        flat, often = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        sums = [np.concatenate(([0], np.cumsum(amounts)))[bounds - bounds[0]] for amounts in (best[flat] * often, counts[flat] * often)]
        columns = {name: left.column(name) for name in ["doc_id", *figures, "groups_sha256"]}
        columns |= {name: pa.array(np.diff(one)) for name, one in zip(("n_best", "count_sum"), sums, strict=True)}
        if with_groups:
            columns["groups"] = left.column("groups")
        return pa.table([columns[name] for name in ["doc_id", *out]], names=["doc_id", *out])

    documents = told.filter("pairs IS NULL").drop("pairs", "holders")
    return documents.groupBy("batch").cogroup(counted.groupBy("held_by")).applyInArrow(summed, f"doc_id {kind}, {schema}")
