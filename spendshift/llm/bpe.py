"""Byte-pair encoding and decoding of whole texts; long unsplit text by tree concatenation.

A text is split where the vocabulary's rule always splits (before white space that follows
another character) and the chunks are encoded one by one. A chunk with more than ``leaf``
bytes between its splits cannot be encoded alone at that size: it is cut in halves again
and again, the leaves are rows that Spark spreads over its tasks, and neighbours are joined
up the tree. At a join a window around the seam is encoded anew and grown until it shares a
token with the left ids and one with the right ids: from a shared token on, each side's ids
are the only valid ones, because an encoding is valid exactly if each pair of adjacent
tokens is, and both sides have that token with its neighbours.

Decoding joins the bytes of the ids; invalid UTF-8 becomes replacement characters.

Defined cases: a null text is empty and has no ids; equal rows come back as often as they
stand; a text of any length is encoded in full; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendshift.llm.chunks import ChunkEncoder, token_bytes
from spendshift.llm.tables import settle

# Fixed value: the splitting rule of the byte-level vocabulary.
_RULE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


class Bpe:
    """One vocabulary in a worker: encoding of unsplit bytes, joins, and decoding."""

    def __init__(self, path: str) -> None:
        self.encoder = ChunkEncoder(path)
        ranks, special, _ = token_bytes(path)
        self.merge = self.encoder.merger._encode_single_piece
        self.bytes = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, number in ranks.items():
            self.bytes[number] = token
        for token, number in special.items():
            self.bytes[number] = token.encode()
        self.lengths = np.array([len(token) for token in self.bytes])

    def ends(self, ids: list[int]) -> np.ndarray:
        """Where each token ends, in bytes."""
        return np.cumsum(self.lengths[ids]) if ids else np.zeros(0, dtype=np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.bytes[number] for number in ids.tolist()]).decode("utf-8", "replace")

    def join(self, left: list[int], right: list[int], window: int = 8) -> list[int]:
        """Ids of the concatenation of two encoded pieces of one unsplit text."""
        if not left or not right:
            return left or right
        while True:
            a, b = left[-window:], right[:window]
            middle = self.merge(b"".join([self.bytes[number] for number in [*a, *b]]))
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            ends, seam = self.ends(middle), int(self.lengths[a].sum())
            spans = set(zip((ends - self.lengths[middle]).tolist(), ends.tolist(), strict=True))
            ends_a, ends_b = self.ends(a), self.ends(b) + seam
            # The last shared token on the left, the first on the right.
            at_a = next((n for n in range(len(a) - 1, 0, -1) if (int(ends_a[n - 1]), int(ends_a[n])) in spans), None)
            at_b = next((n for n in range(len(b) - 1) if (int(ends_b[n] - self.lengths[b[n]]), int(ends_b[n])) in spans), None)
            if (whole_left or at_a is not None) and (whole_right or at_b is not None):
                begin = 0 if at_a is None else int(ends_a[at_a - 1])
                end = int(ends[-1]) if at_b is None else int(ends_b[at_b])
                kept = [n for n, stop in zip(middle, ends.tolist(), strict=True) if begin < stop <= end]
                before = [] if at_a is None else left[: len(left) - len(a) + at_a]
                after = [] if at_b is None else right[at_b + 1 :]
                return before + kept + after
            window *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """Ids of the concatenation of encoded leaves, joined in pairs up a tree."""
        while len(leaves) > 1:
            pairs = [self.join(leaves[n], leaves[n + 1]) for n in range(0, len(leaves) - 1, 2)]
            leaves = pairs + leaves[len(pairs) * 2 :]
        return leaves[0] if leaves else []


@cache
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def halves(data: bytes, leaf: int) -> list[bytes]:
    """A text cut in halves, between code points, until no part is above ``leaf`` bytes."""
    if len(data) <= leaf:
        return [data]
    middle = len(data) // 2
    while middle < len(data) and data[middle] & 0xC0 == 0x80:
        middle += 1
    return halves(data[:middle], leaf) + halves(data[middle:], leaf) if middle < len(data) else [data]


def has_long_run(text: str, data: bytes, leaf: int) -> bool:
    """Whether the vocabulary's rule leaves more than ``leaf`` bytes unsplit."""
    if len(data) <= leaf or max(map(len, data.split()), default=0) < leaf and b" " * (leaf // 2) not in data.translate(_TO_SPACE):
        return False
    return any(len(match.group().encode()) > leaf for match in _RULE.finditer(text))


def pieces(text: str, bpe: Bpe, leaf: int) -> list[tuple[bytes | None, list[bytes]]]:
    """A text as finished ids and, between them, unsplit runs as their leaves."""
    found: list[tuple[bytes | None, list[bytes]]] = []
    at = 0
    for begin, end in [*(match.span() for match in bpe.encoder.special.finditer(text)), (len(text), len(text))]:
        # Where text that needs no cutting began, and where its last split other than white space ended.
        rest = solid = at
        blanks: list[str] = []
        for match in _RULE.finditer(text[at:begin]):
            token = match.group()
            if len(token.encode()) > leaf:
                ids = bpe.encoder.encode(text[rest:solid])
                found.append((ids + b"".join(array("I", bpe.merge(blank.encode())).tobytes() for blank in blanks), []))
                found.append((None, halves(token.encode(), leaf)))
                rest, blanks = at + match.end(), []
                solid = rest
            elif token.isspace():
                blanks.append(token)
            else:
                solid, blanks = at + match.end(), []
        found.append((bpe.encoder.encode(text[rest:end]), []))
        at = end
    return found


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 1 << 14) -> DataFrame:
    """(doc_id, ids) per row of ``docs``; ids as little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a byte-level tokenizer file that every executor can open;
    ``leaf`` is the number of bytes above which unsplit text is cut and spread. A text
    without such a run stays in its task; only the others are shuffled.
    """
    return _encoded(docs, tokenizer, id_col, text_col, leaf, "ids binary", lambda ids, bpe: (ids,))


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 1 << 14) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the ids and their decoding, each as a digest."""

    def finish(ids: bytes, bpe: Bpe) -> tuple:
        decoded = bpe.decode(np.frombuffer(ids, dtype="<u4")).encode()
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _encoded(
        docs, tokenizer, id_col, text_col, leaf, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish
    )


def _encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, leaf: int, out: str, finish) -> DataFrame:
    names = [column.split()[0] for column in out.split(", ")]
    kinds = [{"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[column.split()[1]] for column in out.split(", ")]

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished rows, and the pieces of texts with a long run."""
        bpe = vocabulary(tokenizer)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text = text or ""
                    data = text.encode()
                    if not has_long_run(text, data, leaf):
                        rows.append((doc_id, None, None, None, None, None, *finish(bpe.encoder.encode(text), bpe)))
                        continue
                    sha = hashlib.sha256(data).digest()
                    for piece, (ids, leaves) in enumerate(pieces(text, bpe, leaf)):
                        if ids is not None:
                            rows.append((doc_id, sha, piece, 0, ids, None, *[None] * len(names)))
                        rows += [(doc_id, sha, piece, n, None, one, *[None] * len(names)) for n, one in enumerate(leaves)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(
                        zip(*rows, strict=True),
                        [batch.schema.field(0).type, pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *kinds], strict=True)],
                    ["doc_id", "sha", "piece", "part", "ids_done", "leaf", *names],
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer)
        for batch in batches:
            done = [
                ids if leaf is None else array("I", bpe.merge(leaf)).tobytes()
                for ids, leaf in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(done, pa.binary())], ["doc_id", "sha", "piece", "part", "ids_done"]
            )

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        """One text's pieces in order; copies of a row bring every piece as often."""
        bpe = vocabulary(tokenizer)
        told: dict[int, dict[int, bytes]] = {}
        copies = 0
        for piece, part, ids in zip(*(table.column(n).to_pylist() for n in ("piece", "part", "ids_done")), strict=True):
            told.setdefault(piece, {})[part] = ids
            copies += (piece, part) == (0, 0)
        joined = []
        for piece in sorted(told):
            runs = [np.frombuffer(told[piece][part], dtype="<u4").tolist() for part in sorted(told[piece])]
            joined.append(array("I", bpe.tree(runs)).tobytes())
        row = finish(b"".join(joined), bpe)
        return pa.table(
            [pa.array([key[0].as_py()] * copies, table.schema.field("doc_id").type), *[pa.array([value] * copies, kind) for value, kind in zip(row, kinds, strict=True)]],
            names=["doc_id", *names],
        )

    id_kind = docs.schema[id_col].dataType.simpleString()
    piece_columns = f"doc_id {id_kind}, sha binary, piece int, part int, ids_done binary, leaf binary"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    told = settle(rows.mapInArrow(narrow, f"{piece_columns}, {out}"))
    finished = told.filter("sha IS NULL").select("doc_id", *names)
    split = told.filter("sha IS NOT NULL").drop(*names)
    spread = split.repartition("doc_id", "sha", "piece", "part").mapInArrow(leaves, piece_columns.removesuffix(", leaf binary"))
    return finished.unionByName(spread.groupBy("doc_id", "sha").applyInArrow(whole, f"doc_id {id_kind}, {out}"))
