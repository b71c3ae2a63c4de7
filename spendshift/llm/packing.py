"""Packing of token streams into fixed sequences by order-preserving dynamic programming.

Documents stay in the order of their ids. They are range-partitioned by id, and within a
slice the ids of all documents form one stream. A sequence is a window of the stream of at
most ``size`` tokens; where it may end: after a document (free), after a sentence
(``sentence_penalty``), or, in a stretch of more than ``size // 16`` tokens without either,
anywhere (``hard_penalty``); a ``grain`` above 1 thins the last two. The
cuts that minimise padding plus penalties follow from one pass with a monotone queue: the
cost of the best packing that ends at a cut is the least cost of a start within the last
``size`` tokens, plus the new window and the penalty.

The pass runs over stretches of about ``stretch`` tokens; the best cut near the end of a
stretch is fixed and what follows it is carried into the next one, so a stretch costs no
padding. Only the end of a slice does.

Defined cases: a null text is empty; an empty document is its end token alone; null ids
come first; rows that share an id are ordered by a hash of their text; an empty table gives
no pieces; a document longer than a sequence is cut as often as needed, never shortened.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendshift.llm.chunks import ChunkEncoder, token_bytes
from spendshift.llm.tables import bounded_batches

_ENCODERS: dict[str, tuple[ChunkEncoder, np.ndarray]] = {}
_SENTENCE_END = re.compile(rb"[.!?]+[\"')\]]*\xff?")


def _encoder(path: str) -> tuple[ChunkEncoder, np.ndarray]:
    """A worker's encoder, and which ids end a sentence."""
    if path not in _ENCODERS:
        ranks, _, _ = token_bytes(path)
        ends = np.zeros(max(ranks.values()) + 1024, dtype=bool)
        ends[[number for token, number in ranks.items() if _SENTENCE_END.fullmatch(token)]] = True
        _ENCODERS[path] = ChunkEncoder(path), ends
    return _ENCODERS[path]


def best_cuts(places: list[int], penalties: list[float], size: int, closed: bool) -> list[int]:
    """Where to end the windows of a stream that starts at 0.

    ``places`` are the places where a window may end, rising, no gap above ``size``. A closed
    stream ends at the last place; an open one at the best place near its end.
    """
    cost, back = [0.0], [0]
    at = [0, *places]
    queue = deque([0])
    for j in range(1, len(at)):
        while at[queue[0]] < at[j] - size:
            queue.popleft()
        best = queue[0]
        new = cost[best] + size + penalties[j - 1]
        cost.append(new)
        back.append(best)
        while queue and cost[queue[-1]] >= new:
            queue.pop()
        queue.append(j)
    j = len(at) - 1
    if not closed:
        j = min((k for k in range(len(at) - 1, 0, -1) if at[k] > at[-1] - size), key=cost.__getitem__)
    cuts = []
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs one slice's documents as they come; ``flush`` gives the finished pieces."""

    def __init__(self, size: int, ends: np.ndarray, sentence: float, hard: float, grain: int) -> None:
        self.size, self.ends, self.sentence, self.hard, self.grain = size, ends, sentence, hard, grain
        self.docs: list[tuple[object, int, int, np.ndarray]] = []  # id, its first token's place here, its tokens, their ids
        self.length = 0
        self.sequences = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.length, len(ids), ids))
        self.length += len(ids)

    def _places(self, stream: np.ndarray, doc_ends: np.ndarray) -> tuple[list[int], list[float]]:
        found = np.flatnonzero(self.ends[stream]) + 1
        if self.grain > 1 and len(found):
            # A coarser grain offers the last sentence end of each cell of ``grain`` tokens only.
            cells = found // self.grain
            found = found[np.append(cells[1:] != cells[:-1], True)]
        places = np.union1d(found, doc_ends)
        gaps = np.diff(places, prepend=0)
        wide = np.flatnonzero(gaps > self.size // 16)
        if len(wide):
            extra = [np.arange(places[k] - gaps[k] + self.grain, places[k], self.grain) for k in wide]
            hard = np.concatenate(extra)
            places = np.union1d(places, hard)
        penalties = np.full(len(places), self.sentence)
        if len(wide):
            penalties[np.isin(places, hard)] = self.hard
        penalties[np.isin(places, doc_ends)] = 0
        return places.tolist(), penalties.tolist()

    def flush(self, closed: bool) -> Iterator[tuple[object, int, bytes, int, int, int]]:
        """Finished pieces: id, start, ids, document's tokens, sequence number, offset."""
        if not self.docs:
            return
        stream = np.concatenate([ids[max(0, -first) :] for _, first, _, ids in self.docs])
        doc_ends = np.array([first + tokens for _, first, tokens, _ in self.docs])
        cuts = best_cuts(*self._places(stream, doc_ends), self.size, closed)
        begin, rest = 0, deque(self.docs)
        for end in cuts:
            while rest and rest[0][1] < end:
                doc_id, first, tokens, ids = rest[0]
                low, high = max(begin, first), min(end, first + tokens)
                yield doc_id, low - first, ids[low - first : high - first].tobytes(), tokens, self.sequences, low - begin
                if first + tokens > end:
                    break
                rest.popleft()
            self.sequences += 1
            begin = end
        self.docs = [(doc_id, first - begin, tokens, ids) for doc_id, first, tokens, ids in rest]
        self.length -= begin


def pack(
    docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    sentence_penalty: float = 4.0, hard_penalty: float = 64.0, grain: int = 1, stretch: int = 1 << 18,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), one row per piece.

    ``tokenizer`` is the path of a tokenizer file that every executor can open; ``ids`` holds
    the piece's token ids as little-endian unsigned 32-bit integers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    end = np.array([end_id], dtype="<u4")

    def table(pieces: list[tuple], part: int, id_type: pa.DataType) -> pa.RecordBatch:
        ids, starts, packed, tokens, numbers, offsets = zip(*pieces, strict=True)
        columns = [
            pa.array(ids, id_type), pa.array(starts, pa.int64()), pa.array([len(one) // 4 for one in packed], pa.int64()),
            pa.array(packed, pa.binary()), pa.array(tokens, pa.int64()),
            pa.array([part << 32 | number for number in numbers], pa.int64()), pa.array(offsets, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ends = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        packer = Packer(size, ends, sentence_penalty, hard_penalty, grain)
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.frombuffer(encoder.encode(batch.column(1)[row].as_py() or ""), dtype="<u4")
                packer.add(batch.column(0)[row].as_py(), np.concatenate((ids, end)))
                if packer.length >= stretch:
                    if pieces := list(packer.flush(closed=False)):
                        yield table(pieces, part, batch.schema.field(0).type)
        if pieces := list(packer.flush(closed=True)):
            yield table(pieces, part, batch.schema.field(0).type)

    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
