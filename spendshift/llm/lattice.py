"""Near-duplicate vectors by lattice hashing: E8 cells in several tables, neighbouring cells, exact cosine.

Unit vectors are projected at random, ``blocks`` times onto eight dimensions in each of
``tables`` tables, and every projection is decoded to its nearest point of the E8 lattice
(the better of the nearest points of D8 and of D8 shifted by a half). The points of a table's
blocks are a cell. A vector stands at home in one cell a table and visits ``probes``
neighbouring ones: those that change one block's point to that one of its 240 nearest
lattice neighbours which the projection is closest to. Two vectors meet in a cell where at least one
is at home; every meeting is verified by the cosine in double precision.

A pair counts in one cell only: in the first table where it meets, there in the home of the vector
with the smaller number if it meets there, otherwise in that of the other. So links are counted without
listing pairs. Cells of more than ``most`` vectors are dealt in parts, and every two parts meet
in a task of their own; what leaves it is one row a vector, with its number of links there and the
smallest vector of its group there, whatever the number of pairs.

With the defaults a pair of cosine 0.95 is met with a probability of 0.98, one of 0.97 with 0.998
(in 64 dimensions, measured); more tables or probes raise that. Nothing is capped.

Defined cases: equal vectors are one node with its number of rows, so copies never multiply. Vectors that are
null, zero, of another length than most, or hold null or non-finite components, and rows
with a null id link with nothing and are their own component. Rows that share an id count as
other vectors of each other. Repeated rows come back as often as they stand; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendshift.llm.components import components
from spendshift.llm.tables import settle

LEAST, TABLES, BLOCKS, SCALE, PROBES, MOST, SEED = 0.95, 7, 2, 1.6, 4, 1_024, 42
# The 240 shortest vectors of the lattice, doubled so that they are whole numbers.
_SHORTEST = np.array(
    [[2 * s * (n == i) + 2 * t * (n == j) for n in range(8)] for i, j in combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    + [signs for signs in product((1, -1), repeat=8) if signs.count(-1) % 2 == 0],
    dtype=np.int64,
)


def _nearest_d8(points: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum: where it is odd, the worst coordinate goes the other way."""
    whole = np.rint(points)
    rest = points - whole
    odd = np.flatnonzero(whole.sum(axis=1) % 2 != 0)
    worst = np.abs(rest[odd]).argmax(axis=1)
    whole[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return whole


def decode(points: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row of eight numbers."""
    whole, half = _nearest_d8(points), _nearest_d8(points - 0.5) + 0.5
    nearer = ((points - whole) ** 2).sum(axis=1) <= ((points - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


class Cells:
    """The random projections of all tables and the cells of vectors under them."""

    def __init__(self, width: int, tables: int, blocks: int, scale: float, probes: int, seed: int = SEED) -> None:
        rnd, size = np.random.default_rng(seed), max(width, 8 * blocks)
        self.tables, self.blocks, self.probes = tables, blocks, probes
        self.turns = [
            np.linalg.qr(rnd.normal(size=(size, 8 * blocks)))[0][:width] * scale * np.sqrt(size / 8) for _ in range(tables)
        ]
        self.factors = rnd.integers(1, 1 << 62, size=(tables, 8 * blocks), dtype=np.int64) * 2 + 1
        self.marks = rnd.integers(1, 1 << 62, size=tables, dtype=np.int64)

    def of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per vector: its home cell of every table, and the neighbouring cells (tables x probes)."""
        homes = np.zeros((len(units), self.tables), dtype=np.int64)
        probes = np.zeros((len(units), self.tables, self.probes), dtype=np.int64)
        for table, (turn, factors) in enumerate(zip(self.turns, self.factors, strict=True)):
            points = (units @ turn).reshape(-1, 8)
            found = decode(points)
            places = np.rint(found * 2).astype(np.int64).reshape(len(units), -1)
            homes[:, table] = (places * factors).sum(axis=1)
            # A step v makes the squared distance larger by |v|^2 - 2 rest.v; all steps are equally long.
            gains = ((points - found) @ _SHORTEST.T).reshape(len(units), -1)
            steps = np.argsort(-gains, axis=1, kind="stable")[:, : self.probes]
            moved = (_SHORTEST[steps % 240] * factors.reshape(self.blocks, 8)[steps // 240]).sum(axis=2)
            probes[:, table] = _mixed(homes[:, table, None] + moved, self.marks[table])
            homes[:, table] = _mixed(homes[:, table], self.marks[table])
        return homes, probes.reshape(len(units), -1)


def _mixed(values: np.ndarray, mark: np.int64) -> np.ndarray:
    mixed = (values ^ mark).view(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _first_meetings(key: int, a: np.ndarray, b: np.ndarray, numbers: np.ndarray, homes: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Which of the pairs (rows a, b) count in cell ``key``: those that meet in no earlier place."""
    counts = np.zeros(len(a), dtype=bool)
    # From here on a is the row with the smaller number.
    a, b = np.where(numbers[a] < numbers[b], a, b), np.where(numbers[a] < numbers[b], b, a)
    open_to = np.arange(len(a))
    for table in range(homes.shape[1]):
        one, other = a[open_to], b[open_to]
        home_a, home_b = homes[one, table], homes[other, table]
        in_a = (home_a == home_b) | (probes[other, table] == home_a[:, None]).any(axis=1)
        in_b = (probes[one, table] == home_b[:, None]).any(axis=1)
        place = np.where(in_a, home_a, home_b)
        met = in_a | in_b
        counts[open_to[met & (place == key)]] = True
        open_to = open_to[~met]
        if not len(open_to):
            break
    return counts


def _groups(rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's group under the links (a, b)."""
    label = np.arange(rows)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(
    vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES,
    blocks: int = BLOCKS, scale: float = SCALE, probes: int = PROBES, most: int = MOST,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    ``n_links`` counts the other rows with a cosine of ``least`` or more, ``component_id`` is the
    smallest id reachable by links, ``kept`` whether that is the row's own.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    usable = F.coalesce(F.col(id_col).isNotNull() & vector.isNotNull() & finite, F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(usable, vector).alias("vector"))
    lengths = rows.filter("vector IS NOT NULL").groupBy(F.size("vector").alias("n")).count()
    first = lengths.orderBy(F.col("count").desc(), "n").first()
    width = first["n"] if first else 1
    rows = rows.withColumn("vector", F.when(F.size("vector") == width, F.col("vector")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [
                None if one is None else hashlib.blake2b((np.array(one, dtype=np.float64) + 0.0).tobytes(), digest_size=16).digest()
                for one in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], ["vec_id", "vector", "digest"])

    told = rows.mapInArrow(digest, f"vec_id {kind}, vector {rows.schema['vector'].dataType.simpleString()}, digest binary")
    distinct = told.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(width, tables, blocks, scale, probes)
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 512):
                values = _matrix(batch.column(4).slice(at, 512))
                found.append(cells.of(values / np.linalg.norm(values, axis=1, keepdims=True)))
            if not found:
                continue
            lists = []
            for part in zip(*found, strict=True):
                values = np.concatenate(part)
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "homes", "probes"])

    numbered = distinct.select("digest", "first", "copies", F.monotonically_increasing_id().alias("node"), "vector")
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in numbered.schema)
    nodes = settle(numbered.mapInArrow(place, f"{schema}, homes array<long>, probes array<long>"))

    # Cells that hold a vector at home and another one.
    taken = nodes.select(F.explode("homes").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("at_home"))
    stands = F.explode(F.concat(
        F.transform("homes", lambda key: F.struct(key.alias("key"), F.lit(True).alias("home"))),
        F.transform("probes", lambda key: F.struct(key.alias("key"), F.lit(False).alias("home"))),
    ))
    standing = settle(nodes.select("node", stands.alias("at")).select("node", "at.*").join(settle(taken), "key"))
    sizes = standing.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    sizes = settle(sizes.select("key", F.ceil(F.col("rows") / most).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = (
        standing.select("node", "key", "home").join(sizes, "key").select("node", "key", "home", part.alias("part"), others.alias("other"))
        .select("node", "key", "home", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    )
    gathered = met.join(nodes.select("node", "copies", "vector", "homes", "probes"), "node").select(
        "key", "low", "high", "part", "node", "copies", "home", "vector", "homes", "probes"
    )

    def verified(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Nodes with a link that counts here, the smallest node of their group, and their links."""
        key, low, high = (group.column(n)[0].as_py() for n in range(3))
        values = _matrix(group.column(7))
        units = values / np.linalg.norm(values, axis=1, keepdims=True)
        if low == high:
            a, b = np.nonzero(np.triu(units @ units.T >= least, 1))
        else:
            parts = group.column(3).to_numpy()
            one, other = np.flatnonzero(parts == low), np.flatnonzero(parts == high)
            a, b = np.nonzero(units[one] @ units[other].T >= least)
            a, b = one[a], other[b]
        at_home = group.column(6).to_numpy(zero_copy_only=False)
        either = at_home[a] | at_home[b]
        a, b = a[either], b[either]
        if not len(a):
            return None
        numbers, copies = group.column(4).to_numpy(), group.column(5).to_numpy()
        homes = _matrix(group.column(8), np.int64)
        near = _matrix(group.column(9), np.int64).reshape(len(homes), homes.shape[1], -1)
        counts = np.concatenate([
            _first_meetings(key, a[at : at + (1 << 17)], b[at : at + (1 << 17)], numbers, homes, near) for at in range(0, len(a), 1 << 17)
        ])
        a, b = a[counts], b[counts]
        links = np.bincount(a, copies[b], len(numbers)) + np.bincount(b, copies[a], len(numbers))
        linked = np.flatnonzero(links)
        return numbers[linked], numbers[_groups(len(numbers), a, b)[linked]], links[linked].astype(np.int64)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come one after another; the rows of an unfinished one are carried on."""
        names, kept = ["node", "root", "links"], []

        def finish(table: pa.Table) -> Iterator[pa.RecordBatch]:
            batch = table.combine_chunks().to_batches()[0]
            ends = np.flatnonzero(_changes(batch)) if batch.num_rows > 1 else np.zeros(0, dtype=np.int64)
            bounds = [0, *(ends + 1).tolist(), batch.num_rows]
            found = [verified(batch.slice(i, j - i)) for i, j in zip(bounds, bounds[1:], strict=False) if j - i > 1]
            found = [one for one in found if one is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in zip(*found, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*kept, batch])
            ends = np.flatnonzero(_changes(batch))
            before = sum(one.num_rows for one in kept)
            last = batch.slice(0, 1)
            if kept and not _same(kept[-1].slice(kept[-1].num_rows - 1), last):
                yield from finish(table.slice(0, before))
                kept, table, before = [], pa.Table.from_batches([batch]), 0
            if len(ends):
                yield from finish(table.slice(0, before + int(ends[-1]) + 1))
                kept = [batch.slice(int(ends[-1]) + 1)]
            else:
                kept.append(batch)
        if kept:
            yield from finish(pa.Table.from_batches(kept))

    cells = gathered.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = settle(cells.mapInArrow(verify, "node long, root long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = nodes.select("digest", "first", "copies", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = placed.join(names, "component").join(links, "node", "left").select(
        "digest", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return told.select("vec_id", "digest").join(classes, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    """Where the next row belongs to another cell or pair of parts."""
    keys = [batch.column(n).to_numpy() for n in range(3)]
    return np.logical_or.reduce([key[1:] != key[:-1] for key in keys])


def _same(one: pa.RecordBatch, other: pa.RecordBatch) -> bool:
    return all(one.column(n)[0].as_py() == other.column(n)[0].as_py() for n in range(3))
