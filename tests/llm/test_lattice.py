"""Lattice hashing: the decoder, links, groups and recall against brute force."""

import numpy as np
import pytest

from spendshift.llm import lattice
from spendshift.llm.queries import op13_embedding_near_dedup


def table(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"vec_id {kind}, embedding array<float>, node int, links string, key long")


def units(rnd, rows, width=64):
    found = rnd.normal(size=(rows, width))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def beside(rnd, vectors, cosine):
    """Vectors with exactly this cosine to the given ones."""
    turned = rnd.normal(size=vectors.shape)
    turned -= (turned * vectors).sum(axis=1, keepdims=True) * vectors
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    return cosine * vectors + np.sqrt(1 - cosine**2) * turned


def brute(ids, vectors, least=0.95):
    """(vec_id, n_links, component_id, kept) of every row by all pairs."""
    known = np.array([i is not None and v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v) for i, v in zip(ids, vectors)])
    values = np.stack([np.array(v, dtype=np.float32).astype(float) if ok else np.zeros(64) for v, ok in zip(vectors, known)])
    values /= np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-300)
    linked = (values @ values.T >= least) & known[:, None] & known
    np.fill_diagonal(linked, False)
    names = [i if i is not None else None for i in ids]
    while True:
        new = [min([names[n], *[names[m] for m in np.flatnonzero(linked[n])]]) if known[n] else names[n] for n in range(len(ids))]
        if new == names:
            break
        names = new
    return [(i, int(row.sum()), name, i == name) for i, row, name in zip(ids, linked, names)]


def order(rows):
    return sorted(rows, key=lambda row: tuple((value is None, value) for value in row))


def test_decoder_finds_the_nearest_lattice_point():
    points = np.random.default_rng(0).normal(size=(200, 8)) * 1.3
    found = lattice.decode(points)
    twice = np.rint(found * 2).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1) & (twice.sum(axis=1) % 4 == 0)).all()
    near = ((points - found) ** 2).sum(axis=1)
    for step in lattice._SHORTEST / 2:
        assert (near <= ((points - found - step) ** 2).sum(axis=1) + 1e-9).all()
    assert (near <= 1 + 1e-9).all() and len(lattice._SHORTEST) == 240


def test_odd_rows(spark):
    rnd = np.random.default_rng(1)
    one, other = units(rnd, 2)
    near = beside(rnd, one[None], 0.97)[0]
    odd = [None, [], [0.0] * 64, [float("nan"), *[1.0] * 63], [float("inf")] * 64, [None, *[1.0] * 63], [1.0, 2.0], (one * 5).tolist()]
    vectors = [one.tolist(), one.tolist(), near.tolist(), other.tolist(), (-one).tolist(), *odd, one.tolist(), one.tolist()]
    ids = [7, 3, 5, 9, 2, *range(20, 28), None, 3]
    rows = [(i, v, 1, "clash", 1) for i, v in zip(ids, vectors)]
    found = [tuple(r) for r in lattice.near_duplicates(table(spark, rows)).collect()]
    clean = [v if v is None or all(x is not None for x in v) else None for v in vectors]
    assert order(found) == order(brute(ids, clean))
    assert lattice.near_duplicates(table(spark, [])).collect() == []
    texts = table(spark, [(str(i), v, 1, "x", 1) for i, v in zip(ids[:4], vectors[:4])], "string")
    assert {r.vec_id: r.component_id for r in lattice.near_duplicates(texts).collect()} == {"7": "3", "3": "3", "5": "3", "9": "9"}


@pytest.mark.parametrize("most", [1_024, 40])
def test_groups_and_counts(spark, most):
    """A group of near copies of one vector, chains and loose vectors; cells whole and in parts."""
    rnd = np.random.default_rng(2)
    centre = units(rnd, 1)
    vectors = np.concatenate([beside(rnd, np.repeat(centre, 150, 0), 0.985), units(rnd, 100), centre, centre])
    ids = rnd.permutation(len(vectors)).tolist()
    rows = [(i, v.tolist(), 1, "x", 1) for i, v in zip(ids, vectors)]
    found = sorted(tuple(r) for r in lattice.near_duplicates(table(spark, rows), most=most).collect())
    wanted = sorted(brute(ids, vectors))
    assert [row[2:] for row in found] == [row[2:] for row in wanted]
    assert all(got[1] <= want[1] for got, want in zip(found, wanted))
    assert sum(row[1] for row in found) >= 0.98 * sum(row[1] for row in wanted)


def test_recall_at_the_limit(spark):
    """Pairs of a cosine just above the limit, the hardest there are."""
    rnd = np.random.default_rng(3)
    one = units(rnd, 1_500)
    vectors = np.concatenate([one, beside(rnd, one, 0.951)])
    rows = [(i, v.tolist(), 1, "x", 1) for i, v in enumerate(vectors)]
    found = lattice.near_duplicates(table(spark, rows)).collect()
    wanted = brute(list(range(len(vectors))), vectors)
    assert sum(r.n_links for r in found) / sum(row[1] for row in wanted) >= 0.95


def test_query(spark):
    found = sorted(tuple(r) for r in op13_embedding_near_dedup(spark, "/root/testdata/sf0.001").collect())
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    assert found == sorted(brute([r.vec_id for r in rows], [r.embedding for r in rows]))
