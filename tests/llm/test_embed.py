import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import embed
from dossier.llm.embed import linked_pairs, near_vectors


def plain(rows, threshold=0.98):
    ok = [i for i, (v, x, l) in enumerate(rows) if v is not None and l is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    links, root = {i: set() for i in range(len(rows))}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ok):
        for j in ok[:n]:
            a, b = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (i, j))
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                links[i].add(j), links[j].add(i)
                x, y = find(i), find(j)
                root[max(x, y, key=lambda k: rows[k][0])] = min(x, y, key=lambda k: rows[k][0])
    out = []
    for i, (v, _, _) in enumerate(rows):
        c = rows[find(i)][0]
        out.append((v, len(links[i]), c, v is not None and v == c))
    return sorted(out, key=str)


def test_linked_pairs_drops_none():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 40)) * np.linspace(3, 0.05, 40)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = linked_pairs(u, u, x, x, 0.9)
    want = np.nonzero(u @ u.T >= 0.9)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, want)))


@pytest.mark.parametrize("numbers", [100, 1 << 19])
def test_matches_brute_force(spark, monkeypatch, numbers):
    monkeypatch.setattr(embed, "TILE_NUMBERS", numbers)
    monkeypatch.setattr(embed, "SLABS", 4)
    monkeypatch.setattr(embed, "PAIRS", 50)
    r = np.random.default_rng(2)
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(5):
            centre = r.normal(size=12)
            for _ in range(18):
                rows.append((n * 7 % 1009, (centre + r.normal(size=12) * 0.16).tolist(), label))
                n += 1
    rows += [(2000 + k, rows[3][1], rows[3][2]) for k in range(4)]
    rows += [(3000, None, 1), (3001, [0.0] * 12, 1), (3002, [float("nan")] * 12, 1), (3003, [1.0, None], 1), (3004, rows[0][1], None), (3005, [], 1), (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1), (3008, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, label int, rep int")
    got = sorted((tuple(x) for x in near_vectors(df).collect()), key=str)
    assert got == plain(rows)


def test_empty_and_without_id(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, near_vectors(df).collect()), key=str) == [(4, 0, 4, True), (None, 0, None, False)]
    assert near_vectors(df.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    rows = [("b", [1.0, 0.1], 1), ("a", [1.0, 0.1], 1), ("c", [1.0, 0.11], 1), ("d", [0.0, 1.0], 1), ("e", None, 1)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int")
    assert sorted(map(tuple, near_vectors(df).collect())) == [("a", 2, "a", True), ("b", 2, "a", False), ("c", 2, "a", False), ("d", 0, "d", True), ("e", 0, "e", True)]


def test_tiny_and_huge_components(spark):
    """Squares that under- or overflow: parallel vectors link, others don't, whatever their lengths."""
    vectors = [[1e-200, 0.0, 0.0], [3e-200, 1e-203, 0.0], [1e200, 1e200, 0.0], [2e200, 2e200, 0.0], [5e-324, 0.0, 0.0], [1e308, -1e308, 1e308], [-1.0, 1.0, -1.0], [1.0, -1.0, 1.0], [1e-200, 1e200, 0.0]]
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(x) for x in near_vectors(df).collect())
    assert [x[:3] for x in got] == [(0, 2, 0), (1, 2, 0), (2, 1, 2), (3, 1, 2), (4, 2, 0), (5, 1, 5), (6, 0, 6), (7, 1, 5), (8, 0, 8)]


@pytest.mark.parametrize("width", [384, 1024])
def test_wide_vectors_in_pca_order(spark, width, monkeypatch):
    monkeypatch.setattr(embed, "TILE_NUMBERS", 40 * width)
    r = np.random.default_rng(width)
    axes = r.normal(size=(6, width))
    rows = []
    for i in range(150):
        base = axes[i % 6] if i < 100 else r.normal(size=6) @ axes
        rows.append((i, (base + r.normal(size=width) * r.choice([0.02, 0.14])).tolist(), i % 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    basis = embed.bases(df.select(F.size("embedding").alias("dim"), F.col("embedding").alias("vec")))[width]
    assert basis.shape == (width, embed.LEADING) and np.allclose(basis.T @ basis, np.eye(embed.LEADING), atol=1e-9)
    u = embed.unit(np.array([x[1] for x in rows]))
    best = np.sort(np.linalg.eigvalsh(u.T @ u))[::-1][:6].sum()
    assert ((u @ basis[:, :6]) ** 2).sum() > 0.98 * best
    assert np.allclose(embed.turned(u, basis) @ embed.turned(u, basis).T, u @ u.T, atol=1e-9)
    assert sorted((tuple(x) for x in near_vectors(df).collect()), key=str) == plain(rows)
