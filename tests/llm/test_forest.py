import numpy as np
import pytest

from tellstone.llm import forest


def brute(rows, threshold):
    n = len(rows)
    good = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and None not in r[1] and bool(np.isfinite(np.array(r[1], float)).all()) and any(r[1]) for r in rows]
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                link[i][j] = link[j][i] = bool(a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold)
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in range(n) if link[i][j])]) for i in range(n)]
        if new == root:
            break
        root = new
    least = {}
    for i, r in enumerate(root):
        least[r] = min([x for x in (least.get(r), rows[i][0]) if x is not None], default=None)
    return [(rows[i][0], sum(link[i]), least[root[i]], rows[i][0] == least[root[i]]) for i in range(n)]


def cases(seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((30, 16))
    rows = []
    for k in range(150):
        v = base[rng.integers(30)] + rng.standard_normal(16) * rng.choice([0, 0.02, 0.06, 0.1])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(rng.integers(2))))
    same = rows[0]
    rows += [(1000 + k, same[1], same[2]) for k in range(20)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] + [1.0] * 15, 1), (204, [None] + [1.0] * 15, 1)]
    rows += [(205, same[1], None), (206, [], 1), (207, [1.0, 2.0], 1), (208, [2.0, 4.0], 1), (None, same[1], same[2]), (3, rows[3][1], rows[3][2]), (210, [1e-30] * 16, 0), (211, [1e30] * 16, 0)]
    return rows


@pytest.mark.parametrize("leaf,tile", [(256, 2048), (10, 4)])
def test_brute(spark, monkeypatch, leaf, tile):
    monkeypatch.setattr(forest, "LEAF", leaf)
    monkeypatch.setattr(forest, "TILE", tile)
    rows = cases(1)
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, n int").repartition(3)
    got = forest.near_vectors(df, trees=6, spill=1.5).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, 0.98)))


def test_recall_of_a_forest():
    rng = np.random.default_rng(2)
    base = forest.unit(rng.standard_normal((4000, 64)))
    near = forest.unit(base + forest.unit(rng.standard_normal((4000, 64))) * 0.19)
    both = np.concatenate([base, near])
    trees = forest.plant(both, 1.0, 6, 7)
    assert min(t.leaves for t in trees) > 16
    met = np.zeros(4000, bool)
    for t in trees:
        row, leaf = t.route(both, 0.8 * 0.2 / 8)
        assert len(row) < 4 * len(both)
        pairs = {(int(r), int(x)) for r, x in zip(row, leaf, strict=True)}
        met |= np.array([any((i + 4000, x) in pairs for x in leaf[row == i].tolist()) for i in range(0, 4000, 40)]).repeat(40)
    assert met.mean() > 0.99


def test_empty_table(spark):
    assert forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_recall_of_the_operator(spark):
    """20,000 vectors of one label with 5,000 planted pairs just above the threshold, under production parameters."""
    rng = np.random.default_rng(5)
    base = forest.unit(rng.standard_normal((10_000, 64)))
    aside = rng.standard_normal((5_000, 64))
    aside = forest.unit(aside - (aside * base[:5000]).sum(axis=1, keepdims=True) * base[:5000])
    cosine = rng.uniform(0.9802, 0.985, (5_000, 1))
    near = cosine * base[:5000] + np.sqrt(1 - cosine**2) * aside
    rows = np.concatenate([base, near])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int").repartition(4)
    linked = {r.vec_id: r.component_id for r in forest.near_vectors(df).filter("n_links > 0").collect()}
    exact = [(a, b) for k in range(0, len(rows), 1000) for a, b in zip(*np.nonzero(rows[k : k + 1000] @ rows.T >= 0.98), strict=True) for a in [a + k] if a < b]
    assert len(exact) >= 5_000
    found = sum(linked.get(a) is not None and linked.get(a) == linked.get(b) for a, b in exact)
    assert found >= 0.999 * len(exact)
    assert set(linked) <= {int(x) for pair in exact for x in pair}
