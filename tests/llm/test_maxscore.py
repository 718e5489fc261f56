import numpy as np
import pytest
from pyspark.sql import functions as F

from tellstone.llm import maxscore

TOP = 2**63 - 1


def brute(rows, k, every):
    out = []
    for i, (query, a) in enumerate(rows):
        if query is None or query % every or a is None or None in a:
            continue
        found = []
        for j, (vec_id, b) in enumerate(rows):
            if i != j and b is not None and None not in b and len(a) == len(b):
                score = max(-TOP - 1, min(TOP, sum(x * y for x, y in zip(a, b, strict=True))))
                found.append((-score, vec_id is None, vec_id or 0, vec_id))
        out += [(query, rank + 1, r[3], -r[0]) for rank, r in enumerate(sorted(found)[:k])]
    return out


def cases(seed, n=300, size=24):
    rng = np.random.default_rng(seed)
    rows = [(i, np.floor(9 * rng.standard_normal(size)).astype(int).tolist()) for i in range(n)]
    rows += [(i + 1000, rows[i][1]) for i in range(20)] + rows[:7]
    rows += [(500 + i, [0] * size) for i in range(6)] + [(None, rows[3][1]), (None, rows[4][1]), (520, None), (525, [None] * size)]
    rows += [(530, [1, 2]), (535, [3, -1]), (540, []), (545, []), (-5, rows[9][1])]
    return rows


@pytest.mark.parametrize("block,shard,first,probe", [(2048, 1 << 20, 512, 12), (7, 50, 30, 2), (1, 1, 1, 1)])
def test_brute(spark, monkeypatch, block, shard, first, probe):
    monkeypatch.setattr(maxscore, "FIRST", first)
    monkeypatch.setattr(maxscore, "PROBE", probe)
    rows = cases(1, 60 if block == 1 else 300)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, vector array<long>, node string, cell int").repartition(3)
    got = maxscore.top_k(df, F.col("vec_id") % 5 == 0, 4, block, shard).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, 4, 5)))


def test_large_components(spark):
    """Sums beyond what doubles hold are exact, and those beyond longs are the ends of their range."""
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(-(2**bits), 2**bits, 5)]) for bits in (12, 27, 31, 62) for i in range(bits * 100, bits * 100 + 15)]
    rows += [(1, [TOP] * 5), (2, [-TOP - 1] * 5), (3, [2**53 + 1, 1, 0, 0, 0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = maxscore.top_k(df, F.col("vec_id") % 3 == 0, 10).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 10, 3))


def test_quantized(spark):
    df = spark.createDataFrame([([0.0, -0.001, 1.0, 0.3, 1e30],)], "v array<float>")
    assert df.select(maxscore.quantized(F.col("v"))).first()[0] == [0, -1, 64, 19, TOP]


def test_terms_are_left_out():
    """A third of the components is never read, also where no vector stands out, and results stay those of a whole product."""
    rng = np.random.default_rng(4)
    vectors = np.floor(64 * (v := rng.standard_normal((20_000, 64))) / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            read.append(np.size(out))
            return out

    ids = np.arange(len(vectors))
    searcher = maxscore.Searcher(ids[:50], ids[:50], vectors[:50], 20)
    for a in range(0, len(ids), 5000):
        batch = vectors[a : a + 5000].T.copy().view(Counted)
        searcher.add(ids[a : a + 5000], ids[a : a + 5000], np.ones(5000, bool), batch)
    assert sum(read) < 0.67 * 50 * vectors.size
    score = vectors[:50] @ vectors.T
    for q in range(50):
        order = [i for i in np.lexsort((ids, -score[q])) if i != q][:20]
        assert searcher.best[q][1].tolist() == order and searcher.best[q][0].tolist() == score[q][order].tolist()


def test_empty_table(spark):
    assert maxscore.top_k(spark.createDataFrame([], "vec_id long, vector array<long>"), F.col("vec_id") % 20 == 0).count() == 0
