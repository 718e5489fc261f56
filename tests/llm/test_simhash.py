import random

import numpy as np
import pytest
import xxhash

from tellstone.llm import scratch, simhash
from tellstone.llm.components import components


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [w[i : i + 4] for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def expected(ids, prints, distance):
    n = len(ids)
    root = union(n, [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance])
    least = {}
    for i, r in zip(ids, root, strict=True):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return [(i, f"{p:016x}", least[r]) for i, p, r in zip(ids, prints, root, strict=True)]


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"Wörd{k}" for k in range(200)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 400))] for _ in range(25)]
    out = []
    for _ in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "x"
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    return out + [None, "", " \n", "one", "one two three", "ONE two three", "a b c d", "É é", "é é", out[0], "a b " * 300]


def test_brute(spark):
    docs = [(k if k % 7 else None if k % 2 else 5, t) for k, t in enumerate(texts(1))]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fingerprint string").repartition(3)
    got = simhash.near_duplicates(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected([i for i, _ in docs], [fingerprint(t) for _, t in docs], 4)))


@pytest.mark.parametrize("distance,tile,limit", [(4, 512, 1 << 24), (4, 3, 0), (0, 512, 1 << 24), (3, 5, 1 << 24)])
def test_links(spark, monkeypatch, distance, tile, limit):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    prints = np.repeat(base, 12)
    for _ in range(4):
        prints = prints ^ np.where(rng.random(len(prints)) < 0.6, np.uint64(1) << rng.integers(0, 64, len(prints)).astype(np.uint64), np.uint64(0))
    masks, owner = simhash.grid(distance)
    distinct = np.unique(prints)
    monkeypatch.setattr(simhash, "TILE", tile)
    pairs = [p for t, m in enumerate(masks) for p in simhash.cell_links(distinct, t, m, owner, distance)]
    a, b = (np.concatenate([p[i] for p in pairs] or [distinct[:0]]) for i in (0, 1))
    brute = [(i, j) for i in range(len(distinct)) for j in range(i) if int(distinct[i] ^ distinct[j]).bit_count() <= distance]
    index = {int(x): k for k, x in enumerate(distinct)}
    assert union(len(distinct), brute) == union(len(distinct), [(index[int(x)], index[int(y)]) for x, y in zip(a, b, strict=True)])
    if tile > 100:
        assert len(a) == len(brute)
    monkeypatch.setattr(scratch.joined, "__defaults__", (None, limit, 3 if not limit else scratch.PART))
    ids = list(range(len(prints)))
    df = spark.createDataFrame([(i, 0, int(np.int64(p.view(np.int64)))) for i, p in zip(ids, prints, strict=True)], "doc_id long, text_hash long, fingerprint long")
    got = [(r.doc_id, f"{r.fingerprint & (1 << 64) - 1:016x}", r.component_id) for r in simhash.with_components(df, distance).collect()]
    assert sorted(got) == sorted(expected(ids, [int(p) for p in prints], distance))


def test_one_of_each(spark):
    docs = [(k if k % 7 else None if k % 2 else 5, t) for k, t in enumerate(texts(2))]
    docs += docs[:4] + [(8, None), (None, "only here"), (None, "only here")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string")
    kept = simhash.one_of_each(df).collect()
    want = expected([i for i, _ in docs], [fingerprint(t) for _, t in docs], 4)
    groups = {(c, f if c is None else "") for _, f, c in want}
    assert len(kept) == len(groups)
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(ids) == sorted({c for _, _, c in want if c is not None})
    assert {(r.doc_id, r.text) for r in kept} <= set(docs)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + k) for k in range(50)] + [(2000 + k, 2001 + k) for k in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = union(2100, pairs)
    assert got == {x: root[x] for p in pairs if p[0] != p[1] for x in p}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_large_cells(monkeypatch, seed):
    """Pivots and tiles give the components of all pairs, for near copies of a few texts and for others."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    prints = np.concatenate([centre, rng.integers(0, 1 << 63, 40).astype(np.uint64)])
    for _ in range(300):
        flips = rng.choice(64, rng.integers(1, 4), replace=False).astype(np.uint64)
        prints = np.append(prints, prints[rng.integers(len(prints))] ^ np.bitwise_or.reduce(np.uint64(1) << flips))
    prints = np.unique(prints)
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    want = simhash.roots(len(prints), a, b)
    index = {int(x): i for i, x in enumerate(prints)}
    got = list(simhash.large_cell_links(prints, 4))
    x, y = ([index[int(v)] for part in got for v in part[k]] for k in (0, 1))
    assert simhash.roots(len(prints), np.array(x, int), np.array(y, int)).tolist() == want.tolist()


def test_columns_of_any_name(spark):
    docs = [(1, "a b c d e", 7, 8, "r"), (2, "a b c d e", 9, 10, "s"), (3, "x y", 11, 12, "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _id long, _hash long, row string")
    assert sorted(tuple(r) for r in simhash.one_of_each(df).collect()) == [docs[0], docs[2]]
