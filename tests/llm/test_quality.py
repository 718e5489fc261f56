import pytest
import random

import numpy as np
from pyspark.sql import functions as F

from tellstone.llm import quality


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "ptkbd" for b in "aeiou" for c in ("n", "st", "rel", "mik")]
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        low, toxic = rng.random() < 0.2, rng.random() < 0.15
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zotbad", "zotevil", "grim"])
        if low:
            w = [x.upper() + "!!" for x in w]
        docs.append((k, " ".join(w), f"h{k % 7}" if k % 11 else None, "en" if k % 2 else None))
        labels.append((k, int(not low), int(toxic)))
    return docs, labels


DOCS = "doc_id long, text string, source string, lang string, p_low string"


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    extra = [(None, docs[0][1], None, None), (900, None, "h1", "en"), (901, "", "new", "xx"), (0, docs[0][1], docs[0][2], docs[0][3])]
    df = spark.createDataFrame([(*d, "x") for d in docs + extra], DOCS)
    shown = [x for x in labels if x[0] % 2] + [(1, 1, 0), (None, 0, 0), (5, None, 1), (7, 0, None)]
    got = quality.classify(df, spark.createDataFrame(shown, "doc_id long, quality int, toxic int"), F.col("source"), F.col("lang")).collect()
    assert len(got) == len(docs) + len(extra)
    bad = {i: q == 0 or t == 1 for i, q, t in labels}
    hidden = [(bad[r.doc_id], not r.kept) for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 2 == 0]
    assert np.mean([a == b for a, b in hidden]) > 0.97
    assert all(0 <= r.posterior <= 1 and 0 < r.host_rate < 1 for r in got)
    kept = quality.keep(df, spark.createDataFrame(shown, "doc_id long, quality int, toxic int"), F.col("source"), F.col("lang"))
    assert kept.columns == df.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in got if r.kept)


def test_shrinkage(spark):
    rows = [("a", "x", 0.9, 0.0)] * 50 + [("a", "y", 0.1, 0.0)] * 50 + [("b", "x", 0.05, 0.0)] * 200 + [("c", "z", 0.9, 0.0)]
    found = spark.createDataFrame([(k, k, *r) for k, r in enumerate(rows)], "doc_id long, text_hash long, host string, path string, p_low double, p_toxic double")
    got = {(r.host, r.path): r for r in quality.posteriors(found).collect()}
    mean = sum(r[2] for r in rows) / len(rows)
    assert got["b", "x"].path_rate < got["a", "y"].path_rate < got["a", "x"].path_rate
    # A site of one row knows nothing beside that row, which doesn't judge itself.
    assert got["c", "z"].host_rate == pytest.approx(mean) and got["c", "z"].path_rate == pytest.approx(mean)
    assert got["a", "x"].posterior > 0.9 and got["a", "x"].path_rate > got["a", "x"].host_rate
    assert 0.9 > got["c", "z"].path_rate


def test_no_labels_and_empty_tables(spark):
    docs, labels = corpus(30)
    df = spark.createDataFrame([(*d, "x") for d in docs], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(df, none, F.col("source"), F.col("lang")).filter("kept").count() == 30
    good = spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    assert quality.classify(df, good, F.col("source"), F.col("lang")).filter("kept").count() == 30
    assert quality.classify(spark.createDataFrame([], DOCS), good, F.col("source"), F.col("lang")).count() == 0


def test_many_toxic_words(spark):
    """Of 120 toxic words none is lost: each is in the lexicon, and a text with it alone is rejected."""
    rng = random.Random(4)
    vocabulary = [a + b + c for a in "ptkbd" for b in "aeiou" for c in ("n", "st", "rel", "mik")]
    toxic = [f"{a}{b}{c}{d}zz" for a in "vwxz" for b in "aeiou" for c in "qf" for d in "klm"]
    docs, labels = [], []
    for k in range(6000):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))]
        if k % 5 == 0:
            w[rng.randrange(len(w))] = toxic[k // 5 % len(toxic)]
        docs.append((k, " ".join(w)))
        labels.append((k, 1, int(k % 5 == 0)))
    new = [(10_000 + k, " ".join([rng.choice(vocabulary) for _ in range(40)] + [w])) for k, w in enumerate(toxic)]
    df = spark.createDataFrame(docs + new, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert set(toxic) <= set(quality.fit(df, known).lexicons[1])
    kept = quality.classify(df, known, F.lit("h"), F.lit("p")).filter("doc_id >= 10000 and kept").count()
    assert len(toxic) > 100 and kept == 0


def test_posterior_by_hand(spark):
    """Rates, strengths and posteriors in plain Python."""
    rows = [("a", "x", 0.9, 0.1)] * 20 + [("a", "y", 0.1, 0.0)] * 15 + [("b", "x", 0.05, 0.2)] * 40 + [("b", "y", 0.4, 0.0)] * 3 + [("c", "z", 0.7, 0.0)] * 2
    found = spark.createDataFrame([(k, k, *r) for k, r in enumerate(rows)], "doc_id long, text_hash long, host string, path string, p_low double, p_toxic double")
    bad = [1 - (1 - r[2]) * (1 - r[3]) for r in rows]
    mean = sum(bad) / len(bad)

    def totals(key):
        out = {}
        for r, x in zip(rows, bad, strict=True):
            n, b = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, b + x)
        return out

    def strength(groups, around):
        n = sum(g[0] for g in groups.values())
        inside = {k: around(k) * (1 - around(k)) for k in groups}
        spread = sum(g[0] * (g[1] / g[0] - around(k)) ** 2 for k, g in groups.items()) / n - sum(inside.values()) / n
        return min(1e6, max(1.0, sum(g[0] * inside[k] for k, g in groups.items()) / n / max(spread, 1e-9) - 1))

    hosts, paths = totals(lambda r: r[0]), totals(lambda r: r[:2])
    k1 = strength(hosts, lambda k: mean)
    k2 = strength(paths, lambda k: (hosts[k[0]][1] + k1 * mean) / (hosts[k[0]][0] + k1))
    for got in quality.posteriors(found).collect():
        x, (hn, hb), (pn, pb) = bad[got.doc_id], hosts[got.host], paths[got.host, got.path]
        host = (hb - x + k1 * mean) / (hn - 1 + k1)
        path = (pb - x + k2 * host) / (pn - 1 + k2)
        odds = x / (1 - x) * path / (1 - path) / (mean / (1 - mean))
        assert (got.host_rate, got.path_rate, got.posterior) == pytest.approx((host, path, odds / (1 + odds)))


def test_columns_of_any_name(spark):
    """keep() returns the user's columns, whatever they are called."""
    docs = [(k, "good words here " * 9, 1, 2, "h", "p", "r", "src") for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _id long, _hash long, _host string, path string, row string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F
    assert sorted(tuple(r) for r in quality.keep(df, labels, F.col("source"), F.lit(None)).collect()) == docs
