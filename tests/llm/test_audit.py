import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellstone.llm import audit, transducer


def texts(rng, n=80):
    alphabet = ["a", "b", "A", "Zz", "é", "日本", "🙂", "#", "%d", "\x00", "\x7f", " ", " ", " ", "\t", "\n", "\r\n", "long" * 30, "long" * 30 + "x"]
    return [None, "", " ", "\n\t", "x", " x", "x "] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(n)]


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(w), len(set(w)), len(text), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text))


def test_counts(spark):
    values = texts(random.Random(1))
    docs = spark.createDataFrame([(i // 2, t, "d", 7) for i, t in enumerate(values)], "doc_id long, text string, Digest string, text_ int").repartition(3)
    got = transducer.measured_texts(docs).collect()
    expect = [(i // 2, 7, *counts(t or ""), hashlib.sha256((t or "").encode()).digest()) for i, t in enumerate(values)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expect))
    assert transducer.measured_texts(docs.limit(0)).count() == 0


def test_words_of_one_hash(monkeypatch):
    """Words are told apart by their bytes where all have one place in the table."""
    monkeypatch.setattr(transducer, "mix", lambda x: np.zeros_like(x))
    values = [t or "" for t in texts(random.Random(2), 20)]
    data = np.frombuffer("".join(values).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in values)])
    got = transducer.counted(data, offsets, transducer.kinds())
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [counts(t) for t in values]


def test_very_long_texts(spark):
    rows = [(1, "word " * 400_000), (2, "Y" * 3_000_000), (3, " ".join(map(str, range(300_000))))]
    got = {r.doc_id: tuple(r)[1:6] for r in transducer.measured_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: counts(t) for i, t in rows}


def brute(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    facts = []
    for d, t, part in docs:
        w, u, c, up, s = counts(t or "")
        fails = {x for x, bad in zip("ABCDE", (w < 50, 100 * u < 65 * w, 100 * up > 5 * c, s > 0, d is not None and d > first[t or ""]), strict=True) if bad}
        facts.append((part or "", fails, any(i == d and q == 1 for i, q, _ in labels if i is not None), any(i == d and x == 1 for i, _, x in labels if i is not None)))
    out, total = [], Counter()
    for order in permutations("ABCDE"):
        for part in {f[0] for f in facts}:
            for k, x in enumerate(order):
                mine = [f for f in facts if f[0] == part]
                gone = [f for f in mine if x in f[1] and not f[1] & set(order[:k])]
                total[part, x] += len(gone)
                out.append((part, "".join(order), k + 1, sum(not f[1] & set(order[: k + 1]) for f in mine), len(gone), sum(x in f[1] and bool(f[1] & set(order[:k])) for f in mine), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)))
    return [(*r, total[r[0], r[1][r[2] - 1]]) for r in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute(spark, seed):
    rng = random.Random(seed)
    pool = texts(rng, 12) + [" ".join(rng.choice(["alpha", "beta", "gamma", "NEWS", "x1", str(rng.random())]) for _ in range(rng.randrange(40, 90))) for _ in range(12)]
    docs = [(rng.choice([None, *range(30)]), rng.choice(pool), rng.choice([None, "", "a", "b"])) for _ in range(60)]
    docs += docs[:5]
    labels = [(rng.choice([None, *range(30)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(40)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, n int, fails int").repartition(3)
    marks = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = audit.audit(df, marks, F.col("source")).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs, labels))


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels, F.col("source")).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    assert audit.audit(one, labels, F.col("source")).count() == 600
