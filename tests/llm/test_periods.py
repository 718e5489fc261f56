import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from tellstone.llm import periods, queries


def lyndon(s):
    return [max(n for n in range(1, len(s) - i + 1) if all(s[i : i + n] < s[k : i + n] for k in range(i + 1, i + n))) for i in range(len(s))]


def runs(w, least=12):
    """start, length and period of all runs, by trying each period."""
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j + p - i
            if j > i and size >= max(least, 2 * p) and not any(all(w[x] == w[x + q] for x in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts(rng):
    out = []
    for _ in range(60):
        n, k = rng.randrange(80), rng.choice([1, 2, 3, 9])
        w = [rng.choice("abcdefghi"[:k]) for _ in range(n)]
        p, a = rng.randrange(1, 20), rng.randrange(n + 1)
        w = w[:a] + (w[a : a + p] * 80)[: n - a] if rng.random() < 0.6 else w
        out.append(rng.choice(["", " ", "\t\n"]) + rng.choice([" ", "  ", "\v", "\n"]).join(w))
    return out


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 2, 4])) for _ in range(rng.randrange(1, 25))]
        s = (s[:5] * 9)[: len(s)] if rng.random() < 0.3 else s
        for order in (s, [3 - x for x in s]):
            assert periods.lyndon(np.array([-1, *order, -1, *s, -1])).tolist() == [0, *lyndon(order), 0, *lyndon(s), 0]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_words(least):
    rng = random.Random(least)
    docs = [t.split() for t in texts(rng)]
    codes, owner = np.array([ord(x) for d in docs for x in d]), np.repeat(np.arange(len(docs)), list(map(len, docs)))
    found, first = [], 0
    for d in docs:
        found += [(first + a, first + a + n, p) for a, n, p in runs(d, least)]
        first += len(d)
    assert [tuple(x) for x in periods.runs_of(codes, owner, least).tolist()] == found


def collapse(w, found):
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_any_columns(spark):
    values = [None, "", " \n", "one", "x " * 12, "x " * 11, "é ü " * 7, "a b a b", *texts(random.Random(5))]
    rows = [(i % 7 if i % 5 else None, "n", t, "r", 1) for i, t in enumerate([*values, *values[:6]])]
    docs = spark.createDataFrame(rows, "doc_id long, collapsed string, text string, Runs string, text_ int").repartition(3)
    got = periods.collapsed(docs).collect()
    expect = [(r[0], 1, len(words(r[2])), runs(words(r[2])), collapse(words(r[2]), runs(words(r[2])))) for r in rows]
    assert sorted(repr((r.doc_id, r.text_, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in got) == sorted(map(repr, expect))
    assert periods.collapsed(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    """Texts of over 1 MB: one word again and again, the same between other words, and the words of Fibonacci and Thue and Morse."""
    a, b = ["x"], ["x", "y"]
    while len(b) < 200_000:
        a, b = b, b + a
    plain = [str(i) for i in range(200_000)]
    thue = [str(i.bit_count() % 2) for i in range(300_000)]
    rows = [(1, "word " * 300_000), (2, " ".join([*plain[:100_000], *["word"] * 100_000, *plain[100_000:]])), (3, " ".join(b)), (4, " ".join(thue)), (5, "y" * 3_000_000)]
    got = {r.doc_id: r for r in periods.collapsed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 300_000, 1)] and got[1].collapsed == "word"
    assert [tuple(x) for x in got[2].runs] == [(100_000, 100_000, 1)] and len(got[2].collapsed.split()) == 200_001
    # Runs of this word have Fibonacci numbers as periods and an exponent under 3.62.
    assert all(2 <= r.length / r.period < 3.62 for r in got[3].runs) and len({r.period for r in got[3].runs}) < 26
    # This word has no overlaps, so all its runs are squares.
    assert got[4].runs and all(r.length == 2 * r.period for r in got[4].runs)
    assert got[5].runs == [] and got[5].collapsed == "y" * 3_000_000


def planted(doc_id, text):
    w, h = words(text), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(texts(rng) + [" ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randrange(300))) for _ in range(200)])]
    rows += [(None, "x " * 30), (None, None), (5, "y " * 13), *[(i, None) for i in range(40)], *[(i, " ") for i in range(40)]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(os.fspath(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, os.fspath(tmp_path)).collect()
    expect = []
    for doc_id, text in rows:
        w = planted(doc_id, text)
        found = runs(w)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{n},{p}\n" for a, n, p in found), collapse(w, found))]
        expect.append((doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], *digests, len(w)))
    assert sum(r[1] > 0 for r in expect) > 30
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expect))
