import hashlib
import random
import re

import pytest

from tellstone.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, n):
    grams = {}
    for item, text in bench:
        w = words(text)
        for k in range(len(w) - min(n, len(w)) + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if found := grams.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    items |= found
        ids = ",".join(sorted(map(str, items)))
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "É", "é", "ß", "z9", "İ", "日本", "K"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "'"]) for _ in range(n))
    docs = [(rng.choice([None, 1, 2, k]), text(rng.randrange(60))) for k in range(30)] + [(70, None), (71, ""), (72, "!!"), (73, text(3000)), (73, "other"), (74, "x"), (74, "x")]
    bench = [(k, text(rng.randrange(14))) for k in range(8)] + [(20, None), (21, ""), (22, "X"), (5, text(12)), (30, docs[3][1])]
    return docs, bench


@pytest.mark.parametrize("seed,limit,most", [(1, 0, 0), (2, 1 << 24, 50_000), (4, 0, 50_000)])
def test_brute(spark, seed, limit, most):
    docs, bench = cases(seed)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for n in (10, 3):
        got = decontaminate.scan(d, b, n, limit, most).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(docs, bench, n)))


def test_clean(spark):
    docs, bench = cases(3)
    bench = bench[:3]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    verdict = brute(docs, bench, 4)
    kept = [tuple(r) for r in decontaminate.clean(d, b, n=4).collect()]
    assert sorted(map(repr, kept)) == sorted(repr((i, t, "x")) for (i, t), v in zip(docs, verdict, strict=True) if not v[5])
    cut = decontaminate.clean(d, b, "spans", n=4).collect()
    assert len(cut) == len(docs)
    assert sorted(len(words(r.text)) for r in cut) == sorted(v[1] - v[2] for v in verdict)
    untouched = sorted(repr((i, t)) for (i, t), v in zip(docs, verdict, strict=True) if not v[5])
    assert not set(untouched) - {repr((r.doc_id, r.text)) for r in cut}


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.scan(d, b).count() == 0
    assert [tuple(r)[:4] for r in decontaminate.scan(one, b).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.clean(one, b).count() == 1


def test_names_of_the_operator(spark):
    """Columns that have names of the operator's own are the user's, before and after."""
    docs = [(1, "a b c d", 7, 8, "r", "h"), (2, "x y", 9, 10, "s", "i")]
    d = spark.createDataFrame(docs, "doc_id long, text string, _id long, text_hash long, row string, id string")
    b = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.clean(d, b).collect()] == docs[1:]
    assert sorted(tuple(r) for r in decontaminate.clean(d, b, "spans").collect()) == [(1, "a d", 7, 8, "r", "h"), docs[1]]
    assert sorted(tuple(r)[:3] for r in decontaminate.scan(d, b).collect()) == [(1, 4, 2), (2, 2, 0)]


def test_long_text(spark):
    """A text of 300,000 words whose every word is hit, and an item with a word of a megabyte."""
    d = spark.createDataFrame([(1, "a " * 300_000), (2, "z" * 1_000_000)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a " * 10), (2, "z" * 1_000_000)], "item_id long, text string")
    assert sorted(tuple(r)[:4] for r in decontaminate.scan(d, b, limit=1 << 20).collect()) == [(1, 300_000, 300_000, 1), (2, 1, 1, 1)]
    assert sorted(r.text for r in decontaminate.clean(d, b, "spans").collect()) == ["", ""]


def test_many_windows(spark):
    """With 200,000 windows, hardly anything but hits becomes a string; with a full filter results are the same."""
    rng = random.Random(6)
    bench = [(k, " ".join(f"b{rng.randrange(3000)}" for _ in range(409))) for k in range(500)]
    docs = [(k, " ".join(f"b{rng.randrange(3000)}" for _ in range(1000))) for k in range(100)] + [(1000 + k, bench[k][1]) for k in range(3)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    grams = decontaminate.windows(b, 10)
    assert grams.count() == 200_000
    assert 1200 <= decontaminate._scanned(d, grams, decontaminate.SLOTS).filter("size > 0").count() < 1200 + 0.005 * 100_000
    for slots in (1, decontaminate.SLOTS):
        got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.scan(d, b, slots=slots).collect()}
        assert {k: v for k, v in got.items() if v != (0, 0)} == {1000 + k: (409, 1) for k in range(3)}
