import hashlib
import random

import numpy as np
import pytest

from tellstone.llm import names, recompression, shared


def brute(docs, n):
    seen = {}
    key = lambda i: recompression.LAST if i is None else i
    split = [(key(i), (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - n + 1):
            s = tuple(w[k : k + n])
            seen[s] = min(seen.get(s, i), i)
    out = []
    for (i, w), (raw, _) in zip(split, docs, strict=True):
        gone = {p for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] < i for p in range(k, k + n)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((raw, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def cases(seed, letters):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(letters) + rng.choice([" ", "\n", " \t", "\x0b", "\x0c\r"]) for _ in range(n))
    base = [text(rng.randrange(120)) for _ in range(12)]
    docs = []
    for k in range(40):
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        docs.append((rng.choice([k, k, 5, None]), a[i : i + rng.randrange(200)] + " " + b[j:] + text(rng.randrange(20))))
    docs += [(60, None), (61, ""), (62, " \n"), (63, "a " * 400), (64, "a " * 200), (64, "a " * 200), (2, docs[0][1]), (70, " a  b\x85c\x1cd"), (-5, base[0])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,letters,n,rounds", [(1, "ab", 13, 1), (2, "abcdefgh", 13, 1), (3, [f"w{i}" for i in range(60)], 13, 1), (4, "aaab", 5, 2), (5, "abc", 20, 2)])
def test_brute(spark, monkeypatch, seed, letters, n, rounds):
    docs = cases(seed, letters)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string").repartition(5)
    got = recompression.repeats(df, n, rounds, bits=12).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(docs, n)))


def test_text_changes_only_where_removed(spark):
    docs = cases(7, "abcdef")
    df = spark.createDataFrame([(i, t, str(k)) for k, (i, t) in enumerate(docs)], "doc_id long, text string, places string")
    got = {int(r.places): r.text for r in recompression.without_repeats(df).collect()}
    for k, ((_, text), (_, total, gone, digest)) in enumerate(zip(docs, brute(docs, 13), strict=True)):
        if gone:
            assert hashlib.sha256(got[k].encode()).hexdigest() == digest
        else:
            assert got[k] == text


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(1)
    words = names.mix(rng.integers(0, 3, 5000).astype(np.uint64))
    for rounds in (1, 2, 3):
        start, keys = recompression.window_keys(words, np.zeros(5000, int), 13, rounds)
        seen = {}
        for i, k in zip(start.tolist(), keys.tolist(), strict=True):
            assert seen.setdefault(words[i : i + 13].tobytes(), k) == k


def test_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(recompression, "CHUNK", 300)
    docs = cases(9, "abcd")
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert sorted(map(repr, map(tuple, recompression.repeats(df).collect()))) == sorted(map(repr, brute(docs, 13)))


def test_filter_passes_what_is_shared():
    table = np.zeros((4, 64), np.uint8)
    assert not shared.passes(table, names.mix(np.arange(100, dtype=np.uint64))).any()
    assert shared.passes(~table, names.mix(np.arange(100, dtype=np.uint64))).all()


def test_empty_table(spark):
    assert recompression.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_of_equal_sums(spark):
    """Words that agree in any polynomial sum modulo 2^64 are different words, and windows of them different windows."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{rest} {other}"), (4, f"{one} {rest}")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = recompression.repeats(df).collect()
    assert sorted(map(tuple, got)) == brute(docs, 13)
    assert [r.n_removed for r in sorted(got)] == [0, 0, 0, 13]


def test_names_decide_nothing(spark, monkeypatch):
    """Where all words have one name, and so all windows one key, results are the same."""
    real = recompression.words
    monkeypatch.setattr(recompression, "words", lambda d, o: (real(d, o)[0] * np.uint64(0), *real(d, o)[1:]))
    docs = cases(11, "abcdef")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert sorted(map(repr, map(tuple, recompression.repeats(df).collect()))) == sorted(map(repr, brute(docs, 13)))


def test_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = [(1, text, "a", "b", "c", "d"), (2, text, "e", "f", "g", "h"), (3, "x", "i", "j", "k", "l")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _id string, hash string, places string, _places string")
    assert sorted(tuple(r) for r in recompression.without_repeats(df).collect()) == [docs[0], (2, "", *docs[1][2:]), docs[2]]


def test_long_texts(spark):
    """A text of 300,000 words, one word of a megabyte, and copies of both."""
    long = " ".join(str(i) for i in range(300_000))
    df = spark.createDataFrame([(1, long), (2, "z" * 1_000_000), (3, long + " end"), (4, "z" * 1_000_000)], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in recompression.repeats(df).collect()) == [(1, 300_000, 0), (2, 1, 0), (3, 300_001, 300_000), (4, 1, 0)]
