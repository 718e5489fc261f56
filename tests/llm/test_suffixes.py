import hashlib
import random

import numpy as np
import pytest

from tellstone.llm import names, recompression, suffixes


def brute(docs, n):
    seen = {}
    key = lambda i: recompression.LAST if i is None else i
    split = [(key(i), (t or "").encode()) for i, t in docs]
    for i, b in split:
        for k in range(len(b) - n + 1):
            seen.setdefault(b[k : k + n], []).append((i, b, k))
    out = []
    for (i, b), (raw, _) in zip(split, docs, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if any(j < i or (j == i and c == b and m < k) for j, c, m in seen[b[k : k + n]]):
                gone[k : k + n] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((raw, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cases(seed, letters, size):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    base = [text(rng.randrange(size)) for _ in range(8)]
    docs = []
    for k in range(30):
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        docs.append((rng.choice([k, k, 5, None]), a[i : i + rng.randrange(size)] + text(rng.randrange(9)) + b[j:]))
    docs += [(60, None), (61, ""), (62, "é"), (63, "a" * size), (64, "ab" * size), (64, "ab" * size), (2, docs[0][1]), (65, "\x00" * size), (-5, base[0])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,letters,n,gram,size", [(1, "ab", 30, 8, 200), (2, "abcdefghé", 100, 32, 600), (3, "aaab", 100, 32, 500), (4, "a\x00", 20, 8, 120), (5, "xyz", 40, 40, 300)])
def test_brute(spark, seed, letters, n, gram, size):
    docs = cases(seed, letters, size)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_bytes string").repartition(5)
    got = suffixes.repeats(df, n, bits=12, gram=gram).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(docs, n)))


def test_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    docs = cases(9, "abcd", 300)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert sorted(map(repr, map(tuple, suffixes.repeats(df, 50, gram=16).collect()))) == sorted(map(repr, brute(docs, 50)))


@pytest.mark.parametrize("seed", range(6))
def test_deep_shallow_order(seed):
    rng = np.random.default_rng(seed)
    rows, columns = int(rng.integers(0, 300)), int(rng.integers(1, 14))
    chars = rng.integers(0, 2 + seed % 2, (rows, columns)).astype(np.uint64)
    chars[:, : columns // 2] = 7
    group = rng.integers(0, 5, rows).astype(np.uint64)
    order = suffixes.deep_shallow(chars, group)
    keys = [(int(group[i]), *chars[i].tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(rows)) and keys == sorted(keys)


def test_empty_table(spark):
    assert suffixes.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_both_phases_split():
    """Rows that differ early are parted by pivots, those that agree down to the shallow depth by tries."""
    rng = np.random.default_rng(1)
    chars = rng.integers(0, 4, (400, 9)).astype(np.uint64)
    chars[200:, :5] = 1
    splits = {"quicksort": 0, "tries": 0}
    order = suffixes.deep_shallow(chars, np.zeros(400, int), 4, splits)
    keys = [tuple(chars[i].tolist()) for i in order]
    assert keys == sorted(keys) and splits["quicksort"] > 100 and splits["tries"] > 100


def test_both_phases_decide(spark, monkeypatch):
    """The production call sorts what follows the gram: both phases part groups of suffixes of real texts."""
    splits, real = {"quicksort": 0, "tries": 0}, suffixes.deep_shallow
    monkeypatch.setattr(suffixes, "deep_shallow", lambda c, g: real(c, g, splits=splits))
    gram, tail = bytes(range(32)), [b"x" * 40 + bytes([k % 7]) * 28 if k % 2 else bytes([k]) * 68 for k in range(40)]
    context = np.frombuffer(b"".join(gram + t for t in tail), np.uint8)
    at = np.arange(40) * 100
    zero = np.zeros(40, np.int64)
    out = suffixes.repeated(zero, zero, zero, zero, np.arange(40), zero, context, at, 100, 69)
    assert out[:, 0].tolist() == [t in tail[:k] for k, t in enumerate(tail)]
    assert splits["quicksort"] > 10 and splits["tries"] > 3


def test_keys_decide_nothing():
    """Different grams with one name are different groups."""
    context = np.frombuffer(b"a" * 100 + b"b" * 32 + b"a" * 68 + b"a" * 100, np.uint8)
    zero = np.zeros(3, np.int64)
    out = suffixes.repeated(zero, zero, zero, zero, np.arange(3), zero, context, np.arange(3) * 100, 100, 69)
    assert out[:, 0].tolist() == [False, False, True]


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 150)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    docs = [(1, cases(5, "abcd", 900)[3][1] or "x"), (2, "ab" * 500), (3, "q" * 1000), (4, "".join(chr(97 + i * i % 26) for i in range(1500))), (5, "zz" + "".join(chr(97 + i * i % 26) for i in range(200, 1200)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    for text_size in (1, 1 << 19):
        monkeypatch.setattr(suffixes, "texts", lambda b, s=text_size: names.texts(b, s))
        assert sorted(map(repr, map(tuple, suffixes.repeats(df, 60, gram=16).collect()))) == sorted(map(repr, brute(docs, 60)))


def test_ten_megabytes_of_one_character(spark):
    df = spark.createDataFrame([(1, " " * 10_000_000), (2, " " * 200)], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in suffixes.repeats(df).collect()) == [(1, 10_000_000, 9_999_999, 1), (2, 200, 200, 1)]
