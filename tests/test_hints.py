import random

import pytest
from pyspark.sql import functions as F

from tellstone.operators import hints
from tellstone.plans import catalog


def brute(text, listed):
    low = None if text is None else text.strip(" ").lower()
    return next((k for _, h, k in sorted(listed, key=lambda x: (x[0], x[1] or "")) if low is not None and h is not None and h in low), None)


def cases(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé :-") for _ in range(rng.randrange(1, 9)))
    listed = [(i, word(), f"k{i}") for i in rng.sample(range(10 * n), n)] + [(10 * n, None, "null")]
    texts = ["".join(word().upper() if rng.random() < 0.3 else word() for _ in range(rng.randrange(6))) for _ in range(300)] + [None, "", "  ", " A ", "É", *["same text"] * 5]
    return listed, texts


@pytest.mark.parametrize("n,limit", [(469, hints.MOST_BYTES), (5000, hints.MOST_BYTES), (469, 0), (0, hints.MOST_BYTES)])
def test_brute(spark, n, limit):
    listed, texts = cases(n, n)
    table = spark.createDataFrame(listed, "ordinal int, hint string, key string").repartition(3)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, hint string")
    got = hints.first_hint(rows, "hint", table, "found", limit)
    assert got.columns == ["i", "hint", "found"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, t, brute(t, listed))) for i, t in enumerate(texts))


@pytest.mark.parametrize("limit", [hints.MOST_BYTES, 0])
def test_empty_and_repeated_hints(spark, limit):
    listed = [(5, "", "all"), (3, "b", "late b"), (2, "b", "early b"), (9, "a", "a")]
    rows = spark.createDataFrame([("ab",), ("a",), ("",), (None,)], "text string")
    got = hints.first_hint(rows, "text", spark.createDataFrame(listed, "ordinal int, hint string, key string"), "k", limit)
    assert {r.text: r.k for r in got.collect()} == {"ab": "early b", "a": "all", "": "all", None: None}


def test_specific_before_general(spark):
    listed = [(0, "strike 2", "cs2"), (1, "strike: source", "css"), (2, "strike", "cs"), (3, "siege x", "siege_x"), (4, "siege", "siege")]
    games = spark.createDataFrame([("cs2", 730, 0), ("csgo", 730, 1), ("tf2", 440, 2)], "key string, steam_appid int, ordinal int")
    rows = spark.createDataFrame([("Counter-Strike 2", ""), ("Counter-Strike: Source", None), ("Six Siege X", "1"), ("Six Siege", "440"), ("x", "730"), (None, None)], "name string, app_id string")
    got = catalog.identify(rows, games, spark.createDataFrame(listed, "ordinal int, hint string, key string")).collect()
    assert {r.name: r.key for r in got} == {"Counter-Strike 2": "cs2", "Counter-Strike: Source": "css", "Six Siege X": "siege_x", "Six Siege": "tf2", "x": "cs2", None: None}


def test_launchers(spark):
    listed = spark.createDataFrame([(0, "ubi", "ubisoft"), (1, "electronic arts", "ea")], "ordinal int, hint string, key string")
    rows = spark.createDataFrame([("FIFA", "Electronic Arts"), ("Far Cry", "Ubisoft"), ("x", None), (None, "UBI")], "name string, publisher string")
    assert [r.launcher for r in catalog.launcher(rows, listed).orderBy(F.col("launcher").desc_nulls_last(), "name").collect()] == ["ubisoft", "ubisoft", "ea", None]


@pytest.mark.parametrize("limit", [hints.MOST_BYTES, 0])
def test_equal_ordinals(spark, limit):
    """The least key counts, not the hint that comes first in the text."""
    listed = spark.createDataFrame([(1, "b", "k2"), (1, "a", "k3"), (1, "c", "k1")], "ordinal int, hint string, key string")
    rows = spark.createDataFrame([("abc",), ("ab",), ("a",)], "text string")
    assert {r.text: r.k for r in hints.first_hint(rows, "text", listed, "k", limit).collect()} == {"abc": "k1", "ab": "k2", "a": "k3"}
