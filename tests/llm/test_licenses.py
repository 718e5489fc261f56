import random
import re

import pytest

from tellstone.llm import licenses


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, notices):
    """The best containment of each notice over all places of each text."""
    out = {}
    for doc, text in docs:
        w = words(text)
        for name, notice in notices.items():
            t = words(notice)
            if len(t) < 5:
                continue
            want, slack = shingles(t), len(t) // 5
            best = max((len(want & shingles(w[max(0, p - slack) : p + len(t) + slack])) / len(want) for p in range(len(w) + 1)), default=0)
            if best >= 0.8:
                out[doc, name] = best
    return out


@pytest.mark.parametrize("limit,most", [(1 << 24, 50_000), (0, 0)])
def test_brute(spark, limit, most):
    rng = random.Random(most)
    noise = lambda n: " ".join(rng.choice(["the", "of", "license", "under", "x", "É"]) for _ in range(n))
    notices = dict(licenses.TEMPLATES) | {"short": "MIT License", "six": "One two three four five six"}
    docs = []
    for k, name in enumerate(sorted(notices) * 2):
        w = notices[name].split()
        for _ in range(rng.choice([0, 0, 1, len(w) // 25])):
            w[rng.randrange(len(w))] = "changed"
        docs.append((k, noise(rng.randrange(60)) + "\n" + " ".join(w).upper() + ". " + noise(rng.randrange(60))))
    docs += [(900, None), (901, ""), (902, "under the MIT License"), (903, noise(300)), (904, docs[2][1]), (904, docs[2][1]), (None, docs[5][1]), (905, notices["mit"] + " " + notices["isc"])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, template string")
    got = licenses.find(df, licenses.templates(spark, notices), limit=limit, most=most).collect()
    assert {(r.doc_id, r.template) for r in got} == set(brute(docs, notices))
    assert len(got) == len({(r.doc_id, r.template) for r in got})
    for r in got:
        assert 0.8 <= r.containment <= brute([d for d in docs if d[0] == r.doc_id], notices)[r.doc_id, r.template] + 1e-9


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.find(empty, licenses.templates(spark)).count() == 0
    one = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert [tuple(r) for r in licenses.find(one, licenses.templates(spark)).collect()] == [(1, "mit-line", 1.0, 0)]
    assert licenses.find(one, spark.createDataFrame([], "template string, text string")).count() == 0


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_short_notices(spark, limit):
    """Notices of fewer than five words are found, also in a text that is only that line."""
    notices = dict(licenses.TEMPLATES) | {"two": "MIT License", "one": "Copyleft!", "none": "..."}
    docs = [(1, "All rights reserved."), (2, "x All\nRIGHTS reserved, all rights reserved"), (3, "all rights are reserved"), (4, "Released under the MIT License."), (5, "copyleft"), (6, None), (7, ""), (1, "All rights reserved."), (None, "é mit license")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = licenses.find_all(df, licenses.templates(spark, notices), limit=limit).collect()
    line = "all-rights-reserved-line"
    want = [(1, line, 1.0, 0), (2, line, 1.0, 1), (4, "two", 1.0, 3), (4, "mit-line", 1.0, 0), (5, "one", 1.0, 0), (None, "two", 1.0, 1)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_query_finds_all_rights_reserved(spark):
    from tellstone.llm import queries

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id for r in docs if " all rights reserved " in f" {' '.join(words(r.text))} "}
    got = {r.doc_id for r in queries.op5_licenses(spark, folder).filter("template = 'all-rights-reserved-line'").collect()}
    assert got == want and want


def test_candidates_at_the_start(spark):
    """Of candidates that begin before the text, each is verified and the best one counts."""
    notice = licenses.TEMPLATES["gpl-3-line"]
    df = spark.createDataFrame([(k, notice + f" x{k}" * (k % 3)) for k in range(60)], "doc_id long, text string").repartition(7)
    got = licenses.find(df, licenses.templates(spark, {"gpl-3-line": notice}))
    assert {(r.doc_id, r.containment, r.first_word) for r in got.collect()} == {(k, 1.0, 0) for k in range(60)}
