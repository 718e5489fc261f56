import hashlib

import corpus_pipeline
import public_tokenizers as P
import pytest

from tellstone.llm import scratch
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_recompression import brute as repeats

DIR = "/root/testdata/sf0.001"


def components(docs, similarity=0.8):
    """The smallest id of each document's component of near copies."""
    sets = {}
    for i, text in docs:
        w = text.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if j < i and (a == b or len(a & b) >= similarity * len(a | b) > 0):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.stored(stage(spark, docs, DIR))
        out.append(docs)
    return [spark.read.parquet(f"{DIR}/documents.parquet"), *out]


def test_quality(spark, steps):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    low = [i for i, r in labels.items() if r.quality == 0]
    assert sum(i in kept for i in low) <= 0.1 * len(low)


def test_near_duplicates(steps):
    """The stage's own rule, 5-word shingles with a similarity of 0.8, by brute force: the smallest id of each component stays."""
    before = steps[1].collect()
    want = components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(set(want.values()))


def test_substrings(steps):
    before = steps[2].collect()
    want = {i: (n, gone, digest) for i, n, gone, digest in repeats([(r.doc_id, r.text) for r in before], 13)}
    after = {r.doc_id: r for r in steps[3].collect()}
    assert after.keys() == want.keys()
    for r in before:
        got = after[r.doc_id]
        assert got.n_chars == len(got.text)
        assert (hashlib.sha256(got.text.encode()).hexdigest() == want[r.doc_id][2]) if want[r.doc_id][1] else got.text == r.text


def test_benchmark(spark, steps):
    before = steps[3].collect()
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    verdict = leaks([(r.doc_id, r.text) for r in before], items, 10)
    assert sorted(r.doc_id for r in steps[4].collect()) == sorted(v[0] for v in verdict if not v[5])


def test_encoding(steps):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    before = {r.doc_id: r for r in steps[4].collect()}
    after = steps[5].collect()
    assert len(after) == len(before)
    for r in after:
        ids = sp.encode(before[r.doc_id].text, add_bos=True, add_eos=True)
        assert (list(r.ids), r.n_tokens, r.text, r.source) == (ids, len(ids), sp.decode(ids), before[r.doc_id].source)


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, DIR)
    assert sorted(map(tuple, got.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, steps[5].select("doc_id", "n_tokens").collect()))


def test_near_copies_by_simhash(spark):
    """Texts that differ in a short tail after many repeats have near fingerprints, though few shingles in common."""
    body = " ".join(f"w{k}" for k in range(21)) + " "
    tail = lambda n: " ".join(f"{n}{k}" for k in range(8))
    rows = [(1, body * 60 + tail("a")), (2, body * 60 + tail("b")), (3, body + tail("c")), (4, tail("d") + " " + tail("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(set(components(rows).values())) == 4
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, DIR).collect()) == [1, 3, 4]
