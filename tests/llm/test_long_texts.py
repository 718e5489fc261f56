"""Texts of over 1 MB in the operators whose own tests have none, and edges in each stage of the pipeline."""
import base64
import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tellstone.llm import jaccard, licenses, pieces, quality, simhash, warc
from tests.llm.test_simhash import fingerprint

rng = random.Random(8)
PROSE = " ".join(f"w{rng.randrange(5000)}" for _ in range(250_000))
LONG = [PROSE, PROSE + " end", "x" * 1_500_000, "a b " * 400_000, " " * 1_200_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(LONG)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def test_warc(spark):
    pages = spark.createDataFrame([(i, "http://a/", t) for i, t in enumerate(LONG[:3])] + [(9, "http://a/", PROSE)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == {0: (len(PROSE), digest(PROSE), "revisit", 9), 9: (len(PROSE), digest(PROSE), "response", None), **{i: (len(LONG[i]), digest(LONG[i]), "response", None) for i in (1, 2)}}


def test_simhash(docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {i: r[0] for i, r in got.items()} == {i: f"{fingerprint(t):016x}" for i, t in enumerate(LONG)}
    assert got[1][1] == 0 and got[4][1] == 4


def test_licenses(spark):
    text = f"{PROSE}\n{licenses.TEMPLATES['mit']}\n{PROSE}"
    got = licenses.find(spark.createDataFrame([(1, text), (2, "y" * 1_500_000)], "doc_id long, text string"), licenses.templates(spark)).collect()
    assert (1, "mit", 1.0) in {(r.doc_id, r.template, r.containment) for r in got}
    assert {(r.doc_id, r.template) for r in got} <= {(1, "mit"), (1, "mit-0")}


def test_pieces(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    few = docs.filter("doc_id in (1, 4)")
    for r in pieces.encode_decode(few, P.path("piece_bpe_32k.model"), digests=True).collect():
        ids = sp.encode(LONG[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_quality(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels, F.col("source"), F.col("lang")).count() == len(LONG)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (7, "x", None, "s", 1)], docs.schema)
    assert quality.keep(odd, labels, F.col("source"), F.col("lang")).columns == odd.columns


def test_near_copies(docs):
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == [0, 2, 3, 4]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_edges(spark, docs, k):
    """Nulls in each column, empty, long and repeated rows and no rows at all: each stage gives its columns and keeps what is clean."""
    folder = "/root/testdata/sf0.001"
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (5, "plain words that nobody else has here", None, None, 37), (5, "plain words that nobody else has here", None, None, 37)]
    name, stage = corpus_pipeline.STAGES[k]
    columns = corpus_pipeline.COLUMNS if k < 4 else ["doc_id", "lang", "source", "n_tokens", "ids", "text"]
    empty = stage(spark, docs.limit(0), folder)
    assert empty.columns == columns and empty.count() == 0
    rows = spark.createDataFrame(odd, docs.schema).unionByName(docs.filter("doc_id = 0"))
    got = stage(spark, rows, folder).collect()
    assert {r.doc_id for r in got} >= ({0, 5} if k else {5})
    assert len(got) == {1: 3, 2: 5, 3: 5, 4: 5}.get(k, len(got))
