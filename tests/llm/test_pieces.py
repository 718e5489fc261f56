import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from tellstone.llm import pieces

MODEL = P.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "   ", "a", "a ", " a", "a  b", "a   b ", "\ta\n b\n\n", "a▁b ▁▁c▁", "ﬁ ①é é", "\x00 x", "<s> a </s><unk>", "🙂🙂 日本語 テスト", "x" * 3000, "aa " * 2000, " \n \r\n\t ", "a b", "١٢٣ 12345,6", "�"]


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("table", [pieces.TABLE, 2])
def test_like_library(spark, sp, table):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "twice", "y"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode_decode(docs, MODEL, table=table).collect()
    expect = []
    for i, t, _ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        expect.append((i, ids, sp.decode(ids)))
    assert sorted(map(repr, ((r[0], list(r[1]), r[2]) for r in got))) == sorted(map(repr, expect))


def test_digests(spark, sp):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in pieces.encode_decode(docs, MODEL, digests=True).collect()}
    for r in docs.collect():
        ids = sp.encode(r.text, add_bos=True, add_eos=True)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_empty_table(spark):
    assert pieces.encode_decode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
