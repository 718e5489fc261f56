import numpy as np
import public_tokenizers as P
import pytest

from tellstone.llm import attribution

RANKS = P.path("byte_bpe_50k.tiktoken")


def brute(text, ends, rule):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = t.encode(text, add_special_tokens=False).ids
    _, lengths = attribution.encoder(RANKS, P.PATTERN)
    owner, at = [], 0
    for k, e in enumerate(ends):
        owner += [k] * (e - at)
        at = e
    out, at, crossing = [0.0] * len(ends), 0, 0
    for i in ids:
        own = owner[at : at + lengths[i]]
        crossing += len(set(own)) > 1
        if rule == "start":
            out[own[0]] += 1
        elif rule == "end":
            out[own[-1]] += 1
        elif rule == "majority":
            out[max(sorted(set(own)), key=own.count)] += 1
        else:
            for k in own:
                out[k] += 1 / len(own)
        at += lengths[i]
    return len(ids), out, crossing


TEXTS = ["one\ntwo  three\n\n\n  four", "\n", "né\n\n日本\n語 x", "a" * 500 + "\n" + "b c " * 300, "<|endoftext|>\nx"]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_brute(spark, rule):
    docs = spark.createDataFrame([*enumerate(TEXTS), (90, None), (91, ""), (0, TEXTS[0])], "doc_id long, text string")
    got = attribution.token_counts(docs, RANKS, P.PATTERN, rule=rule).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        if r.doc_id >= 90:
            assert (r.n_tokens, r.n_sections, r.section_tokens, r.n_crossing) == (0, 0, [], 0)
            continue
        raw = TEXTS[r.doc_id].encode()
        ends = sorted({i + 1 for i, b in enumerate(raw) if b == 10} | {len(raw)})
        n, share, crossing = brute(TEXTS[r.doc_id], ends, rule)
        assert (r.n_tokens, r.n_sections, r.n_crossing) == (n, len(ends), crossing)
        assert np.allclose(r.section_tokens, share)
        assert abs(sum(r.section_tokens) - n) < 1e-6


@pytest.mark.parametrize("rule", attribution.RULES)
def test_given_sections(spark, rule):
    text = "héllo wörld, internationalization happens"
    docs = spark.createDataFrame([(1, text, [3, 16, None, 16, 99])], "doc_id long, text string, cuts array<int>")
    r = attribution.token_counts(docs, RANKS, P.PATTERN, rule=rule, sections="cuts").first()
    ends = [len(text[:c].encode()) for c in (3, 16, len(text))]
    n, share, crossing = brute(text, ends, rule)
    assert crossing and (r.n_tokens, r.n_crossing) == (n, crossing) and np.allclose(r.section_tokens, share)


def test_empty_table(spark):
    assert attribution.token_counts(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("space", [" ", "\n", " \n\t", "\u3000"])
def test_long_runs_of_white_space(monkeypatch, space):
    """Cut runs give the tokens that the whole text has."""
    encoding, _ = attribution.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    monkeypatch.setattr(attribution, "LONG", 5)
    for text in (space * 30, f"a{space * 30}b", f"{space * 30}b c{space * 31}", f"x{space * 7}1{space * 9}!{space * 8}'s"):
        assert attribution.tokens_of(encoding, text).tolist() == encoding.encode(text, disallowed_special=())


def test_ten_megabytes_of_one_character(spark):
    texts = [c * 10_000_000 for c in " a!"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = attribution.token_counts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2] and all(r.n_tokens > 0 and r.n_sections == 1 for r in got)
