import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tellstone.llm import jaccard
from tests.llm.test_simhash import union


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def kept(ids, texts):
    """The least id of each group of brute-force Jaccard similarity 0.8."""
    s = [shingles(t) for t in texts]
    root = union(len(s), [(i, j) for i in range(len(s)) for j in range(i) if similar(s[i], s[j])])
    least = {}
    for i, r in zip(ids, root, strict=True):
        least[r] = min(least.get(r, i), i)
    return sorted(least.values())


def copies(seed, groups=12, each=10):
    """Texts with changes at some places, of similarities on both sides of 0.8, and edges."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"Wörd{rng.randrange(5000)}" for _ in range(rng.randrange(30, 300))]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 40)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(5000)}"
            out.append(rng.choice([" ", "\n"]).join(w))
    return [*out, None, "", " \n", "one", "ONE", "one two three four", "a b c d e", "a b " * 300, out[0], out[0].upper().lower()]


@pytest.mark.parametrize("small,hubs", [(16, 8), (2, 1)])
def test_brute(spark, monkeypatch, small, hubs):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "HUBS", hubs)
    texts = copies(small)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(3)
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == kept(range(len(texts)), texts)


def test_stage(spark):
    """The pipeline's stage finds near copies of 0.8 that are more than four bits apart."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(1000)
    rows = docs.select("doc_id", "text").collect()
    got = corpus_pipeline.simhash_near_dedup(spark, docs, folder).collect()
    assert sorted(r.doc_id for r in got) == kept([r.doc_id for r in rows], [r.text for r in rows])


def test_edges(spark):
    assert jaccard.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "only here"), (None, "only here"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, jaccard.one_of_each(df).collect()))) == ["(3, None)", "(None, 'only here')"]


@pytest.mark.parametrize("tile,piece", [(jaccard.TILE, jaccard.PIECE), (4, 3)])
def test_members_that_no_hub_joins(spark, monkeypatch, tile, piece):
    """Chains and texts around one passage, in groups with a single hub: classes are those of brute force."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "PIECE", piece)
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "HUBS", 1)
    chain = [" ".join(f"w{k}" for k in range(3 * i, 3 * i + 100)) for i in range(30)]
    around = [" ".join([f"p{k}" for k in range(60)] + [f"u{i}x{k}" for k in range(25)]) for i in range(30)]
    edits = [" ".join([f"q{k}" for k in range(80)] + [f"e{i // 2}x{k}" for k in range(20)] + [f"v{i}"]) for i in range(30)]
    texts = chain + around + edits
    sets = [set(jaccard.shingles(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in jaccard.one_of_each(docs).collect()}
    assert got == set(root)


def test_many_texts_around_one_passage(spark):
    """20,000 texts that share most of their words, and no pair of which is alike: no group becomes all its pairs."""
    docs = spark.range(20_000).withColumn("text", F.concat_ws(" ", *[F.lit(f"p{k}") for k in range(30)], *[F.concat(F.lit(f"u{k}x"), "id") for k in range(6)])).withColumnRenamed("id", "doc_id").repartition(8)
    signed = jaccard.signatures(docs)
    nodes = signed.select("fingerprint", "size", "bands").dropDuplicates(["fingerprint"])
    groups = jaccard.band_groups(nodes)
    assert groups.agg(F.max("n")).first()[0] > 2000
    assert jaccard.links(docs, signed, 0.8).count() == 0
    large = groups.filter("n > 16").select("group", "n", F.explode(F.arrays_zip("nodes", "sizes")).alias("m")).select("group", "n", F.col("m.nodes").alias("node"), F.col("m.sizes").alias("size"))
    members = large.select(F.col("node").alias("fingerprint"), F.col("node").alias("root")).distinct()
    sets = jaccard.sets_of(docs, signed, members.select(F.col("root").alias("a"), F.col("root").alias("b")))
    assert jaccard.pairs_of(jaccard.prefix_groups(members, sets, 0.8), 0.8).count() == 0
