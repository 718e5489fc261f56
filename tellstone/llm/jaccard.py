"""Near-duplicate texts by the exact Jaccard similarity of their shingles, found by MinHash bands."""
from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .names import mix
from .scratch import buckets as dealt
from .scratch import joined, stored
from .shared import by_bucket, parts
from .simhash import grouped, one_of

#: Bands, and least hashes of a band.  A pair of similarity 0.8 has no band in common once in eight million.
BANDS, ROWS = 40, 5
_random = np.random.default_rng(42)
FACTORS = _random.integers(0, 1 << 63, (BANDS, ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Groups of up to this many members are compared pair by pair; of larger ones, the HUBS most central with all others first.
SMALL, HUBS = 16, 8
#: Members of a group in a row, and of a tile of a group that is compared pair by pair.
PIECE, TILE = 10_000, 2048
#: Bytes of text that are held as shingles at once, and pairs of a batch.
HELD, SOME = 1 << 18, 100_000

NODES = "doc_id long, text_hash long, fingerprint long, size int, bands binary"


def shingles(text: bytes, shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; one shingle if it is shorter, none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = (b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """The names of the bands of each set, none of which is empty, a row for each."""
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    hashes, out = np.concatenate(sets), np.zeros((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        name = np.full(len(sets), band, np.uint64)
        for factor in FACTORS[band]:
            name = mix(name ^ np.minimum.reduceat(mix_low(hashes * factor), start))
        out[:, band] = name
    return out


def mix_low(x: np.ndarray) -> np.ndarray:
    """x with its high bits, the best of a product, also in the low ones."""
    return x ^ (x >> np.uint64(32))


def names(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def signatures(docs: DataFrame, shingle: int = 5, text: str = "text") -> DataFrame:
    """doc_id, text_hash, fingerprint (the name of the set of shingles), size and bands of each row of docs."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.cast("binary").alias("_text"))

    def done(batch: pa.RecordBatch, at: int, sets: list[np.ndarray]) -> pa.RecordBatch:
        some = [k for k, s in enumerate(sets) if len(s)]
        named = dict(zip(some, bands([sets[k] for k in some]), strict=True)) if some else {}
        rest = [pa.array(names(sets)), pa.array([len(s) for s in sets], pa.int32()), pa.array([named[k].tobytes() if k in named else b"" for k in range(len(sets))], pa.binary())]
        part = batch.slice(at, len(sets))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *rest], ["doc_id", "text_hash", "fingerprint", "size", "bands"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, size, at = [], 0, 0
            for value in batch.column(2):
                held = value.as_py()
                sets.append(shingles(held, shingle))
                size += len(held)
                if size > HELD:
                    yield done(batch, at, sets)
                    at, sets, size = at + len(sets), [], 0
            if sets:
                yield done(batch, at, sets)

    return rows.mapInArrow(make, NODES)


def sets_of(docs: DataFrame, found: DataFrame, pairs: DataFrame, shingle: int = 5, text: str = "text") -> DataFrame:
    """fingerprint and shingles of the nodes of pairs, made again from one row of docs for each."""
    ends = pairs.select(F.col("a").alias("fingerprint")).union(pairs.select("b")).distinct()
    first = found.groupBy("fingerprint").agg(F.min(F.struct("text_hash", "doc_id")).alias("m"))
    wanted = joined(first, ends, ["fingerprint"], "left_semi", F.col("m")).select(F.xxhash64("m.doc_id", "m.text_hash").alias("_key")).distinct()
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(whole)).alias("_key"), whole.cast("binary").alias("_text"))
    rows = joined(rows, wanted, ["_key"], "left_semi").select("_text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                sets = [shingles(t.as_py(), shingle) for t in batch.column(0).slice(at, 200)]
                yield pa.RecordBatch.from_arrays([pa.array(names(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["fingerprint", "shingles"])

    return rows.mapInArrow(make, "fingerprint long, shingles binary").dropDuplicates(["fingerprint"])


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(a), SOME):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[k : k + SOME], b[k : k + SOME])), pa.array(np.maximum(a[k : k + SOME], b[k : k + SOME]))], ["a", "b"])


def band_groups(nodes: DataFrame) -> DataFrame:
    """group, n (its members), nodes and sizes (arrays, by node) of each group of several nodes (fingerprint, size, bands) with a band in common.

    A group is named by its members, so that it is there once however many
    bands it has in common; large ones have a row for each PIECE of them.
    """
    buckets = dealt(nodes.sparkSession, nodes.count() * BANDS * 20)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                names = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64)
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
                size = np.repeat(part.column(1).to_numpy(zero_copy_only=False), BANDS)
                yield parts([(b, pickle.dumps((names[mine], node[mine], size[mine]), 5)) for b, mine in by_bucket(mix(names) % np.uint64(buckets), buckets)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pickle.loads(blob) for batch in batches for blob in batch.column(1).to_pylist()]
        if not held:
            return
        names, node, size = (np.concatenate([h[k] for h in held]) for k in range(3))
        del held
        order = np.lexsort((node, names))
        names, node, size = names[order], node[order], size[order]
        head = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        count = np.diff(head, append=len(names))
        head, count = head[count > 1], count[count > 1]
        group = [xxhash.xxh64_intdigest(node[h : h + c].tobytes()) for h, c in zip(head.tolist(), count.tolist(), strict=True)]
        spans = [(g, c, at, min(at + PIECE, h + c)) for g, h, c in zip(np.array(group, np.uint64).view(np.int64).tolist(), head.tolist(), count.tolist(), strict=True) for at in range(h, h + c, PIECE)]
        for k in range(0, len(spans), 10_000):
            some = spans[k : k + 10_000]
            each = [pa.array([x[a:b] for *_, a, b in some], pa.list_(t)) for x, t in ((node, pa.int64()), (size, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in some], pa.int64()) for i in range(2)), *each], ["group", "n", "nodes", "sizes"])

    sent = nodes.select("fingerprint", "size", "bands").mapInArrow(send, "bucket int, blob binary")
    # Near copies have many bands in common, and so the same groups.
    return sent.repartitionById(buckets, "bucket").mapInArrow(meet, "group long, n long, nodes array<long>, sizes array<int>").distinct()


def hub_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: the most central members of each group of members (group, n, node, size), each with all others that may be alike.

    A member counts as central that has large groups in common with others: the
    text that near copies were made from is in the largest group of every band.
    """
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    # The limit of the row number is taken in each task before rows move.
    central = members.join(weight, "node").withColumn("place", F.row_number().over(W.partitionBy("group").orderBy(F.desc("weight"), "node"))).filter(F.col("place") <= HUBS)
    hubs = central.groupBy("group").agg(F.collect_list(F.struct(F.col("node").alias("hub"), F.col("size").alias("hub_size"))).alias("hubs"))  # HUBS each
    met = joined(members.select("group", "node", "size"), hubs, ["group"], "inner", F.col("node"))
    # A node has the same hubs in most of its groups, of which there are as many as bands at most.
    each = met.groupBy("node", "size").agg(F.array_distinct(F.flatten(F.collect_set("hubs"))).alias("hubs"))
    share = similarity / (1 + similarity)
    near = lambda h: (F.col("node") != h["hub"]) & (F.least("size", h["hub_size"]) >= share * (F.col("size") + h["hub_size"]) - 1e-9)
    pairs = each.select("node", F.explode(F.transform(F.filter("hubs", near), lambda h: h["hub"])).alias("hub"))
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def pairs_of(groups: DataFrame, similarity: float) -> DataFrame:
    """a, b: members of groups (nodes, sizes, roots, ranks, sides), each with all after it that may be alike, has another root and is of another side, if there are two.

    ranks are the places of what the group has in common in its members; what
    comes from there on must be enough for the similarity (0: no such places).
    """
    share = similarity / (1 + similarity)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, held = [], [], 0
            for row in zip(*(batch.column(k) for k in range(5)), strict=True):
                node, size, root, rank, side = (x.values.to_numpy() for x in row)
                left_over = size - np.maximum(rank, 1) + 1
                if len(node) > 1 and np.partition(left_over, -2)[-2] < share * 2 * size.min() - 1e-9:
                    continue
                two = side.min() != side.max()
                for k in range(len(node) - 1):
                    enough = np.minimum(left_over[k], left_over[k + 1 :]) >= share * (size[k] + size[k + 1 :]) - 1e-9
                    if two:
                        enough &= side[k + 1 :] != side[k]
                    near = k + 1 + np.flatnonzero((root[k + 1 :] != root[k]) & enough)
                    left.append(np.full(len(near), node[k]))
                    right.append(node[near])
                    held += len(near)
                    if held > SOME:
                        yield from _pairs(np.concatenate(left), np.concatenate(right))
                        left, right, held = [], [], 0
            if held:
                yield from _pairs(np.concatenate(left), np.concatenate(right))

    return groups.select("nodes", "sizes", "roots", "ranks", "sides").mapInArrow(make, "a long, b long").distinct()


def apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """fingerprint and root of the members of those groups that the links found don't join whole."""
    each = members.select("group", "node").join(components(found), "node", "left").select("group", "node", F.coalesce("root", "node").alias("root"))
    open_ = each.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("group")
    return joined(each, open_, ["group"], "left_semi", F.col("node")).select(F.col("node").alias("fingerprint"), "root").distinct()


def prefix_groups(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """nodes, sizes, roots, ranks and sides of the members (fingerprint, root) that have a shingle in common among their rarest.

    Of all shingles in one order, the rarest first, two sets of that
    similarity have one in common among the first size - ceil(similarity *
    size) + 1 of each.  So no such pair is lost, and texts that share a
    passage but little else don't meet.  The sizes of such a pair are of one
    class or of neighbouring ones, by powers of the similarity, so a shingle's
    members meet by two classes at a time; more than TILE of them are dealt to
    tiles, and a row has the members of two tiles.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, root, held in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                grams = np.frombuffer(held, np.int64)
                for k in range(0, len(grams), SOME):
                    part = grams[k : k + SOME]
                    each = [pa.array(np.full(len(part), x, t)) for x, t in ((node, np.int64), (root, np.int64), (len(grams), np.int32))]
                    yield pa.RecordBatch.from_arrays([*each, pa.array(part)], ["node", "root", "size", "shingle"])

    tokens = stored(members.join(sets, "fingerprint").select("fingerprint", "root", "shingles").mapInArrow(spread, "node long, root long, size int, shingle long"))
    often = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranked = joined(tokens, often, ["shingle"], "left", F.col("node"))
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "shingle")))
    kept = ranked.filter((F.col("n") > 1) & (F.col("rank") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1))
    # A hair off the powers, so that rounding moves no size that is one of them into another class than its neighbours expect.
    of_size = F.floor(F.log(F.col("size") + 0.5) / float(-np.log(similarity))).cast("int")
    kept = stored(kept.select("shingle", "node", "size", "root", "rank", F.explode(F.array(of_size, of_size + 1)).alias("class")))
    counts = kept.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("shingle", "class", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    dealt_to = joined(kept, counts, ["shingle", "class"], "inner", F.col("node")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("i"), F.greatest(t, "tile").alias("j")))
    rows = dealt_to.withColumn("p", F.explode(pairs)).select("shingle", "class", "p.i", "p.j", "node", "size", "root", "rank", "tile")
    met = rows.groupBy("shingle", "class", "i", "j").agg(F.array_sort(F.collect_list(F.struct("node", "size", "root", "rank", "tile"))).alias("m"))  # two tiles at most
    return met.filter(F.size("m") > 1).select(*[F.col(f"m.{c}").alias(f"{c}s") for c in ("node", "size", "root", "rank")], F.col("m.tile").alias("sides"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets (fingerprint, shingles) have that Jaccard similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                stay[k] = both >= similarity * (len(x) + len(y) - both) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(stay))

    of = lambda end, name: sets.select(F.col("fingerprint").alias(end), F.col("shingles").alias(name))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def links(docs: DataFrame, signed: DataFrame, similarity: float, shingle: int = 5, text: str = "text") -> DataFrame:
    """a, b: links that join all pairs of that similarity, between the nodes of signed, the signatures of docs.

    Each link is exact.  In a large group the most central members are
    compared with all others; what they don't join is met again by its rarest
    shingles, which is exact too.
    """
    nodes = signed.filter("size > 0").select("fingerprint", "size", "bands").dropDuplicates(["fingerprint"])
    groups = stored(band_groups(nodes))
    few = groups.filter(F.col("n") <= SMALL)
    none = F.transform("sizes", lambda x: F.lit(0))
    first = pairs_of(few.select("nodes", "sizes", F.col("nodes").alias("roots"), none.alias("ranks"), none.alias("sides")), similarity)
    large = groups.filter(F.col("n") > SMALL).select("group", "n", F.explode(F.arrays_zip("nodes", "sizes")).alias("m"))
    large = stored(large.select("group", "n", F.col("m.nodes").alias("node"), F.col("m.sizes").alias("size")))
    pairs = stored(first.union(hub_pairs(large, similarity)).distinct())
    # Sets are made once for all pairs: those of all members of large groups too.
    members = large.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
    sets = stored(sets_of(docs, signed, pairs.union(members), shingle, text))
    found = stored(verified(pairs, sets, similarity))
    members = stored(apart(large, found))
    if not members.limit(1).count():
        return found
    others = stored(pairs_of(prefix_groups(members, sets, similarity), similarity).join(pairs, ["a", "b"], "left_anti"))
    return found.unionByName(verified(others, sets, similarity))


def one_of_each(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, text: str = "text", near: DataFrame | None = None) -> DataFrame:
    """docs with one row of each component of near copies, that with the smallest doc_id; all columns kept.

    Near copies are texts whose sets of shingles have that Jaccard similarity.
    Words are bytes between white space, A-Z in lower case; shorter texts are
    one shingle, and texts without words (or null) are equal.  near (text_hash,
    group) has what another operator links: texts of a group are near copies
    too.  Nulls come last; of rows with the same id, that with the smallest
    text hash stays, and of equal ones any.
    """
    found = stored(signatures(docs, shingle, text))
    pairs = links(docs, found, similarity, shingle, text)
    if near is not None:
        pairs = pairs.select("a", "b").unionByName(group_links(found, near))
    return one_of(docs, grouped(found.select("doc_id", "text_hash", "fingerprint"), components(pairs)), text)


def group_links(found: DataFrame, near: DataFrame) -> DataFrame:
    """a, b: links of each node of found to the least one of its group in near (text_hash, group)."""
    texts = found.select("text_hash", F.col("fingerprint").alias("a")).distinct()
    nodes = stored(texts.join(near.select("text_hash", "group").distinct(), "text_hash").select("group", "a").distinct())
    least = nodes.groupBy("group").agg(F.min("a").alias("b"), F.max("a").alias("_last")).filter("b < _last").select("group", "b")
    return joined(nodes, least, ["group"], "inner", F.col("a")).filter("a != b").select("a", "b")
