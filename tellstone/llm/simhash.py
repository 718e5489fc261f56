"""Near-duplicate texts by SimHash fingerprints and a grid of segment popcounts."""
from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, roots
from .names import mix
from .scratch import buckets as dealt
from .scratch import identity, joined, packed, stored
from .shared import by_bucket, parts

#: Members of a cell that are compared with all others in one step.
TILE = 512


def fingerprint_bits(texts: list[bytes], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """A fingerprint for each text, as unsigned numbers."""
    hashes, ends = [], []
    for text in texts:
        words = text.lower().split()
        if len(words) <= shingle:
            if words:
                hashes.append(xxhash.xxh64_intdigest(b" ".join(words), seed))
        else:
            joined_words = b" ".join(words)
            start = np.zeros(len(words), np.int64)
            length = np.fromiter(map(len, words), np.int64, len(words))
            start[1:] = np.cumsum(length + 1)[:-1]
            stop = (start + length)[shingle - 1 :].tolist()
            hashes += [xxhash.xxh64_intdigest(joined_words[a:b], seed) for a, b in zip(start.tolist(), stop, strict=False)]
        ends.append(len(hashes))
    ends = np.array(ends, np.int64)
    size = np.diff(ends, prepend=0)
    some = np.flatnonzero(size)
    out = np.zeros(len(texts), np.uint64)
    if len(some):
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_bits = np.add.reduceat(bits, (ends - size)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * set_bits > size[some, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, text: str = "text") -> DataFrame:
    """doc_id, text_hash and fingerprint (a long) of each row of docs."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.cast("binary").alias("_text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, found, held, size = batch.column(2), [], [], 0
            for value in values:
                held.append(value.as_py())
                size += len(held[-1])
                if size > 1 << 18:
                    found.append(fingerprint_bits(held, shingle, seed))
                    held, size = [], 0
            found.append(fingerprint_bits(held, shingle, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "text_hash", "fingerprint"])

    return rows.mapInArrow(make, "doc_id long, text_hash long, fingerprint long")


PAIRS = np.uint64(0x5555555555555555)


def embedding(x: np.ndarray) -> np.ndarray:
    """Popcounts of the 32 segments of two bits, each count in unary digits.

    The Manhattan distance of two such vectors is the number of unary digits in
    which they differ, and never more than the Hamming distance of x.
    """
    return (((x & (x >> np.uint64(1))) & PAIRS) << np.uint64(1)) | ((x | (x >> np.uint64(1))) & PAIRS)


def grid(distance: int) -> tuple[list[np.uint64], np.ndarray]:
    """Masks of the grid's tables, and for each set of equal blocks the table that owns a pair.

    The 32 segments are cut into 8 blocks.  Vectors within the distance differ
    in at most that many blocks, so they agree in 8 - distance blocks, a cell
    of one of the tables.  The first such table owns the pair.
    """
    keep = 8 - distance
    sets = list(combinations(range(8), keep))
    masks = [np.uint64(sum(0xFF << (8 * b) for b in s)) for s in sets]
    owner = np.full(256, -1, np.int64)
    for equal in range(256):
        blocks = tuple(b for b in range(8) if equal >> b & 1)
        if len(blocks) >= keep:
            owner[equal] = sets.index(blocks[:keep])
    return masks, owner


def _links(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, table: int, owner: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs this table owns and are linked; a, b: fingerprints, x, y: their embeddings."""
    apart = x ^ y
    near = np.flatnonzero(np.bitwise_count(apart) <= distance)
    equal = np.packbits(np.ascontiguousarray(apart[near]).view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little").reshape(-1)
    near = near[owner[equal] == table]
    return near[np.bitwise_count(a[near] ^ b[near]) <= distance]


def cell_links(prints: np.ndarray, table: int, mask: np.uint64, owner: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of distinct fingerprints that share a cell of a table, each once.

    Of cells of more than TILE members, a forest of the links is given.
    """
    vector = embedding(prints)
    order = np.argsort(vector & mask)
    prints, vector = prints[order], vector[order]
    cell = vector & mask
    head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
    size = np.diff(head, append=len(cell))
    # In small cells, each member meets those 1, 2, ... places later.
    mine = np.repeat((size > 1) & (size <= TILE), size)
    at = np.flatnonzero(mine)
    stop = np.repeat(head + size, size)
    step = 1
    while len(at):
        at = at[at + step < stop[at]]
        found = at[_links(prints[at], prints[at + step], vector[at], vector[at + step], table, owner, distance)] if len(at) else at
        if len(found):
            yield prints[found], prints[found + step]
        step += 1
    for h, s in zip(head[size > TILE].tolist(), size[size > TILE].tolist(), strict=True):
        yield from large_cell_links(prints[h : h + s], distance)


def large_cell_links(prints: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join all linked pairs of a large cell, whatever table owns them.

    Each member that no pivot has reached becomes a pivot and is compared with
    all; near copies of one text so take few passes.  Members that aren't
    pivots are then compared in tiles, but for tiles within one component.
    """
    root, reached, pivots = np.arange(len(prints)), np.zeros(len(prints), bool), np.zeros(len(prints), bool)
    left, right = [], []
    for k in range(len(prints)):
        if not reached[k]:
            near = np.flatnonzero(np.bitwise_count(prints ^ prints[k]) <= distance)
            reached[near] = pivots[k] = True
            left.append(np.full(len(near), k))
            right.append(near)
            if sum(map(len, left[-64:])) > 1 << 16 or len(left) > 4096:
                root = roots(len(prints), np.concatenate([*left, np.arange(len(prints))]), np.concatenate([*right, root]))
                left, right = [], []
    root = roots(len(prints), np.concatenate([*left, np.arange(len(prints))]), np.concatenate([*right, root]))
    rest = np.flatnonzero(~pivots)
    rest = rest[np.argsort(root[rest], kind="stable")]
    for i in range(0, len(rest), TILE):
        a = rest[i : i + TILE]
        for j in range(i, len(rest), TILE):
            b = rest[j : j + TILE]
            if root[a[0]] == root[b[-1]] and (root[a] == root[a[0]]).all() and (root[b] == root[a[0]]).all():
                continue
            x, y = np.nonzero(np.bitwise_count(prints[a][:, None] ^ prints[b][None, :]) <= distance)
            x, y = a[x], b[y]
            apart = root[x] != root[y]
            if apart.any():
                root = roots(len(prints), np.concatenate([x[apart], np.arange(len(prints))]), np.concatenate([y[apart], root]))
    moved = np.flatnonzero(root != np.arange(len(prints)))
    if len(moved):
        yield prints[moved], prints[root[moved]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the root of its component, for nodes that aren't roots."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(len(nodes), index[: len(a)], index[len(a) :])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """a, b: a forest of the links within the distance, from distinct fingerprints.

    Each fingerprint goes to a cell of every table of the grid; cells are dealt
    to tasks by their hash.
    """
    if not 0 <= distance < 8:
        raise ValueError("the grid has eight blocks: distances are 0 to 7")
    buckets = dealt(prints.sparkSession, prints.count() * len(grid(distance)[0]) * 8)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, _ = grid(distance)
        for batch in batches:
            all_prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(all_prints), 50_000):
                some = all_prints[k : k + 50_000]
                vector, sent = embedding(some), {}
                for table, mask in enumerate(masks):
                    where = mix((vector & mask) + np.uint64(table)) % np.uint64(buckets)
                    for b, mine in by_bucket(where, buckets):
                        sent.setdefault(b, []).append((table, some[mine]))
                yield parts([(b, pickle.dumps(x, 5)) for b, x in sent.items()])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, owner = grid(distance)
        held: dict[int, list] = {}
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                for table, some in pickle.loads(blob):
                    held.setdefault(table, []).append(some)
        left, right, size = [], [], 0
        for table in sorted(held):
            for a, b in cell_links(np.concatenate(held.pop(table)), table, masks[table], owner, distance):
                left.append(a)
                right.append(b)
                size += len(a)
                if size > 1 << 20:
                    a, b = forest(np.concatenate(left), np.concatenate(right))
                    left, right, size = [a], [b], 0
        if left:
            a, b = forest(np.concatenate(left), np.concatenate(right))
            for k in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000].view(np.int64)) for x in (a, b)], ["a", "b"])

    sent = prints.mapInArrow(send, "bucket int, blob binary")
    return sent.repartitionById(buckets, "bucket").mapInArrow(meet, "a long, b long")


def with_components(found: DataFrame, distance: int = 4) -> DataFrame:
    """found (doc_id, fingerprint, ...) with component_id, the smallest doc_id reachable.

    Links join fingerprints with at most that many differing bits; equal ones
    are one node.  Null doc_ids are linked but not counted for the smallest; a
    component of nulls has a null component_id.
    """
    nodes = stored(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    return grouped(found, components(links(nodes.select("fingerprint"), distance)), nodes)


def grouped(found: DataFrame, member: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """found (doc_id, fingerprint, ...) with component_id, from the components (node, root) of fingerprints.

    nodes has the first doc_id and the number n of rows of each fingerprint.
    """
    if nodes is None:
        nodes = stored(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    linked = member.join(nodes.withColumnRenamed("fingerprint", "node"), "node")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = joined(member, smallest, ["root"], "inner", F.col("node")).select(F.col("node").alias("fingerprint"), "component_id")
    copies = nodes.filter("n > 1").join(member.withColumnRenamed("node", "fingerprint"), "fingerprint", "left_anti").select("fingerprint", F.col("first").alias("component_id"))
    known = groups.unionByName(copies).withColumn("_known", F.lit(True))
    out = joined(found, known, ["fingerprint"], "left", F.struct("doc_id", "text_hash"))
    return out.withColumn("component_id", F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("doc_id"))).drop("_known")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs.

    Words are bytes between white space, A-Z in lower case; shingles of four
    count with repeats, shorter texts are one shingle, and a text without words
    (or null) has fingerprint zero, linked like any other.  Other columns are
    not used.
    """
    found = with_components(stored(fingerprints(docs, shingle, seed, text)), distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, text: str = "text") -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id; all columns kept.

    Nulls come last; of rows with the same id, that with the smallest text
    hash stays, and of equal ones any.
    """
    return one_of(docs, with_components(stored(fingerprints(docs, shingle, seed, text)), distance), text)


def one_of(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row of each component of found (doc_id, text_hash, fingerprint, component_id), as one_of_each() says."""
    found = stored(found)
    # A component without any id is that of its fingerprint's rows; each such component keeps a row.
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    group = ["component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("print")]
    counted = found.groupBy(*group).agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = counted.select(F.col("kept.doc_id").alias("doc_id"), F.col("kept.text_hash").alias("text_hash"))
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    several = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"), F.first("component_id").alias("component_id"), F.first("fingerprint").alias("fingerprint"))
    stay = kept.select(name.alias("id"), "text_hash", F.lit(True).alias("stay"))
    gone_groups = counted.select(F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("f"), "print")).alias("group")).distinct()
    marked = several.withColumn("id", name).withColumn("group", F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("f"), "fingerprint")))
    marked = joined(marked, gone_groups, ["group"], "left_semi", F.col("text_hash"))
    marked = stored(marked.join(stay, ["id", "text_hash"], "left").select("id", "text_hash", "rows", F.coalesce("stay", F.lit(False)).alias("stay")))
    rows = packed(docs, **identity(text) | {"id": name})
    out = joined(rows, marked.filter("rows > 1 or not stay").select("id", "text_hash"), ["id", "text_hash"], "left_anti")
    repeated = stored(marked.filter("rows > 1 and stay").select("id", "text_hash"))
    if repeated.limit(1).count():
        out = out.unionByName(joined(rows, repeated, ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"]))
    return out.select("row.*")
