"""Near-equal vectors of a label by a forest of random-projection trees."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, roots
from .scratch import joined, stored

#: Vectors in the sample from which the splits are made; every vector is indexed by them.
SAMPLE = 50_000
#: Vectors of a label that a leaf is to hold, and that a tile of a larger one holds.
LEAF, TILE = 256, 2048


class Tree:
    """Splits of one tree: each node has a random direction and a place on it, or is a leaf."""

    def __init__(self, sample: np.ndarray, scale: float, seed: list[int], first_leaf: int):
        """scale: vectors of the largest label for each vector of the sample."""
        rng = np.random.default_rng(seed)
        self.directions, self.places, self.children, self.first_leaf, self.leaves = [], [], [], first_leaf, 0
        self.top = self._grow(sample, scale, rng, 0)
        self.directions = np.array(self.directions).reshape(-1, sample.shape[1])

    def _grow(self, members: np.ndarray, scale: float, rng: np.random.Generator, depth: int) -> int:
        """The number of a node; leaves have negative ones."""
        if len(members) * scale > LEAF and len(members) >= 8 and depth < 40:
            direction = rng.standard_normal(members.shape[1])
            direction /= np.linalg.norm(direction)
            along = members @ direction
            # A random place about the middle.
            place = float(np.quantile(along, rng.uniform(0.35, 0.65)))
            left, right = members[along <= place], members[along > place]
            if len(left) and len(right):
                node = len(self.children)
                self.directions.append(direction)
                self.places.append(place)
                self.children.append(None)
                self.children[node] = (self._grow(left, scale, rng, depth + 1), self._grow(right, scale, rng, depth + 1))
                return node
        self.leaves += 1
        return -self.leaves

    def plain(self) -> tuple:
        """The tree as arrays and numbers, which any executor can read."""
        return self.directions, np.array(self.places), np.array(self.children, np.int64).reshape(-1, 2), self.top, self.first_leaf

    def route(self, vectors: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        return route(self.plain(), vectors, spill)


def route(tree: tuple, vectors: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row and a leaf that it belongs to; near a split it belongs to both sides."""
    directions, places, children, top, first_leaf = tree
    rows, leaves, todo = [], [], [(top, np.arange(len(vectors)))]
    while todo:
        node, mine = todo.pop()
        if node < 0:
            rows.append(mine)
            leaves.append(np.full(len(mine), first_leaf - node - 1))
        elif len(mine):
            along = vectors[mine] @ directions[node] - places[node]
            left, right = children[node].tolist()
            todo += [(left, mine[along <= spill]), (right, mine[along >= -spill])]
    return np.concatenate(rows), np.concatenate(leaves)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their largest entry so that nothing over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def plant(sample: np.ndarray, scale: float, trees: int, seed: int) -> list[Tree]:
    out, first = [], 0
    for t in range(trees):
        out.append(Tree(sample, scale, [seed, t, sample.shape[1]], first))
        first += out[-1].leaves
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    """The rows of a column of arrays of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _nodes(rows: DataFrame) -> DataFrame:
    """Distinct vectors of a label that can be linked: node, label, vector, n of rows and first id."""
    good = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    grouped = rows.filter(good).groupBy("label", "h1", "h2").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    return stored(grouped.withColumn("node", F.monotonically_increasing_id()))


def owners(a: np.ndarray, b: np.ndarray, leaves: list[np.ndarray]) -> np.ndarray:
    """The first leaf that the rows of each pair have in common."""
    width = max(map(len, leaves))
    table = np.full((len(leaves), width), -1, np.int64)
    for i, x in enumerate(leaves):
        table[i, : len(x)] = np.sort(x)
    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), 20_000):
        x, y = table[a[k : k + 20_000]], table[b[k : k + 20_000]]
        both = (x[:, :, None] == y[:, None, :]).any(axis=2) & (x >= 0)
        out[k : k + 20_000] = x[np.arange(len(x)), np.argmax(both, axis=1)]
    return out


FOUND = "node long, links long, other long"


def _compare(threshold: float):
    def compare(key: tuple, table: pa.Table) -> pa.Table:
        leaf, i, j = (k.as_py() for k in key[-3:])
        table = table.combine_chunks()
        node, n, tile = (table.column(c).to_numpy() for c in ("node", "n", "tile"))
        vectors = unit(_vectors(table.column("vector").combine_chunks()))
        leaves = [np.array(x) for x in table.column("leaves").to_pylist()]
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        links, a_all, b_all = np.zeros(len(node), np.int64), [], []
        for k in range(0, len(left), 512):
            rows = left[k : k + 512]
            a, b = np.nonzero(vectors[rows] @ vectors[right].T >= threshold)
            a, b = rows[a], right[b]
            once = node[a] < node[b] if i == j else node[a] != node[b]
            a, b = a[once], b[once]
            mine = owners(a, b, leaves) == leaf if len(a) else np.zeros(0, bool)
            a, b = a[mine], b[mine]
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            root = roots(len(node), a, b)
            moved = np.flatnonzero(root != np.arange(len(node)))
            a_all.append(moved)
            b_all.append(root[moved])
        a, b = np.concatenate(a_all or [left[:0]]), np.concatenate(b_all or [left[:0]])
        root = roots(len(node), a, b)
        moved, some = np.flatnonzero(root != np.arange(len(node))), np.flatnonzero(links)
        return pa.table({
            "node": pa.array(np.concatenate([node[some], node[moved]]), pa.int64()),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(moved), np.int64)]), pa.int64()),
            "other": pa.array([None] * len(some) + node[root[moved]].tolist(), pa.int64()),
        })

    return compare


def near_vectors(rows: DataFrame, threshold: float = 0.98, trees: int = 6, spill: float = 0.8, seed: int = 7, sample: int = SAMPLE) -> DataFrame:
    """n_links and component_id of each row of rows (vec_id, embedding, label).

    Rows link if their labels are equal and not null, and the cosine, in double
    precision, is at least threshold.  Null, empty or zero vectors and those
    with null or non-finite entries, and rows without a label, link with none;
    vectors of different lengths don't link.  The trees' splits come from a
    sample of about that many distinct vectors; every vector is put in the
    leaves of every tree, on both sides of a split that is nearer than spill
    times the spread of a linked pair's difference along a random direction.
    Pairs are compared in leaves, exactly, so there are no false links; a link
    is missed where every tree parts its ends.  Equal vectors are one node, so
    they always link.  n_links counts other rows; component_id is the smallest
    vec_id reachable, kept tells whether it is the row's own.  Other columns
    are not used.
    """
    spark = rows.sparkSession
    vector = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector"), F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(1), vector, F.size(vector)).alias("h2"))
    nodes = _nodes(rows)
    total = nodes.count()
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    every = max(1, -(-total // sample))
    picked = nodes.filter(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(every)) == 0).select("vector")
    by_size: dict[int, list] = {}
    for r in picked.toLocalIterator():
        by_size.setdefault(len(r.vector), []).append(r.vector)
    share = largest / max(1, sum(map(len, by_size.values())))
    planted = {size: [t.plain() for t in plant(unit(np.array(v, np.float64)), share, trees, seed)] for size, v in by_size.items()}
    model = spark.sparkContext.broadcast(planted)
    apart = spill * float(np.sqrt(2 - 2 * threshold))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            leaves: list = [[0]] * batch.num_rows
            for size in np.unique(sizes).tolist():
                if size not in model.value:
                    continue
                mine = np.flatnonzero(sizes == size)
                vectors = unit(_vectors(column.take(pa.array(mine))))
                got = [route(t, vectors, apart / np.sqrt(size)) for t in model.value[size]]
                row, leaf = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                order = np.lexsort((leaf, row))
                for i, x in zip(mine.tolist(), np.split(leaf[order], np.searchsorted(row[order], np.arange(1, len(mine)))), strict=True):
                    leaves[i] = x.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaves, pa.list_(pa.int64()))], ["node", "leaves"])

    placed = stored(nodes.select("node", "vector").mapInArrow(place, "node long, leaves array<long>"))
    # Nodes and their leaves meet by the node, which is unique on both sides.
    member = nodes.select("node", "label", "n", "vector").join(placed, "node").withColumn("size", F.size("vector")).withColumn("leaf", F.explode("leaves"))
    cell = ["label", "size", "leaf"]
    sizes = placed.join(nodes.select("node", "label", F.size("vector").alias("size")), "node").withColumn("leaf", F.explode("leaves")).groupBy(*cell).count()
    large = sizes.filter(F.col("count") > TILE).select(*cell, F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    tiled = joined(member, large, cell, "left", F.col("node"))
    tiles = F.coalesce("tiles", F.lit(1))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(t, "tile").alias("i"), F.greatest(t, "tile").alias("j")))
    tiled = tiled.withColumn("pair", F.explode(pairs)).select("label", "size", "leaf", "pair.i", "pair.j", "node", "n", "tile", "vector", "leaves")
    found = stored(tiled.groupBy("label", "size", "leaf", "i", "j").applyInArrow(_compare(threshold), FOUND))
    member = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    smallest = member.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = joined(member, smallest, ["root"], "inner", F.col("node")).select("node", "component_id")
    known = nodes.select("node", "label", "h1", "h2", "n", "first").join(linked, "node", "left").join(counts, "node", "left").filter("n > 1 or links > 0")
    known = known.select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component_id", "first").alias("_component"))
    out = joined(rows.drop("vector"), known, ["label", "h1", "h2"], "left", F.col("vec_id"))
    component = F.when(F.col("_links").isNotNull(), F.col("_component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
