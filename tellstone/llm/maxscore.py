"""The k highest inner products of whole-number vectors, exactly, by MaxScore over shards."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import stored

#: Queries that a task holds, and vectors of a shard, which pass it in batches.
BLOCK, SHARD = 2048, 1 << 20
#: Vectors that are scored whole when a query has no k-th score yet, and terms that are probed at once.
FIRST, PROBE = 512, 12
LAST = np.iinfo(np.int64).max
FOUND = "query long, query_id long, vec_id long, score long"


def quantized(vector: Column, scale: float = 64) -> Column:
    """floor(scale * x) of each component as a long; beyond its range, its ends."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x))


class Searcher:
    """The best k of all vectors seen so far, for a block of queries of one length."""

    def __init__(self, nodes: np.ndarray, ids: np.ma.MaskedArray, vectors: np.ndarray, k: int):
        """vectors: a row of long integers for each query."""
        self.nodes, self.ids, self.vectors, self.k = nodes, ids, vectors, k
        none = np.zeros(0, np.int64)
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, none)] * len(nodes)

    def add(self, nodes: np.ndarray, ids: np.ndarray, known: np.ndarray, vectors: np.ndarray) -> None:
        """Score a batch of vectors, one in each column; ids of unknown ones come last."""
        if not len(nodes):
            return
        size, top = len(vectors), float(np.abs(self.vectors).max(initial=0).astype(float)) * float(np.abs(vectors).max(initial=0).astype(float)) * max(1, len(vectors))
        # Sums of whole numbers up to these are exact in these types; beyond them Python's own integers are taken.
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else object
        queries, postings = self.vectors.astype(kind), vectors.astype(kind)
        if kind is object or not size:
            for q, query in enumerate(queries):
                score = query @ postings if size else np.zeros(len(nodes), np.int64)
                self._keep(q, np.arange(len(nodes)), np.clip(score, -LAST - 1, LAST).astype(np.int64), nodes, ids, known)
            return
        # What a term can add at most; terms in falling order of that, and what those from each place on can add together.
        bound = np.maximum(queries * postings.max(axis=1), queries * postings.min(axis=1)).astype(np.float64)
        order = np.argsort(-bound, axis=1, kind="stable")
        norm = np.sqrt(np.einsum("ij,ij->j", postings, postings, dtype=np.float64))
        sorted_bound, sorted_query = np.take_along_axis(bound, order, 1), np.take_along_axis(queries, order, 1).astype(np.float64)
        rest_sum = np.zeros((len(queries), size + 1))
        rest_norm = np.zeros((len(queries), size + 1))
        rest_sum[:, :-1] = np.cumsum(sorted_bound[:, ::-1], axis=1)[:, ::-1]
        rest_norm[:, :-1] = np.sqrt(np.cumsum(sorted_query[:, ::-1] ** 2, axis=1)[:, ::-1])
        # A hair more than the norms say, as these are rounded.
        longest = norm.max() * (1 + 1e-9)
        rest = np.minimum(rest_sum, rest_norm * longest + 1e-6)
        for q, query in enumerate(queries):
            start = 0
            if len(self.best[q][0]) < self.k:
                start = min(FIRST, len(nodes))
                self._keep(q, np.arange(start), (query @ postings[:, :start]).astype(np.int64), nodes, ids, known)
                if start == len(nodes):
                    continue
                if len(self.best[q][0]) < self.k:
                    self._keep(q, np.arange(start, len(nodes)), (query @ postings[:, start:]).astype(np.int64), nodes, ids, known)
                    continue
            least = self.best[q][0][-1]
            # The terms before this place are essential: vectors with none of them can't reach the k-th score.
            essential = int(np.count_nonzero(rest[q] >= least))
            if not essential:
                continue
            terms = order[q, :essential]
            score = query[terms] @ postings[terms, start:]
            alive = np.flatnonzero(score + rest[q, min(essential, size)] >= least)
            score, at = score[alive], essential
            while at < size and len(alive):
                terms = order[q, at : at + PROBE]
                at += len(terms)
                score = score + query[terms] @ postings[terms[:, None], start + alive]
                competitive = score + np.minimum(rest_sum[q, at], rest_norm[q, at] * longest + 1e-6) >= least
                alive, score = alive[competitive], score[competitive]
            self._keep(q, start + alive, score.astype(np.int64), nodes, ids, known)

    def _keep(self, q: int, at: np.ndarray, score: np.ndarray, nodes: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        other = nodes[at] != self.nodes[q]
        at, score = at[other], score[other]
        old = self.best[q]
        if len(old[0]) >= self.k:
            high = score >= old[0][-1]
            at, score = at[high], score[high]
        if not len(at):
            return
        score, ids, known = np.concatenate([old[0], score]), np.concatenate([old[1], ids[at]]), np.concatenate([old[2], known[at].astype(np.int64)])
        if len(score) > 8 * self.k:
            high = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids, known = score[high], ids[high], known[high]
        # Scores in falling order, without a change of sign, which the least long integer doesn't have.
        order = np.lexsort((ids, 1 - known, ~score))[: self.k]
        self.best[q] = score[order], ids[order], known[order]

    def found(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.nodes), 512):
            mine = range(at, min(at + 512, len(self.nodes)))
            size = [len(self.best[q][0]) for q in mine]
            score, ids, known = (np.concatenate([self.best[q][i] for q in mine]) for i in range(3))
            query, query_id = (np.repeat(x[at : at + 512], size) for x in (self.nodes, self.ids))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(query_id), pa.array(ids, mask=known == 0), pa.array(score)], ["query", "query_id", "vec_id", "score"])


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, searchers = None, {}, {}
        for batch in batches:
            cells, roles = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero((np.diff(cells, prepend=-1) != 0) | (np.diff(roles, prepend=-1) != 0)).tolist()
            for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                if cells[a] != cell:
                    for s in searchers.values():
                        yield from s.found()
                    cell, waiting, searchers = cells[a], {}, {}
                part = batch.slice(a, b - a)
                vectors = part.column(4)
                length = vectors.value_lengths().to_numpy()
                for size in np.unique(length).tolist():
                    mine = np.flatnonzero(length == size)
                    rows = vectors.take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), size)
                    node = part.column(2).to_numpy()[mine]
                    column = part.column(3).take(pa.array(mine))
                    ids, known = column.fill_null(LAST).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
                    if roles[a] == 0:
                        waiting.setdefault(size, []).append((node, ids, rows))
                        continue
                    if size in waiting:
                        got = waiting.pop(size)
                        searchers[size] = Searcher(*(np.concatenate([g[i] for g in got]) for i in range(3)), k)
                    if size in searchers:
                        searchers[size].add(node, ids, known, np.ascontiguousarray(rows.T))
        for s in searchers.values():
            yield from s.found()

    return search


def top_k(rows: DataFrame, queries: Column, k: int = 20, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The k rows with the highest inner product for each row that is a query: query_id, rank, vec_id and score.

    rows has vec_id and vector array<long>; queries tells by vec_id which rows
    are queries too.  Every row but the query's own is a candidate, also one
    with an equal vec_id; rows with equal vec_id that are queries have k rows
    each.  Ties go to the smaller vec_id, null last.  Null vectors and those
    with null components take no part; only vectors of equal length meet, and
    the score of empty ones is 0.  Scores are exact; beyond the range of a
    long they are its ends.

    Queries are dealt to blocks and vectors to shards, whose batches pass each
    block.  In each batch a query's terms are its components: those with the
    highest bounds are essential, their postings are scored for the whole
    batch, and the others are probed while a vector can still reach the k-th
    score so far.  The best k of each shard are merged.
    """
    spark = rows.sparkSession
    good = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    table = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<long>").alias("vector")).filter(good).withColumn("node", F.monotonically_increasing_id()))
    asked = F.coalesce(queries, F.lit(False))
    total, n_queries = table.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    blocks = max(1, -(-n_queries // block))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-total // shard), -(-parallel // blocks))
    own_block, own_shard = F.pmod(F.xxhash64("node"), F.lit(blocks)), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(shards))
    sides = (
        table.filter(asked).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select((own_block * shards + F.col("shard")).alias("cell"), F.lit(0).alias("role"), "node", "vec_id", "vector"),
        table.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select((F.col("block") * shards + own_shard).alias("cell"), F.lit(1).alias("role"), "node", "vec_id", "vector"),
    )
    parts = min(blocks * shards, 20_000)
    cells = sides[0].union(sides[1]).repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "role")
    best = cells.mapInArrow(_search(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
