"""Repeated passages of words across documents, found by recompression.

A round of recompression names maximal runs of equal symbols, then splits all
symbols into two sides by their names and names each pair of a left symbol and
a right one that follows it.  What a stretch of a window is named depends on
the symbols next to it only, so all occurrences of a window have the same
symbols but for a few at its ends.  A word's name comes from its cryptographic
digest, that of a run or pair from the names in it, so equal strings get equal
names in every task and a round needs no dictionary.

A window's key is the least name of a few consecutive symbols inside it, at the
highest level where it holds that many.  A first shuffle tells the keys that
more than one document has; windows with such keys are then compared in a
second shuffle, by 128-bit cryptographic digests (BLAKE2b) of their words, so
that what names of 64 bits have in common by chance or design decides nothing.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import bucket, digests, least, mix, span, sums, texts, words
from .scratch import buckets, fresh, joined
from .shared import CHUNK, by_bucket, by_text, filter_bits, pack, passes, sent, settled, shared_filter, small, unpack

#: Rows without an id come after all others.
LAST = (1 << 63) - 1
GRAM = 4


def _round(symbols: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """The next level's symbols and their texts; low and high bound what each window surely holds."""
    first = np.ones(len(symbols), bool)
    first[1:] = (symbols[1:] != symbols[:-1]) | (text[1:] != text[:-1])
    run_of = np.cumsum(first) - 1
    start = np.flatnonzero(first)
    length = np.diff(start, append=len(symbols)).astype(np.uint64)
    runs, text = symbols[start], text[start]
    runs = np.where(length > 1, mix(runs + length * np.uint64(0xD6E8FEB86659FD93)), runs)
    # The runs at both ends of a window may go on outside it.
    some = low < high
    low, high = np.where(some, run_of[low] + 1, 0), np.where(some, run_of[high - 1], 0)
    left = mix(runs ^ np.uint64(0xA0761D6478BD642F + level)) & np.uint64(1) == 0
    pair = np.zeros(len(runs), bool)
    pair[:-1] = left[:-1] & ~left[1:] & (text[:-1] == text[1:])
    # A right symbol at the start may pair with one outside, as may a left one at the end.
    some = low < high
    edge = len(runs) - 1
    low, high = low + (some & ~left[np.minimum(low, edge)]), high - (some & left[np.maximum(high - 1, 0)])
    head = np.ones(len(runs), bool)
    head[1:] = ~pair[:-1]
    index = np.append(np.cumsum(head) - 1, np.count_nonzero(head))
    start = np.flatnonzero(head)
    named = np.where(pair[start], mix(runs[start] * np.uint64(0xE7037ED1A0B428DB) + runs[np.minimum(start + 1, edge)]), runs[start])
    some = low < high
    return named, text[start], np.where(some, index[low], 0), np.where(some, index[high], 0)


def window_keys(symbols: np.ndarray, text: np.ndarray, n: int, rounds: int = 1, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of n words within a text, and the key of each."""
    start = np.arange(max(0, len(symbols) - n + 1))
    start = start[text[start] == text[start + n - 1]] if len(start) else start
    keys = np.zeros(len(start), np.uint64)
    if not len(start):
        return start, keys
    low, high, gram = start, start + n, min(gram, n)
    for level in range(rounds + 1):
        mine = np.flatnonzero(high - low >= gram)
        if len(mine):
            at = np.arange(len(symbols) - gram + 1)
            grams = span(sums(symbols), at, at + gram) ^ np.uint64(level)
            keys[mine] = least(grams, low[mine], high[mine] - gram + 1)
        if level < rounds:
            symbols, text, low, high = _round(symbols, text, low, high, level)
    return start, keys


def _rows(docs: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64(whole).alias("_hash"), whole.cast("binary").alias("_text"))


def _places(docs: DataFrame, n: int, rounds: int, text: str, bits: int | None) -> DataFrame:
    """_id, _hash and the starts of windows that also start in a row with a smaller id."""
    spark = docs.sparkSession
    rows = _rows(docs, text)
    size_of_all = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = buckets(spark, 2 * size_of_all)
    bits = filter_bits(size_of_all) if bits is None else bits

    def keys(batches: Iterator[pa.RecordBatch]):
        def chunk():
            found, row = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.lexsort((row, found))
            found, row = found[order], row[order]
            first = np.ones(len(found), bool)
            first[1:] = found[1:] != found[:-1]
            other = np.zeros(len(found), bool)
            other[1:] = ~first[1:] & (row[1:] != row[:-1])
            return found[first], np.logical_or.reduceat(other, np.flatnonzero(first)) if len(found) else other

        held, size, done = [], 0, 0
        for ids, data, offsets in texts(batches):
            symbols, owner, _, _ = words(data, offsets)
            start, found = window_keys(symbols, owner, n, rounds)
            row = owner[start] + done
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            held.append((found[new], row[new]))
            done, size = done + len(ids[0]), size + len(data)
            if size > CHUNK:
                yield chunk()
                held, size = [], 0
        if held:
            yield chunk()

    table = spark.sparkContext.broadcast(shared_filter(rows, keys, parts, bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk():
            key, row, at = (np.concatenate([h[i] for h in held]) for i in range(3))
            name = np.concatenate([h[3] for h in held])
            ids, hashes = np.concatenate([r[0] for r in known]), np.concatenate([r[1] for r in known])
            # Equal windows have equal names, and so equal keys.
            later = after_first(name, ids[row])
            out = settled(ids, hashes, row[later], at[later], parts)
            key, row, at, name = key[~later], row[~later], at[~later], name[~later]
            order = np.lexsort((at, row))
            key, row, at, name = key[order], row[order], at[order], name[order]
            for b, mine in by_bucket(bucket(key, parts), parts):
                k, r, a = key[mine], row[mine], at[mine]
                head = np.ones(len(k), bool)
                head[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1]) | (a[1:] != a[:-1] + 1)
                head = np.flatnonzero(head)
                count = np.diff(head, append=len(k))
                used, local = np.unique(r[head], return_inverse=True)
                out.append((b, False, pack(small(a[head]), small(count), small(local), ids[used], hashes[used], name[mine])))
            return sent(out)

        held, known, size, done = [], [], 0, 0
        for ids, data, offsets in texts(batches):
            symbols, owner, spaced, where = words(data, offsets)
            start, found = window_keys(symbols, owner, n, rounds)
            live = passes(table.value, found)
            start, found = start[live], found[live]
            first_word = np.searchsorted(owner, np.arange(len(ids[0])))
            name = digests(memoryview(spaced), where[start], where[start + n] - 1)
            held.append((found, owner[start] + done, start - first_word[owner[start]], name))
            known.append(ids)
            done, size = done + len(ids[0]), size + len(data)
            if size > CHUNK:
                yield chunk()
                held, known, size, done = [], [], 0, 0
        if held:
            yield chunk()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            done = batch.column(1)
            yield batch.filter(done)
            got += [unpack(x) for x in batch.filter(pc.invert(done)).column(2).to_pylist()]
        if not got:
            return
        base = np.cumsum([0] + [len(g[3]) for g in got])
        ids, hashes = np.concatenate([g[3] for g in got]), np.concatenate([g[4] for g in got])
        count = np.concatenate([g[1].astype(np.int64) for g in got])
        row = np.repeat(np.concatenate([g[2].astype(np.int64) + b for g, b in zip(got, base, strict=False)]), count)
        at = np.concatenate([g[0].astype(np.int64) for g in got])
        at = np.repeat(at, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        name = np.concatenate([g[5] for g in got])
        del got
        later = np.flatnonzero(after_first(name, ids[row]))
        yield sent(settled(ids, hashes, row[later], at[later], parts))

    return by_text(rows, send, meet, parts)


def after_first(name: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which rows have a larger id than another with that name (two numbers)."""
    order = np.lexsort((ids, name[:, 1], name[:, 0]))
    mine, name = ids[order], name[order]
    first = np.ones(len(order), bool)
    first[1:] = (name[1:] != name[:-1]).any(axis=1)
    out = np.zeros(len(order), bool)
    if len(order):
        out[order] = mine > mine[np.flatnonzero(first)][np.cumsum(first) - 1]
    return out


def covered(places: bytes, count: int, n: int) -> np.ndarray:
    """Which of count units some window of n covers."""
    edge = np.zeros(count + 1, np.int32)
    start = np.frombuffer(places, "<u4").astype(np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n, -1)
    return np.cumsum(edge[:-1]) > 0


def with_places(docs: DataFrame, places: DataFrame, text: str) -> tuple[DataFrame, str]:
    """Rows of docs with a last column of places, null where nothing is to be removed, and its name, which docs doesn't have."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    i, h, p = fresh(docs.columns, "id", "hash", "places")
    keyed = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), h: F.xxhash64(whole)})
    # Texts and places always meet by a shuffle, whose cost is in proportion at every size.
    return joined(keyed, places.toDF(i, h, p), [i, h], "left", limit=0).select(*[f"`{c}`" for c in docs.columns], p), p


def repeats(docs: DataFrame, n: int = 13, rounds: int = 1, text: str = "text", bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs.

    Words are bytes between white space, unchanged.  A word is removed if a
    window of n words of its text covers it whose words also start in a row
    with a smaller doc_id.  Rows with equal doc_id don't remove from each
    other; null ids come last.  A null text has no words.  Other columns are
    not used.
    """
    rows, _ = with_places(docs.select("doc_id", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")), _places(docs, n, rounds, text, bits), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[], [], []]
            for value, places in zip(batch.column(1), batch.column(2), strict=True):
                w = value.as_py().encode().split()
                total = len(w)
                if places.is_valid:
                    w = list(compress(w, ~covered(places.as_py(), total, n)))
                for column, x in zip(made, (total, total - len(w), hashlib.sha256(b" ".join(w)).hexdigest()), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, n: int = 13, rounds: int = 1, text: str = "text", bits: int | None = None) -> DataFrame:
    """docs with those words removed, all columns and rows kept.

    A text that loses words becomes its other words with single spaces; texts
    that lose none are unchanged, null included.  No name of a column clashes
    with the operator's own.
    """
    rows, _ = with_places(docs, _places(docs, n, rounds, text, bits), text)
    place = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, places in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True):
                value = value.as_py()
                if places.is_valid and value is not None:
                    w = value.encode().split()
                    value = b" ".join(compress(w, ~covered(places.as_py(), len(w), n))).decode()
                out.append(value)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return rows.mapInArrow(cut, docs.schema)
