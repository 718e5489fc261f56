"""Repeated byte strings, within and across documents, found by sorting sampled suffixes.

Of the suffixes of all texts, those are sampled that start with the least
K-byte gram of some window of N bytes: all occurrences of a window have the
same sampled suffix in them, at the same offset.  A first shuffle tells the
grams that occur more than once; suffixes that start with one of them are then
brought together with what precedes them and ordered by deep-shallow sorting
of what follows the gram.  Common prefixes of neighbours in that order, and in the order of the reversed
left contexts, tell which windows are equal.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import bucket, digests, lean, span, sums, texts
from .recompression import _rows, with_places
from .scratch import buckets
from .shared import CHUNK, by_bucket, by_text, filter_bits, pack, passes, sent, settled, shared_filter, small, unpack

#: Bytes of the gram that a sampled suffix starts with.
GRAM = 32
#: Suffixes that a task sorts at once; those of one gram stay together.
SLICE = 30_000
#: Super-characters of eight bytes, after the gram, up to which quicksort goes.
SHALLOW = 4
#: Window starts of a long text that are worked on at once.
PIECE = 4 << 20


def _prefix(data: np.ndarray) -> np.ndarray:
    return sums(data.astype(np.uint64) + np.uint64(1))


def key_runs(prefix: np.ndarray, offsets: np.ndarray, n: int, gram: int) -> tuple[np.ndarray, ...]:
    """Names of all grams; first and one past the last start of each run of windows of a text with one least gram; that gram's name."""
    none = np.zeros(0, np.int64)
    size = len(prefix) - 1
    if size < n:
        return np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64)
    at = np.arange(size - gram + 1)
    grams = span(prefix, at, at + gram)
    width, low = n - gram + 1, grams
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: step - width], low[width - step :])
    edge = np.zeros(size + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= n)
    edge[offsets[long]] += 1
    edge[offsets[long + 1] - n + 1] -= 1
    valid = np.cumsum(edge[: len(low)]) > 0
    new = valid.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    new[offsets[long]] = True
    start = np.flatnonzero(new)
    over = new | ~valid
    breaks = np.append(np.flatnonzero(over), len(low))
    stop = breaks[np.searchsorted(breaks, start, "right")]
    return grams, start, stop, low[start]


def suffix_groups(grams: np.ndarray, start: np.ndarray, stop: np.ndarray, key: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Sampled suffixes: number of the run, place of the suffix, first and last window start whose first least gram it is."""
    runs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    short = np.flatnonzero(stop - start <= width)
    columns = np.arange(2 * width - 1)
    for k in range(0, len(short), 4096):
        mine = short[k : k + 4096]
        where = start[mine][:, None] + columns
        inside = columns < (stop - start)[mine][:, None] + width - 1
        same = (grams[np.minimum(where, len(grams) - 1)] == key[mine][:, None]) & inside
        r, c = np.nonzero(same)
        runs.append(mine[r])
        places.append(start[mine][r] + c)
    for r in np.flatnonzero(stop - start > width).tolist():
        found = start[r] + np.flatnonzero(grams[start[r] : stop[r] + width - 1] == key[r])
        runs.append(np.full(len(found), r))
        places.append(found)
    run, place = np.concatenate(runs), np.concatenate(places)
    order = np.lexsort((place, run))
    run, place = run[order], place[order]
    first = start[run]
    again = np.flatnonzero(run[1:] == run[:-1]) + 1
    first[again] = np.maximum(first[again], place[again - 1] + 1)
    last = np.minimum(place, stop[run] - 1)
    good = first <= last
    return run[good], place[good], first[good], last[good]


def slices(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of all stretches, one after another."""
    total = np.cumsum(length)
    return data[np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + length, length)]


def pieces(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A batch of texts as it is, or one long text in pieces that share n - 1 bytes, and where each begins."""
    if len(offsets) > 2 or len(data) <= PIECE + n:
        yield data, offsets, 0
        return
    for at in range(0, len(data) - n + 1, PIECE):
        part = data[at : at + PIECE + n - 1]
        yield part, np.array([0, len(part)], np.int64), at


def deep_shallow(chars: np.ndarray, group: np.ndarray, shallow: int = SHALLOW, splits: dict[str, int] | None = None) -> np.ndarray:
    """An order of the rows by group, then by chars (columns of super-characters).

    Down to column shallow, open segments are ordered by multikey quicksort:
    each is parted in three by a pivot, its middle row's character; the equal
    part goes on with the next column, the others stay at this one.  All
    segments take their steps at once.  Those that are equal down to there go
    through blind tries: each skips the columns in which its members agree
    and splits at the first one that branches.  Rows equal in all columns
    keep their order.  splits counts the segments parted by each phase.
    """
    order = np.argsort(group, kind="stable")
    if not len(order):
        return order
    counted = {"quicksort": 0, "tries": 0} if splits is None else splits
    shallow = min(shallow, chars.shape[1])
    starts = np.ones(len(order), bool)
    starts[1:] = group[order][1:] != group[order][:-1]
    depth = np.zeros(len(order), np.int64)

    def open_places() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in segments of several rows, where these begin among them, and their sizes."""
        head = np.flatnonzero(starts)
        size = np.diff(head, append=len(starts))
        live = (size > 1) & (depth[head] < chars.shape[1])
        head, size = head[live], size[live]
        first = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(head - first, size), first, size

    while True:
        at, first, size = open_places()
        mine = np.repeat(depth[at[first]] < shallow, size) if len(at) else np.zeros(0, bool)
        if not mine.any():
            break
        segment = np.repeat(np.arange(len(size)), size)[mine]
        pivot = chars[order[at[first + size // 2]], np.minimum(depth[at[first]], shallow - 1)][segment]
        at = at[mine]
        value = chars[order[at], depth[at]]
        side = (value > pivot).astype(np.int64) - (value < pivot) + 1
        by = np.argsort(3 * segment + side, kind="stable")
        order[at], side = order[at][by], side[by]
        depth[at] += side == 1
        new = np.flatnonzero((side[1:] != side[:-1]) & (segment[1:] == segment[:-1])) + 1
        starts[at[new]] = True
        counted["quicksort"] += len(new)
    while True:
        at, first, size = open_places()
        if not len(at):
            return order
        differs = chars[order[at]] != np.repeat(chars[order[at[first]]], size, axis=0)
        branch = np.logical_or.reduceat(differs, first, axis=0)
        some = branch.any(axis=1)
        column = np.where(some, np.argmax(branch, axis=1), chars.shape[1])
        depth[at] = np.repeat(column, size)  # at the end, where a segment's rows are equal
        live, segment = np.repeat(some, size), np.repeat(np.arange(len(size)), size)
        at, segment = at[live], segment[live]
        value = chars[order[at], depth[at]]
        by = np.lexsort((value, segment))
        order[at], value = order[at][by], value[by]
        new = np.flatnonzero((value[1:] != value[:-1]) & (segment[1:] == segment[:-1])) + 1
        starts[at[new]] = True
        counted["tries"] += len(new)


def common(chars: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common bytes of each row in the order and the one before it; -1 across groups."""
    out = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        a, b = chars[order[:-1]], chars[order[1:]]
        differs = a != b
        column = np.argmax(differs, axis=1)
        some = differs[np.arange(len(a)), column]
        x = (a ^ b)[np.arange(len(a)), column]
        inside = sum((x >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(8))
        same = group[order[1:]] == group[order[:-1]]
        out[1:] = np.where(same, np.where(some, 8 * column + inside, 8 * chars.shape[1]), -1)
    return out


def _chars(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """length bytes from start on (or before it, backwards), as big-endian super-characters, zeros after them."""
    out = np.zeros((len(start), -(-width // 8) * 8), np.uint8)
    columns = np.arange(width)
    for k in range(0, len(start), 16384):
        inside = columns < length[k : k + 16384, None]
        where = start[k : k + 16384, None] + (-1 - columns if back else columns)
        out[k : k + 16384, :width] = np.where(inside, data[np.clip(where, 0, max(0, len(data) - 1))], 0)
    return out.view(">u8").astype(np.uint64)


def repeated(key: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, ids: np.ndarray, hashes: np.ndarray, context: np.ndarray, at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which windows occur earlier: a row for each suffix, a column for each offset of the suffix in the window.

    All is decided by the bytes; rows of different keys may be in one call.
    Places are in bytes of the text; context has the bytes from first[i] to
    last[i] + n at at[i].
    """
    rank = np.lexsort((place, hashes, ids))
    key, place, first, last, ids, hashes, at = (x[rank] for x in (key, place, first, last, ids, hashes, at))
    left, right, gram = place - first, last + n - place, n - width + 1
    # Keys are names of grams; groups are of the grams' bytes.  What follows them is sorted.
    chars = _chars(context, at + left, np.full(len(at), gram), gram)
    by = np.lexsort(chars.T[::-1])
    new = np.ones(len(by), bool)
    new[1:] = (chars[by][1:] != chars[by][:-1]).any(axis=1)
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(new)
    chars = _chars(context, at + left + gram, right - gram, max(1, n - gram))
    order = deep_shallow(chars, group)
    shared_right = common(chars, order, group)
    shared_right = np.where(shared_right < 0, -1, shared_right + gram)
    right_rank = np.empty(len(order), np.int64)
    right_rank[order] = np.arange(len(order))
    chars = _chars(context, at + left, left, width, back=True)
    order = deep_shallow(chars, group)
    shared_left = common(chars, order, group)
    left_rank = np.empty(len(order), np.int64)
    left_rank[order] = np.arange(len(order))
    del chars
    out = np.zeros((len(key), width), bool)
    for o in range(width):
        mine = np.flatnonzero((left >= o) & (place - last <= o))
        if len(mine) < 2:
            continue
        kind = (np.cumsum(shared_right < n - o)[right_rank[mine]] << 32) | np.cumsum(shared_left < o)[left_rank[mine]]
        by = np.argsort(kind, kind="stable")
        kind, mine = kind[by], mine[by]
        new = np.concatenate([[True], kind[1:] != kind[:-1]])
        lead = ids[mine[np.flatnonzero(new)]][np.cumsum(new) - 1]
        again = np.zeros(len(mine), bool)
        a, b = mine[:-1], mine[1:]
        again[1:] = ~new[1:] & (ids[a] == ids[b]) & (hashes[a] == hashes[b]) & (place[a] < place[b])
        # Of rows with the same place, only the first sees the one before that place.
        level = np.flatnonzero(~new[1:] & (ids[a] == ids[b]) & (hashes[a] == hashes[b]) & (place[a] == place[b])) + 1
        for x in level.tolist():
            again[x] = again[x - 1]
        out[rank[mine[again | (ids[mine] > lead)]], o] = True
    return out


def merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and intervals, with those of a row that touch or overlap made one."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    if not len(row):
        return row, np.zeros((0, 2), np.int64)
    # Rows are set far apart, so that a running maximum doesn't cross them.
    far = (np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))) * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + far)
    gap = np.flatnonzero((start + far)[1:] > reach[:-1])
    first, last = np.append(0, gap + 1), np.append(gap, len(row) - 1)
    return row[first], np.stack([start[first], (reach - far)[last]], 1)


def stretches(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the union of intervals, and where each interval is in it."""
    order = np.argsort(start, kind="stable")
    reach = np.maximum.accumulate((start + length)[order])
    new = np.ones(len(order), bool)
    new[1:] = start[order][1:] > reach[:-1]
    head = np.flatnonzero(new)
    first, size = start[order][head], reach[np.append(head[1:], len(order)) - 1] - start[order][head]
    at = np.empty(len(order), np.int64)
    which = np.cumsum(new) - 1
    at[order] = start[order] - first[which] + (np.cumsum(size) - size)[which]
    return first, size, at


def _places(docs: DataFrame, n: int, text: str, bits: int | None, gram: int) -> DataFrame:
    """_id, _hash and the byte intervals to be removed."""
    spark = docs.sparkSession
    rows, width = _rows(docs, text), n - gram + 1
    size_of_all = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = buckets(spark, 2 * size_of_all)
    bits = filter_bits(size_of_all) if bits is None else bits

    def keys(batches: Iterator[pa.RecordBatch]):
        def chunk():
            found, twice = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(found)
            found, twice = found[order], twice[order]
            first = np.ones(len(found), bool)
            first[1:] = found[1:] != found[:-1]
            return found[first], np.logical_or.reduceat(twice | ~first, np.flatnonzero(first)) if len(found) else twice

        held, size = [], 0
        for _, whole, bounds in texts(batches):
            for data, offsets, _ in pieces(whole, bounds, n):
                grams, start, stop, key = key_runs(_prefix(data), offsets, n, gram)
                run, _, _, _ = suffix_groups(grams, start, stop, key, width)
                held.append((key, np.bincount(run, minlength=len(key)) > 1))
                size += len(data)
                if size > CHUNK:
                    yield chunk()
                    held, size = [], 0
        if held:
            yield chunk()

    table = spark.sparkContext.broadcast(shared_filter(rows, keys, parts, bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1)

        def chunk():
            key, row, place, first, last, length, source = (np.concatenate([h[i] for h in held]) for i in range(7))
            name, bytes_of = np.concatenate([h[7] for h in held]), np.concatenate(pool)
            ids, hashes = np.concatenate([k[0] for k in known]), np.concatenate([k[1] for k in known])
            # Suffixes with the same windows around them, by their bytes' digests: those after the first are settled here.
            order = np.lexsort((place, hashes[row], ids[row], place - first, name[:, 1], name[:, 0]))
            same = lambda x: x[order][1:] == x[order][:-1]
            new = np.ones(len(key), bool)
            new[1:] = ~(same(name[:, 0]) & same(name[:, 1]) & same(length) & same(place - first))
            lead = ids[row[order[np.flatnonzero(new)]]][np.cumsum(new) - 1] if len(key) else ids[:0]
            later = ids[row[order]] > lead
            later[1:] |= ~new[1:] & same(ids[row]) & same(hashes[row]) & (place[order][1:] > place[order][:-1])
            gone = order[later]
            out = settled(ids, hashes, *merged(row[gone], first[gone], last[gone] + n), parts)
            mine = order[~later]
            for b, part in by_bucket(bucket(key[mine], parts), parts):
                part = mine[part]
                used, local = np.unique(row[part], return_inverse=True)
                from_, size_, at = stretches(source[part], length[part])  # what contexts share is sent once
                packed = squeeze.compress(slices(bytes_of, from_, size_).tobytes())
                out.append((b, False, pack(key[part], small(local), ids[used], hashes[used], small(first[part]), small((place - first)[part]), small((last - first)[part]), small(at), np.frombuffer(packed, np.uint8))))
            return sent(out)

        held, pool, known, size, done, filled = [], [], [], 0, 0, 0
        for ids, whole, bounds in texts(batches):
            known.append(ids)
            for data, offsets, begin in pieces(whole, bounds, n):
                grams, start, stop, key = key_runs(_prefix(data), offsets, n, gram)
                live = passes(table.value, key)
                start, stop, key = start[live], stop[live], key[live]
                run, place, first, last = suffix_groups(grams, start, stop, key, width)
                row = np.searchsorted(offsets, first, "right") - 1
                base = offsets[row] - begin
                name = digests(memoryview(data), first, last + n)
                held.append((key[run], row + done, place - base, first - base, last - base, last + n - first, first + filled, name))
                pool.append(data)
                filled, size = filled + len(data), size + len(data)
                if size > CHUNK and len(ids[0]) == 1:
                    yield chunk()
                    held, pool, known, size, done, filled = [], [], [ids], 0, 0, 0
            done += len(ids[0])
            if size > CHUNK:
                yield chunk()
                held, pool, known, size, done, filled = [], [], [], 0, 0, 0
        if held:
            yield chunk()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        got = []
        for batch in batches:
            done = batch.column(1)
            yield batch.filter(done)
            got += [unpack(x) for x in batch.filter(pc.invert(done)).column(2).to_pylist()]
        if not got:
            return
        base = np.cumsum([0] + [len(g[2]) for g in got])
        ids, hashes = np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got])
        key = np.concatenate([g[0] for g in got])
        row = np.concatenate([g[1].astype(np.int64) + b for g, b in zip(got, base, strict=False)])
        first, left, more = (np.concatenate([g[i].astype(np.int64) for g in got]) for i in (4, 5, 6))
        zstd = zstandard.ZstdDecompressor()
        sizes = [zstandard.frame_content_size(g[8].tobytes()) for g in got]
        at = np.concatenate([g[7].astype(np.int64) + b for g, b in zip(got, np.cumsum([0, *sizes]), strict=False)])
        context, filled = np.empty(sum(sizes), np.uint8), 0
        while got:
            piece = zstd.decompress(got.pop(0)[8].tobytes())
            context[filled : filled + len(piece)] = np.frombuffer(piece, np.uint8)
            filled += len(piece)
        _, kind, size = np.unique(key, return_inverse=True, return_counts=True)
        mine = np.flatnonzero(size[kind] > 1)
        key, row, first, left, more, at = (x[mine] for x in (key, row, first, left, more, at))
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
        rows_found, spans, start = [], [], 0
        while start < len(key):
            stop = int(edges[min(np.searchsorted(edges, start + SLICE, "left"), len(edges) - 1)])
            mine = order[start:stop]
            again = repeated(key[mine], (first + left)[mine], first[mine], (first + more)[mine], ids[row[mine]], hashes[row[mine]], context, at[mine], n, width)
            # Runs of offsets become intervals of bytes.
            edge = np.zeros((len(mine), width + 2), np.int8)
            edge[:, 1:-1] = again
            edge = np.diff(edge, axis=1)
            r, o_first = np.nonzero(edge == 1)
            _, o_stop = np.nonzero(edge == -1)
            place = (first + left)[mine][r]
            found, intervals = merged(row[mine][r], place - o_stop + 1, place - o_first + n)
            rows_found.append(found)
            spans.append(intervals)
            start = stop
        spans = np.concatenate(spans)
        yield sent(settled(ids, hashes, *merged(np.concatenate(rows_found), spans[:, 0], spans[:, 1]), parts))

    return by_text(rows, send, meet, parts)


def removed(places: bytes, size: int) -> np.ndarray:
    """Which bytes of a text of this size the intervals cover."""
    edge = np.zeros(size + 1, np.int32)
    pairs = np.frombuffer(places, "<u4").reshape(-1, 2)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: DataFrame, n: int = 100, text: str = "text", bits: int | None = None, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs.

    Texts are their UTF-8 bytes.  A byte is removed if n bytes of its text
    that cover it also start in a row with a smaller doc_id, or earlier in the
    same text.  n_spans counts maximal removed runs.  Rows with equal doc_id
    don't remove from each other; null ids come last; a null text is empty.
    Other columns are not used.
    """
    rows, _ = with_places(docs.select("doc_id", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")), _places(docs, n, text, bits, gram), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[], [], [], []]
            for value, places in zip(batch.column(1), batch.column(2), strict=True):
                data = value.as_py().encode()
                total, gone, spans = len(data), 0, 0
                if places.is_valid:
                    cut = removed(places.as_py(), total)
                    gone, spans = int(cut.sum()), int(np.count_nonzero(np.diff(cut.astype(np.int8), prepend=0) == 1))
                    data = np.frombuffer(data, np.uint8)[~cut].tobytes()
                for column, x in zip(made, (total, gone, spans, hashlib.sha256(data).hexdigest()), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
