"""Runs of consecutive words with a period, from Lyndon roots under both orders of the words."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import coded, mix, span, sums, texts
from .scratch import fresh


def lyndon(codes: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word that starts at each place; places of -1, of which the first must be one, part the texts.

    Phase one of Baier's suffix sorter.  Places are grouped by their letter;
    groups are taken from the highest to the lowest, and each place of a group
    points to the nearest place before it that is of a lower group.  Places
    that get the same number of pointers leave their group for a new one right
    above it, the more pointers the higher.  The word that the places of a
    group have in common when the group is taken is their longest Lyndon word.
    """
    real = np.flatnonzero(codes >= 0)
    real = real[np.argsort(codes[real], kind="stable")]
    edges = np.flatnonzero(np.diff(codes[real], prepend=-1))
    first = np.full(len(codes), -1, np.int64)
    first[real] = np.repeat(np.arange(len(edges)), np.diff(edges, append=len(real)))
    group = first.tolist()
    members = [x.tolist() for x in np.split(real, edges[1:])] if len(real) else []
    n = len(members)
    width, lower, higher = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
    # From a place that was taken, some place before it such that all between were taken; else the place itself.
    up, length = list(range(len(codes))), [0] * len(codes)
    taken = n - 1
    while taken >= 0:
        mine = [i for i in members[taken] if group[i] == taken]
        members[taken] = None
        size, pointers = width[taken], {}
        for i in mine:
            length[i] = size
            up[i] = i - 1
        for i in mine:
            j = up[i]
            while up[j] != j:
                up[j] = j = up[up[j]]
            up[i] = j
            if group[j] >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        for times in sorted(set(pointers.values()), reverse=True):
            moved: dict[int, int] = {}
            for j, count in pointers.items():
                if count != times:
                    continue
                old = group[j]
                if old not in moved:
                    moved[old] = new = len(members)
                    members.append([])
                    width.append(width[old] + times * size)
                    above = higher[old]
                    lower.append(old)
                    higher.append(above)
                    lower[above] = higher[old] = new
                group[j] = moved[old]
                members[group[j]].append(j)
        taken = lower[taken]
    return np.array(length)


class Stretches:
    """Exact names of all stretches of 1, 2, 4, ... letters, by which common extensions are found."""

    def __init__(self, codes: np.ndarray, longest: int):
        """longest: letters between two places of -1, at most; these differ from all letters and from each other."""
        parted = np.flatnonzero(codes < 0)
        level = codes.astype(np.int64)
        level[parted] = codes.max(initial=0) + 1 + np.arange(len(parted))
        self.levels, width = [level], 1
        while 2 * width <= longest and len(level) > width:
            level = np.unique(level[:-width] * (int(level.max()) + 1) + level[width:], return_inverse=True)[1].astype(np.int64)
            self.levels.append(level)
            width *= 2

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters are equal from a and b on; a < b."""
        at, apart = b.copy(), b - a
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            inside = np.minimum(at, len(level) - 1)
            at += ((at < len(level)) & (level[inside] == level[np.maximum(inside - apart, 0)])).astype(np.int64) << k
        return at - b

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters are equal before a and b; a < b."""
        at, apart = a.copy(), b - a
        for k in range(len(self.levels) - 1, -1, -1):
            level, start = self.levels[k], at - (1 << k)
            inside = np.maximum(start, 0)
            at -= ((start >= 0) & (level[inside] == level[np.minimum(inside + apart, len(level) - 1)])).astype(np.int64) << k
        return a - at


def runs_between(codes: np.ndarray, longest: int, least: int) -> np.ndarray:
    """Start, stop and period of each run of at least so many letters, in their order of start and period, in texts parted by places of -1.

    Each run has a root that is the longest Lyndon word from its first letter
    on, under the order of the letters or under its reverse.
    """
    letters = int(codes.max(initial=0))
    common, found = Stretches(codes, longest), []
    for order in (codes, np.where(codes < 0, -1, letters - codes)):
        period = lyndon(order)
        root = np.flatnonzero(period)
        period = period[root]
        start = root - common.behind(root, root + period)
        stop = root + period + common.ahead(root, root + period)
        keep = stop - start >= np.maximum(least, 2 * period)
        found.append(np.stack([start[keep], stop[keep], period[keep]], axis=1))
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[np.any(np.diff(found, axis=0, prepend=-1) != 0, axis=1)]


def _pieces(codes: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """Start and stop of the stretches of words outside which no run of at least so many words has any.

    A run of a period q has at least n = ceil(least / 2) words, or all but q, that stand q
    places on once more.  So each of its words is in one of the n-grams that
    its text has twice.
    """
    n = -(-least // 2)
    if len(codes) < least:
        return np.zeros((0, 2), np.int64)
    prefix = sums(mix(codes.astype(np.uint64)))
    start = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    grams = span(prefix, start, start + n) + mix(owner[start].astype(np.uint64))
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(start), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[start[twice]] += 1
    edge[start[twice] + n] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    new_text = np.diff(owner, prepend=-1) != 0
    before = np.concatenate([[False], inside[:-1]]) & ~new_text
    after = np.concatenate([inside[1:] & ~new_text[1:], [False]])
    found = np.stack([np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1], axis=1)
    return found[found[:, 1] - found[:, 0] >= least]


def runs_of(codes: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """Start, stop and period of the runs in texts whose words follow one another; owner has the number of each word's text."""
    pieces = _pieces(codes, owner, least)
    if not len(pieces):
        return np.zeros((0, 3), np.int64)
    size = pieces[:, 1] - pieces[:, 0]
    # A place of -1, then the first piece, and so on.
    new = np.cumsum(size + 1) - size
    back = np.repeat(pieces[:, 0] - new, size)
    at = np.arange(size.sum()) + np.repeat(np.arange(1, len(size) + 1), size)
    joined = np.full(size.sum() + len(size) + 1, -1, np.int64)
    joined[at] = codes[at + back]
    found = runs_between(joined, int(size.max()), least)
    shift = (pieces[:, 0] - new)[np.searchsorted(new, found[:, 0], "right") - 1]
    found[:, :2] += shift[:, None]
    return found



def collapsed(docs: DataFrame, least: int = 12, text: str = "text") -> DataFrame:
    """docs with n_words, runs array<struct<start, length, period>> and collapsed.

    Words are the bytes between white space (tab to carriage return, and
    space).  A run is a stretch of words with smallest period q (words q apart
    are equal), at least max(least, 2 q) long, that no neighbouring word
    extends.  runs are in order of start and period and count words from 0.
    collapsed has all words that no run contains after its first q words, with
    one space between them.  A null or empty text has no words, no runs and an
    empty collapsed.  Each text is worked on whole, in the task that reads it;
    there is no shuffle, and repeated rows stay as they are.  Columns of docs
    that have the names of new ones are dropped for them; text is.
    """
    made = ("n_words", "runs", "collapsed")
    keep = [c for c in docs.columns if c.lower() not in (*made, text.lower())]
    (last,) = fresh(keep, "text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(last))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for _, data, offsets in texts(iter([batch.select([batch.num_columns - 1])])):
                part = batch.slice(done, len(offsets) - 1)
                done += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_found(data, offsets, least)], [*part.schema.names[:-1], *made])

    return rows.mapInArrow(find, schema)


def _found(data: np.ndarray, offsets: np.ndarray, least: int) -> list[pa.Array]:
    codes, owner, spaced, at, _ = coded(data, offsets)
    n = len(offsets) - 1
    words = np.bincount(owner, minlength=n)
    first = np.cumsum(words) - words
    found = runs_of(codes, owner, least)
    start, stop, period = found.T
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, stop, -1)
    kept = np.cumsum(edge[:-1]) == 0
    size = np.diff(at)
    stay = np.repeat(kept, size)
    # No space after the last kept word of a text.
    places = np.flatnonzero(kept)
    last = places[np.diff(owner[places], append=n) != 0]
    stay[at[last + 1] - 1] = False
    length = np.bincount(owner[places], size[places], n).astype(np.int64)
    length[owner[last]] -= 1
    text = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(np.cumsum([0, *length]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(spaced[stay]))])
    mine = owner[start]
    fields = [pa.array(x) for x in (start - first[mine], stop - start, period)]
    ends = np.cumsum([0, *np.bincount(mine, minlength=n)]).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return [pa.array(words), runs, text]
