"""Counts of a text by a finite-state pass over its bytes, and of its distinct words by a table of spans."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import mix, span, sums, texts
from .scratch import fresh

#: Kinds of bytes: white space, capital, symbol, any other byte that begins a code point, and one that continues it.
BLANK, CAPITAL, SYMBOL, OTHER, CONTINUED = range(5)
#: What the pass does between two kinds of bytes, the second of which it reads.
NOTHING, BEGIN, END = range(3)
#: Bytes of a word that are compared eight at a time; longer words are compared whole.
SHORT = 64


def kinds(symbols: str = "#$%&*|") -> np.ndarray:
    """The kind of each byte."""
    table = np.full(256, OTHER, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = BLANK
    table[ord("A") : ord("Z") + 1] = CAPITAL
    table[list(symbols.encode("ascii"))] = SYMBOL
    table[0x80:0xC0] = CONTINUED
    return table


def steps() -> np.ndarray:
    """The action for each kind of the byte before (the state) and of the byte read."""
    table = np.full((5, 5), NOTHING, np.uint8)
    table[BLANK, 1:] = BEGIN
    table[1:, BLANK] = END
    return table


STEPS = steps()


def spans(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each word; kind has the kinds of all texts' bytes."""
    state = np.empty(len(kind), np.uint8)
    state[1:] = kind[:-1]
    starts, stops = offsets[:-1], offsets[1:]
    state[starts[starts < len(kind)]] = BLANK
    action = STEPS[state, kind]
    # Where a text ends within a word, or the next begins right behind it, no blank is read.
    ends = stops[stops > starts]
    ends = ends[kind[ends - 1] != BLANK]
    mark = np.zeros(len(kind) + 1, bool)
    mark[:-1] = action == END
    mark[ends] = True
    return np.flatnonzero(action == BEGIN), np.flatnonzero(mark)


def equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b on, size of each, are the same; data has eight bytes more."""
    same = np.ones(len(a), bool)
    long = np.flatnonzero(size > SHORT)
    for i in long.tolist():
        same[i] = data[a[i] : a[i] + size[i]].tobytes() == data[b[i] : b[i] + size[i]].tobytes()
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    left = np.flatnonzero(size <= SHORT)
    done = 0
    while len(left):
        more = np.minimum(size[left] - done, 8).astype(np.uint64)
        differ = (eights[a[left] + done] ^ eights[b[left] + done]) << ((np.uint64(8) - more) * np.uint64(8))
        same[left[differ != 0]] = False
        done += 8
        left = left[(differ == 0) & (size[left] > done)]
    return same


def distinct(data: np.ndarray, start: np.ndarray, stop: np.ndarray, owner: np.ndarray, texts_: int) -> np.ndarray:
    """How many distinct words each text has, by a table of spans that all words of the batch are put into at once.

    A word's place in the table comes from a hash of its text and its bytes.
    Of the words that find a place free, one takes it; those that find a word
    of the same text with the same bytes there are repeats; the others go on
    to the next place.
    """
    size = stop - start
    bits = max(4, int(2 * len(start)).bit_length())
    table = np.full(1 << bits, -1, np.int64)
    prefix = sums(data[:-8].astype(np.uint64) + np.uint64(1))
    place = (mix(span(prefix, start, stop) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    left, new = np.arange(len(start)), np.zeros(len(start), bool)
    while len(left):
        free = left[table[place[left]] < 0]
        table[place[free]] = free
        holder = table[place[left]]
        new[left[holder == left]] = True
        like = (owner[holder] == owner[left]) & (size[holder] == size[left])
        check = np.flatnonzero(like & (holder != left))
        a, b = left[check], holder[check]
        like[check] = equal(data, start[a], start[b], size[a])
        left = left[~like]
        place[left] = (place[left] + 1) & ((1 << bits) - 1)
    return np.bincount(owner[new], minlength=texts_)


def counted(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """n_words, n_distinct, n_chars, n_capitals and n_symbols of each text."""
    n = len(offsets) - 1
    kind = table[data]
    start, stop = spans(kind, offsets)
    owner = np.searchsorted(offsets, start, "right") - 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))

    return [np.bincount(owner, minlength=n), distinct(padded, start, stop, owner, n), np.diff(offsets) - per_text(kind == CONTINUED), per_text(kind == CAPITAL), per_text(kind == SYMBOL)]


MEASURES = ("n_words", "n_distinct", "n_chars", "n_capitals", "n_symbols")


def measured_texts(docs: DataFrame, text: str = "text", symbols: str = "#$%&*|") -> DataFrame:
    """docs without text, with n_words, n_distinct, n_chars, n_capitals, n_symbols (long) and digest (binary).

    Words are maximal runs of bytes other than white space (tab to carriage
    return, and space), told apart by their bytes.  n_chars counts code
    points, n_capitals A to Z, n_symbols the characters in symbols, which are
    ASCII.  digest is the SHA-256 of the text.  A null text counts as empty.
    Texts of any length are read whole; there is no shuffle, and repeated rows
    stay as they are.  Columns of docs that have the names of new ones are
    dropped for them.
    """
    made = [*MEASURES, "digest"]
    keep = [c for c in docs.columns if c.lower() not in (*made, text.lower())]
    (last,) = fresh(keep, "text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(last))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), *(f"{m} long" for m in MEASURES), "digest binary"])
    table = kinds(symbols)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for _, data, offsets in texts(iter([batch.select([batch.num_columns - 1])])):
                part = batch.slice(done, len(offsets) - 1)
                done += part.num_rows
                body = memoryview(np.ascontiguousarray(data))
                digest = [hashlib.sha256(body[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [pa.array(x.astype(np.int64)) for x in counted(data, offsets, table)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns, pa.array(digest, pa.binary())], [*part.schema.names[:-1], *made])

    return rows.mapInArrow(measure, schema)
