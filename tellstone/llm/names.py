"""Names of byte strings, words and windows as 64-bit numbers, for whole batches of texts."""
from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: An odd base of sums modulo 2^64 and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, kept for the next batch."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        _powers[base] = have = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers of BASE; span() names stretches by them."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A name of the values from start to stop, wherever they stand."""
    return mix((prefix[stop] - prefix[start]) * powers(INVERSE, len(prefix))[start] + (stop - start).astype(np.uint64))


def lean() -> None:
    """Give large arrays back to the system when they go, where the C library can be told to."""
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else rises with use
    except (OSError, AttributeError):
        pass


def texts(batches: Iterator[pa.RecordBatch], size: int = 1 << 19) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Batches of about size bytes: the columns before the last, all texts' bytes in one array, and offsets of the texts.

    The last column has the texts, without nulls; those before it have long
    integers without nulls.
    """
    lean()
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        if pa.types.is_large_string(column.type):
            column = column.cast(pa.large_binary())
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        n = len(column)
        if not n:
            continue
        offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield [x[at:to] for x in ids], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def digests(data: bytes | memoryview, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128-bit cryptographic digests of stretches of data, as two unsigned numbers each."""
    each = [blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
    return np.frombuffer(b"".join(each), np.uint64).reshape(-1, 2)


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The words (bytes between white space) of texts: the code of each, the number of its text, all words with a space after each, where each starts there, and the distinct words by code."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), data, np.zeros(1, np.int64), pa.array([], pa.large_binary())
    space = SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    start, stop = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    owner = np.searchsorted(offsets, start, "right") - 1
    length = stop - start
    # Where the words stand without anything between them, and with one space.
    tight, at = np.concatenate([[0], np.cumsum(length)]), np.concatenate([[0], np.cumsum(length + 1)])
    flat = data[~space]
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(tight), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
    spaced = np.full(at[-1], 32, np.uint8)
    spaced[np.arange(len(flat)) + np.repeat(np.arange(len(start)), length)] = flat
    return column.indices.to_numpy(), owner, spaced, at, column.dictionary


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As coded(), with a name for each word in place of its code.

    A name is the first half of the word's digest; each distinct word of the
    batch is digested once.
    """
    codes, owner, spaced, at, known = coded(data, offsets)
    edges = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1] if len(known) else np.zeros(1, np.int64)
    body = memoryview(known.buffers()[2]) if len(known) and known.buffers()[2] is not None else memoryview(b"")
    named = digests(body, edges[:-1], edges[1:])[:, 0] if len(known) else np.zeros(0, np.uint64)
    return named[codes], owner, spaced, at


def least(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The minimum of values[start:stop] for each pair; start < stop."""
    out = np.empty(len(start), values.dtype)
    length = stop - start
    level, width = values, 1
    while len(start):
        mine = np.flatnonzero((length >= width) & (length < 2 * width))
        out[mine] = np.minimum(level[start[mine]], level[stop[mine] - width])
        if width * 2 > length.max():
            return out
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    return out


def bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """The part of n that each key belongs to, evenly even if the keys are the least of many."""
    return ((mix(keys) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
