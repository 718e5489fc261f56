"""Which keys occur in more than one document: a filter of bounded size, made by one shuffle."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .names import bucket, mix

#: Bits of the filter, as powers of two: it grows with the texts up to 128 MB.  Where more keys are
#: shared than it can tell apart, it lets more pass; what passes is verified, so results are the same.
LEAST_BITS, MOST_BITS = 20, 30
#: Bytes of text after which a task sends what it holds.
CHUNK = 16 << 20
LOW = np.uint64((1 << 40) - 1)

PARTS = "bucket int, blob binary"
KINDS = [np.dtype(k) for k in ("u1", "<u2", "<u4", "<u8", "<i8")]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers or long integers, with six bytes before each."""
    return b"".join(bytes([KINDS.index(a.dtype), a.shape[1] if a.ndim > 1 else 0]) + len(a).to_bytes(4, "little") + a.tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, width, n = KINDS[blob[at]], blob[at + 1], int.from_bytes(blob[at + 2 : at + 6], "little")
        size = n * max(1, width)
        a = np.frombuffer(blob, kind, size, at + 6)
        out.append(a.reshape(n, width) if width else a)
        at += 6 + size * kind.itemsize
    return out


def small(x: np.ndarray) -> np.ndarray:
    """x in as few bytes as its largest number needs."""
    top = int(x.max()) if len(x) else 0
    return x.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def parts(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])


def by_bucket(which: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has rows, and the rows, in their order."""
    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


def filter_bits(size: int) -> int:
    """Bits, as a power of two, of a filter for texts of size bytes: one for each eight of them."""
    return min(MOST_BITS, max(LEAST_BITS, (size // 8).bit_length()))


def shared_filter(docs: DataFrame, keys: Callable, n: int, bits: int) -> np.ndarray:
    """A bit for each of 2^bits places, set where a key there occurs more than once.

    keys maps the batches of docs to pairs (keys, marks) of a chunk, keys
    without repeats, marks true for those that the chunk has more than once.
    Keys are sent to n buckets in 40 bits and those of the bucket.
    """
    size = max(8, (1 << bits) // n // 8 * 8)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, marks in keys(batches):
            where = bucket(found, n)
            rows = []
            for b, mine in by_bucket(where, n):
                low = found[mine] & LOW
                rows.append((b, pack((low & np.uint64(0xFFFFFFFF)).astype("<u4"), (low >> np.uint64(32)).astype("u1"), np.packbits(marks[mine]))))
            yield parts(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high, marks = unpack(blob)
                held.setdefault(b, []).append((low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), np.unpackbits(marks, count=len(low)).astype(bool)))
        for b, got in held.items():
            all_keys = np.concatenate([g[0] for g in got])
            marked = np.concatenate([g[0][g[1]] for g in got])
            all_keys.sort()
            twice = np.concatenate([all_keys[1:][all_keys[1:] == all_keys[:-1]], marked])
            slots = np.zeros(size, bool)
            slots[twice % np.uint64(size)] = True
            yield parts([(b, zlib.compress(np.packbits(slots, bitorder="little").tobytes(), 1))])

    out = np.zeros((n, size // 8), np.uint8)
    # The slices of the filter have 2^bits bits in all, whatever the input is.
    for b, blob in docs.mapInArrow(send, PARTS).repartitionById(n, "bucket").mapInArrow(meet, PARTS).toLocalIterator(prefetchPartitions=True):
        out[b] = np.frombuffer(zlib.decompress(blob), np.uint8)
    return out


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through."""
    n, size = table.shape
    slot = (keys & LOW) % np.uint64(size * 8)
    place = bucket(keys, n) * np.uint64(size) + (slot >> np.uint64(3))
    return (table.reshape(-1)[place] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


SENT = "bucket int, settled boolean, blob binary"
FOUND = "_id long, _hash long, _places binary"


def sent(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["bucket", "settled", "blob"])


def settled(ids: np.ndarray, hashes: np.ndarray, row: np.ndarray, values: np.ndarray, n: int) -> list[tuple[int, bool, bytes]]:
    """values (a row of 32-bit numbers for each of row), packed for the n buckets of the texts they belong to."""
    used, local = np.unique(row, return_inverse=True)
    out = []
    for b, mine in by_bucket((mix(ids[used].view(np.uint64)) % np.uint64(n))[local], n):
        mine = mine[np.argsort(local[mine], kind="stable")]
        texts, count = np.unique(local[mine], return_counts=True)
        out.append((b, True, pack(ids[used[texts]], hashes[used[texts]], small(count), values[mine].astype("<u4"))))
    return out


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text of the bucket, with all its values."""
    got = [unpack(x) for batch in batches for x in batch.column(2).to_pylist()]
    if not got:
        return
    ids, hashes, count = (np.concatenate([g[i] for g in got]).astype(np.int64) for i in range(3))
    values = np.concatenate([g[3] for g in got])
    del got
    order = np.lexsort((hashes, ids))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    values = values[np.argsort(np.repeat(rank, count), kind="stable")]
    ids, hashes, stop = ids[order], hashes[order], np.cumsum(count[order])
    last = np.ones(len(ids), bool)
    last[:-1] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    ids, hashes, stop = ids[last], hashes[last], stop[last]
    start = np.concatenate([[0], stop[:-1]])
    for k in range(0, len(ids), 10_000):
        places = [values[a:b].tobytes() for a, b in zip(start[k : k + 10_000].tolist(), stop[k : k + 10_000].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 10_000]), pa.array(hashes[k : k + 10_000]), pa.array(places, pa.binary())], ["_id", "_hash", "_places"])


def by_text(docs: DataFrame, send: Callable, meet: Callable, n: int) -> DataFrame:
    """_id, _hash and all _places of each text: what send settles, and what meet finds in the buckets of the rest."""
    return docs.mapInArrow(send, SENT).repartitionById(n, "bucket").mapInArrow(meet, SENT).repartitionById(n, "bucket").mapInArrow(gather, FOUND)
