"""SentencePiece encoding through a table of distinct chunks, and decoding."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The library's sign for a space.
MARK = "▁"
#: Entries of the chunk table of a task, and their bytes; beyond either it starts anew.
TABLE, TABLE_BYTES = 300_000, 64 << 20


class ChunkTable(dict):
    """ids of each distinct marked word, as little-endian 32-bit integers.

    A key is a chunk with spaces for marks: a run of marks and all that follows
    up to the next mark.  No piece of the model may have a mark after another
    character, so no merge crosses the end of a chunk and chunks are segmented
    apart; a model without that property is refused.
    """

    def __init__(self, model: str, size: int = TABLE):
        import sentencepiece

        self.sp, self.size = sentencepiece.SentencePieceProcessor(model_file=model), size
        self.held = 0
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross marks")
        probe = "ﬁ é  ①\tA"
        if self.sp.decode(self.sp.encode(probe)) != probe:
            raise ValueError("this model changes texts before it segments them")
        self.alone = np.array([self.sp.piece_to_id(MARK)], "<u4").tobytes()
        self.ends = [np.array([i], "<u4").tobytes() for i in (self.sp.bos_id(), self.sp.eos_id())]

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.size or self.held > TABLE_BYTES:
            self.clear()
            self.held = 0
        # The library puts a mark before each text.
        ids = np.array(self.sp.encode(chunk[1:]), "<u4").tobytes() if len(chunk) > 1 else self.alone
        self[chunk] = ids
        self.held += 4 * len(chunk) + len(ids)
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of text, begin and end included."""
        if not text:
            return b"".join(self.ends)
        words = text.replace(MARK, " ").split(" ")
        if "" in words:
            chunks, marks = [], ""
            for w in words:
                marks += " "
                if w:
                    chunks.append(marks + w)
                    marks = ""
            if marks:
                chunks.append(marks)
        else:
            chunks = [" " + w for w in words]
        return self.ends[0] + b"".join(map(self.__getitem__, chunks)) + self.ends[1]


def encode_decode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", digests: bool = False, table: int = TABLE) -> DataFrame:
    """ids and decoded text of every row of docs, encoded as the library does.

    Returns the columns in keep and ids array<int> and decoded, or with digests
    n_tokens, ids_sha256 and decoded_sha256 in their place.  Each task
    segments each distinct marked word once and joins the ids back by position.
    A null text counts as empty: it has the begin and end ids only.  There is
    no shuffle, and repeated ids or rows stay as they are.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else ", ids array<int>, decoded string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model, table)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, ids_out, text_out = [], [], []
                for value in part.column(part.num_columns - 1):
                    ids = chunks.encode(value.as_py())
                    numbers = np.frombuffer(ids, "<u4").tolist()
                    decoded = chunks.sp.decode(numbers)
                    n.append(len(numbers))
                    ids_out.append(hashlib.sha256(ids).hexdigest() if digests else ids)
                    text_out.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                if digests:
                    made = [pa.array(n, pa.int64()), pa.array(ids_out, pa.string()), pa.array(text_out, pa.string())]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    ends = np.cumsum([0, *n]).astype(np.int32)
                    made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids_out), "<i4"))), pa.array(text_out, pa.string())]
                    names = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*part.schema.names[:-1], *names])

    return rows.mapInArrow(encode, schema)
