"""Token counts of the sections of documents, from one encoding of the whole text."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "majority", "split")


def encoder(ranks_file: str, pattern: str):
    """The encoding of a rank file and the length in bytes of each token."""
    import base64

    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


#: White space of the pattern's kind; a run of more than LONG such characters is cut out before the pattern sees it.
SPACES, LONG = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000", 10_000
SPACE_RULES = r"\s+(?!\S)|\s+"


def tokens_of(encoding, text: str) -> np.ndarray:
    """All tokens of text, also where it has more white space in a row than the pattern's engine bears.

    Between such a run and what follows, the pattern's last rules part all but
    one character of the run from the rest.  Patterns without those rules
    aren't cut.
    """
    cuts = [m.span() for m in re.finditer(f"[{SPACES}]{{{LONG},}}", text)] if encoding._pat_str.endswith(SPACE_RULES) and "\\r" not in encoding._pat_str else []
    if not cuts:
        return encoding.encode_to_numpy(text, disallowed_special=())
    out, at = [], 0
    for start, stop in cuts:
        stop -= stop < len(text)
        out += [encoding.encode_to_numpy(text[at:start], disallowed_special=()), np.array(encoding._encode_single_piece(text[start:stop].encode()), np.uint32)]
        at = stop
    return np.concatenate([*out, encoding.encode_to_numpy(text[at:], disallowed_special=())])


def attribute(sizes: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross an end of a section.

    sizes: bytes of the tokens in order; ends: rising ends of the sections in
    bytes, the last at the end of the text.  rule: a crossing token goes to the
    section of its first byte (start), of its last byte (end), to the section
    with most of its bytes, of equal ones the first (majority), or to each by
    its share of the bytes (split).
    """
    if not len(ends):
        return np.zeros(0), 0
    stop = np.cumsum(sizes)
    start = stop - sizes
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop - 1, "right")
    crossing = np.flatnonzero(first != last)
    if rule == "end":
        return np.bincount(last, minlength=len(ends)).astype(float), len(crossing)
    out = np.bincount(first, minlength=len(ends)).astype(float)
    if rule != "start":
        edges = np.concatenate([[0], ends])
        for t in crossing.tolist():
            a, b = int(first[t]), int(last[t])
            share = np.minimum(stop[t], edges[a + 1 : b + 2]) - np.maximum(start[t], edges[a : b + 1])
            out[a] -= 1
            if rule == "majority":
                out[a + int(np.argmax(share))] += 1
            else:
                out[a : b + 1] += share / sizes[t]
    return out, len(crossing)


def token_counts(docs: DataFrame, ranks_file: str, pattern: str, section_end: str = "\n", rule: str = "majority", sections: str | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Tokens of each section of every row of docs, the text encoded once as a whole.

    Sections end after each section_end (empty sections between two of them
    hold the sign itself), or sections names a column array<int> of rising
    section ends in characters, to which the end of the text is added.  Token
    spans come from the bytes of the tokens.  The rows are returned with the
    columns in keep, n_tokens, n_sections, section_tokens array<double> and
    n_crossing.  A null or empty text has no token and no section.  There is no
    shuffle; repeated ids and rows stay as they are.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    ends_of = F.col(sections).cast("array<int>") if sections else F.lit(None).cast("array<int>")
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), ends_of.alias("_ends"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-2])
    schema += ", n_tokens long, n_sections int, section_tokens array<double>, n_crossing int"
    sign = section_end.encode()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = encoder(ranks_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                k = part.num_columns - 2
                made = [[], [], [], []]
                for value, given in zip(part.column(k), part.column(k + 1), strict=True):
                    whole = value.as_py()
                    raw = whole.encode()
                    if sections and given.is_valid:
                        cuts = sorted({min(max(0, c), len(whole)) for c in given.as_py() if c is not None})
                        ends = np.cumsum([len(whole[a:b].encode()) for a, b in zip([0, *cuts], cuts, strict=False)]).tolist()
                    else:
                        ends, found = [], raw.find(sign)
                        while found >= 0:
                            ends.append(found + len(sign))
                            found = raw.find(sign, found + len(sign))
                    ends = np.array(sorted({*ends, len(raw)} - {0}), np.int64)
                    tokens = tokens_of(encoding, whole)
                    share, crossing = attribute(lengths[tokens], ends, rule)
                    for column, x in zip(made, (len(tokens), len(ends), share.tolist(), crossing), strict=True):
                        column.append(x)
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.int32()]
                arrays = [pa.array(c, t) for c, t in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(k)), *arrays], [*part.schema.names[:k], "n_tokens", "n_sections", "section_tokens", "n_crossing"])

    return rows.mapInArrow(count, schema)
