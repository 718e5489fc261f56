import base64
import gzip
import hashlib

import pytest

from tellstone.llm import scratch, warc

SCHEMA = "page_id long, url string, html string, digest string"


def expected(rows, least):
    last = {}
    for i, _, h, _ in rows:
        p = (h or "").encode()
        last[p] = max([x for x in (last.get(p), i) if x is not None], default=None)
    out = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        again = len(p) >= least and i != last[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", last[p] if again else None, True))
    return sorted(map(repr, out))


ROWS = [
    (1, "http://a/\r\n x", "hello", "clash"), (2, None, "hello", None), (3, "u", None, None), (4, "u", "", None), (5, "u", "é" * 40000, None),
    (6, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC-Type: x\r\n\r\n0\r\n\r\n", None), (2, None, "hello", None), (None, "u", "hello", None), (None, "u", "lone", None), (7, "u", "é" * 40000, None),
]


@pytest.mark.parametrize("least", [0, 1, 100])
@pytest.mark.parametrize("segment", [50, 32768])
def test_round_trip(spark, least, segment):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    got = warc.round_trip(pages, min_revisit_bytes=least, segment_bytes=segment if least else 32768, chunk_bytes=7 if segment == 50 else 8192, records_per_file=3)
    assert sorted(map(repr, map(tuple, got.collect()))) == expected(ROWS, least)


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(scratch.joined, "__defaults__", (None, 0, 2))
    got = warc.round_trip(spark.createDataFrame(ROWS, SCHEMA))
    assert sorted(map(repr, map(tuple, got.collect()))) == expected(ROWS, 0)


def test_payload_and_damage(spark):
    path = scratch.folder(spark)
    warc.write_warc(spark.createDataFrame(ROWS, SCHEMA), path, segment_bytes=1000)
    segments = warc.read_segments(spark, path)
    kept = {r.page_id: bytes(r.payload) for r in warc.reassemble(segments).collect() if r.record_type == "response" and r.page_id}
    assert kept[7].decode() == "é" * 40000 and kept[4] == b""
    broken = warc.reassemble(segments.filter("segment is null or segment != 3"))
    assert {(r.page_id, r.intact, r.payload_bytes) for r in broken.collect() if r.page_id == 7} == {(7, False, None)}
    cut = warc.reassemble(segments.filter("segments_end is null"))
    assert {r.intact for r in cut.collect() if r.page_id == 7} == {False}


def test_archive_is_plain_warc(tmp_path, spark):
    warc.write_warc(spark.createDataFrame(ROWS[:1], SCHEMA), str(tmp_path / "w"))
    data = b"".join(gzip.open(p).read() for p in (tmp_path / "w").glob("*.gz"))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"5\r\nhello\r\n0\r\n\r\n\r\n\r\n")


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
