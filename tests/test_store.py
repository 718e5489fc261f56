import os
import random

import pytest
from pyspark.sql import functions as F

from tellstone.plans import history, ledger
from tellstone.store import Conflict, Store
from tellstone.streaming import growing, live


def read(spark, pattern, out, **more):
    """All lines so far, with the checkpoint of the calls before."""
    return sorted((os.path.basename(r.match_id), r.seq, r.value) for r in live.drain(growing.growing_lines(spark, pattern, **more), out).collect())


def test_growing_files(spark, tmp_path, monkeypatch):
    """Each line once, when it is whole, also after a restart; a file begun anew is read again."""
    monkeypatch.setattr(growing, "BLOCK", 7)
    folder, out = tmp_path / "logs", str(tmp_path / "c")
    folder.mkdir()
    pattern, a = f"{folder}/*.log", folder / "a.log"
    a.write_bytes(b"one\ntwo\r\nhalf")
    (folder / "no.txt").write_text("not this\n")
    assert read(spark, pattern, out) == [("a.log", 0, "one"), ("a.log", 4, "two")]
    with a.open("ab") as f:
        f.write("ä\n\nlast\n".encode())
    (folder / "b.log").write_bytes(b"b \xff\n")
    so_far = [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 9, "halfä"), ("a.log", 16, ""), ("a.log", 17, "last"), ("b.log", 0, "b �")]
    assert read(spark, pattern, out) == so_far
    assert read(spark, pattern, out) == so_far
    a.write_bytes(b"new\n")
    (folder / "b.log").write_bytes(b"another first line of a longer file\nmore\n")
    assert read(spark, pattern, out) == sorted([*so_far, ("a.log", 0, "new"), ("b.log", 0, "another first line of a longer file"), ("b.log", 36, "more")])


def test_only_new_lines(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_text("old\n")
    assert read(spark, str(log), str(tmp_path / "c"), from_start=False) == []
    with log.open("a") as f:
        f.write("new 1\nnew 2\n")
    assert [x[2] for x in read(spark, str(log), str(tmp_path / "c"), from_start=False)] == ["new 1", "new 2"]


def test_splits_share_no_line(tmp_path, monkeypatch):
    rng = random.Random(3)
    path = tmp_path / "x.log"
    text = [("y" * rng.randrange(0, 30)) for _ in range(200)]
    path.write_text("".join(x + "\n" for x in text))
    reader = growing.GrowingReader(str(path), True)
    for split in (1, 2, 7, 64, 10_000):
        monkeypatch.setattr(growing, "SPLIT", split)
        got = [r for p in reader.partitions({}, reader.latestOffset()) for r in reader.read(p)]
        assert [r[2] for r in got] == text and len({r[1] for r in got}) == 200
    assert list(reader.read(growing.Stretch("/nowhere", 0, 0, 5))) == []


def test_datagrams(spark):
    rows = [(b'\xff\xff\xff\xffRL 01/15/2024 - 20:00:00: World triggered "Round_Start"\n\x00',), (b"\xff\xff\xff\xffplain\r\n\r\n two \x00",), (b"Red \xfe",), (b"",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "p binary").select(growing.datagram_lines("p")).collect()]
    assert got == [['L 01/15/2024 - 20:00:00: World triggered "Round_Start"'], ["plain", "two"], ["Red �"], [], None]


def test_ledger(spark, tmp_path):
    folder, book = tmp_path / "in", str(tmp_path / "ledger")
    folder.mkdir()
    for name, size in (("a.log", 3), ("b.JSON", 4), ("c.txt", 5), ("d.csv", 0)):
        (folder / name).write_bytes(b"x" * size)
    names = lambda d: sorted(os.path.basename(r.path) for r in d.collect())
    first = ledger.listing(spark, str(folder))
    assert "content" not in first.columns and names(ledger.pending(first, ledger.marks(spark, book))) == ["a.log", "b.JSON"]
    first = spark.createDataFrame(first.collect(), first.schema)  # what was there then
    for _ in range(2):
        ledger.mark(first.filter("path like '%a.log'"), book, 7, F.lit(100), F.lit("m"))
    assert ledger.marks(spark, book).count() == 1
    assert names(ledger.pending(first, ledger.marks(spark, book))) == ["b.JSON"]
    (folder / "a.log").write_bytes(b"x" * 9)
    now = ledger.listing(spark, str(folder))
    assert names(ledger.pending(now, ledger.marks(spark, book))) == ["a.log", "b.JSON"]
    assert names(ledger.stable(first, now)) == ["b.JSON"]
    ledger.mark(now, book, 8, F.lit(200))
    ledger.compact(spark, book, str(tmp_path / "next"))
    again = ledger.marks(spark, str(tmp_path / "next"))
    assert again.count() == 2 and names(ledger.pending(now, again)) == []


@pytest.mark.parametrize("parts", [1, 7, 1000])
def test_newest(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([5, 5, 6, rng.randrange(100)]), f"m{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "analyzed_at long, match_id string")
    for keep in (0, 1, 50, 150, 200, 300):
        assert sorted(tuple(r) for r in ledger.newest(df, "analyzed_at", "match_id", keep, parts).collect()) == sorted(sorted(rows, reverse=True)[:keep])
    assert ledger.newest(df.limit(0), "analyzed_at", "match_id", 5, parts).count() == 0


def test_prune(spark, tmp_path):
    """A dry run changes nothing and counts what the swap removes; bans, watched players and matches that own rows stay."""
    store = Store(spark, str(tmp_path / "s"))
    matches = spark.createDataFrame([(f"m{i}", i) for i in range(10)], "match_id string, analyzed_at long")
    rows = spark.createDataFrame([(f"m{i}", p, 1.0) for i in range(10) for p in ((1, 2) if i == 4 else (2, None))], "match_id string, steamid long, score double")
    checks = spark.createDataFrame([(2, 1)], "steamid long, vac_banned int")
    store.write({"observations": rows, "matches": matches, "checks": checks, "watched": spark.createDataFrame([(1,), (1,)], "steamid long")})
    said = history.prune_store(store, 3)
    assert store.versions() == [0] and tuple(said.first()) == (10, 6, 13, 1)
    done = history.prune_store(store, 3, dry_run=False)
    assert store.versions() == [0, 1] and tuple(done.first()) == (10, 6, 13, 1)
    assert sorted(r.match_id for r in store.read("matches").collect()) == ["m4", "m7", "m8", "m9"]
    assert store.read("observations").count() == 7 and store.read("observations", 0).count() == 20 and store.read("checks").count() == 1
    assert tuple(history.prune_store(store, 50).first()) == (4, 0, 0, 1)
    with pytest.raises(Conflict):
        store.write({"matches": matches}, after=0)
    store.drop(keep=1)
    assert store.versions() == [1] and store.read("matches").count() == 4


def test_matches_are_replaced_in_parts(spark, tmp_path):
    path = str(tmp_path / "o")
    rows = lambda names, x: spark.createDataFrame([(n, i, x) for n in names for i in range(3)], "match_id string, steamid long, score double")
    history.save_observations(rows([f"m{i}" for i in range(40)], 1.0), path, 4)
    assert len([f for f in os.listdir(path) if f.startswith("part=")]) == 4
    history.save_observations(rows(["m3", "new"], 2.0), path, 4)
    got = spark.read.parquet(path)
    assert got.count() == 41 * 3
    assert {r.match_id for r in got.filter("score = 2.0").collect()} == {"m3", "new"}
