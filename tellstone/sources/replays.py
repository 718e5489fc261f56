"""Binary cursor replays: reading and writing."""
from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import dotnet_seconds, stable_id
from ..schema import Matches

HEADER = "match_id string, mode int, version int, beatmap string, player string, count_300 int, count_100 int, count_50 int, count_geki int, count_katu int, count_miss int, score int, max_combo int, perfect boolean, mods int, at_ticks long, frames string, error string"


def _string(data: bytes, at: int) -> tuple[str, int]:
    """A string with a marker and a length in seven-bit groups."""
    if data[at] == 0:
        return "", at + 1
    if data[at] != 0x0B:
        raise ValueError("unknown string marker")
    at, size, shift = at + 1, 0, 0
    while True:
        size |= (data[at] & 0x7F) << shift
        shift += 7
        at += 1
        if not data[at - 1] & 0x80:
            return data[at : at + size].decode("utf-8", "replace"), at + size


def parse_replay(data: bytes) -> dict:
    out: dict = {}
    out["mode"], out["version"] = struct.unpack_from("<Bi", data, 0)
    at = 5
    out["beatmap"], at = _string(data, at)
    out["player"], at = _string(data, at)
    _, at = _string(data, at)
    counts = struct.unpack_from("<6H", data, at)
    out |= dict(zip(("count_300", "count_100", "count_50", "count_geki", "count_katu", "count_miss"), counts, strict=True))
    out["score"], out["max_combo"], perfect, out["mods"] = struct.unpack_from("<iHBi", data, at + 12)
    out["perfect"] = bool(perfect)
    _, at = _string(data, at + 23)
    out["at_ticks"], size = struct.unpack_from("<qi", data, at)
    at += 12
    if size < 0 or at + size > len(data):
        raise ValueError("the compressed block has a wrong length")
    out["frames"] = lzma.decompress(data[at : at + size], format=lzma.FORMAT_ALONE).decode("utf-8", "replace") if size else ""
    return out


def headers(files: DataFrame) -> DataFrame:
    """What the headers of files (match_id, content) say, and the text of their frames; error tells what is wrong with a file."""
    names = [c.split()[0] for c in HEADER.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append({"match_id": name, "error": None} | parse_replay(content))
                except (ValueError, IndexError, struct.error, lzma.LZMAError) as e:
                    rows.append({"match_id": name, "error": str(e) or "truncated"})
            kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
            fields = [pa.field(c.split()[0], kinds[c.split()[1]]) for c in HEADER.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in fields], names)

    return files.select("match_id", "content").mapInArrow(parse, HEADER)


def frames(texts: DataFrame, text: str = "frames") -> DataFrame:
    """Samples of texts (match_id, ...): lists of w|x|y|keys, w the time since the one before.

    Times and keys may have fractions, which are cut off.  Malformed entries,
    the seed entry (w -12345) and those with a negative time are left out.
    """
    parts = F.split("item", r"\|")
    whole = lambda k: F.col("p")[k].try_cast("double").try_cast("int")
    rows = texts.select("match_id", F.posexplode(F.split(text, ",")).alias("seq", "item")).withColumn("p", parts).filter(F.size("p") == 4)
    rows = rows.select("match_id", F.col("seq").cast("long").alias("seq"), whole(0).alias("w"), F.col("p")[1].try_cast("double").alias("x"), F.col("p")[2].try_cast("double").alias("y"), whole(3).alias("keys"))
    rows = rows.filter("w is not null and x is not null and y is not null and keys is not null and w >= 0")
    return rows.withColumn("ms", F.sum("w").over(W.partitionBy("match_id").orderBy("seq")).cast("long")).drop("w")


def load(spark: SparkSession, path: str, rate: float = 60.0) -> Matches:
    """Cursor matches of .osr files; ticks are in the order of the file."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("match_id"), "content")
    head = headers(files).filter("error is null and frames <> ''").withColumn("steamid", stable_id("player", 54, "?"))
    rows = frames(head).join(head.select("match_id", "steamid"), "match_id")
    ticks = rows.select("match_id", "seq", (F.col("ms") * rate / 1000).cast("int").alias("tick"), "steamid", "x", "y", F.lit(0.0).alias("z"), F.lit(0.0).alias("pitch"), F.lit(0.0).alias("yaw"), F.lit(True).alias("is_alive"), F.lit(0).alias("team"), F.lit(100).alias("health"), F.lit(1).alias("round_num"), "keys")
    players = head.select("match_id", "steamid", F.coalesce(F.nullif("player", F.lit("")), F.lit("unknown")).alias("name"), F.lit(0).alias("team"))
    matches = head.select("match_id", F.col("match_id").alias("source"), F.coalesce(F.nullif("beatmap", F.lit("")), F.lit("unknown")).alias("map_name"), F.lit("osu").alias("game"), F.lit(float(rate)).alias("tickrate"), F.array(*map(F.lit, ("cursor", "keys", "positions"))).alias("capabilities"))
    empty = Matches.empty(spark)
    return Matches(ticks, empty.kills, empty.shots, empty.rounds, players, matches)


def played_at(head: DataFrame) -> DataFrame:
    """headers() with the second at which the replay was made."""
    return head.withColumn("played_at", dotnet_seconds("at_ticks"))


def _pack(text: str) -> bytes:
    raw, out = text.encode(), bytearray(b"\x0b")
    if not raw:
        return b"\0"
    n = len(raw)
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out) + raw


def write_replay(path: str, samples: list[tuple[int, float, float, int]], player: str = "player", beatmap: str = "beatmap", mode: int = 0) -> None:
    """A replay file of samples (ms, x, y, keys)."""
    before, items = 0, []
    for ms, x, y, keys in samples:
        items.append(f"{ms - before}|{x}|{y}|{keys}")
        before = ms
    block = lzma.compress(",".join([*items, "-12345|0|0|0", ""]).encode(), format=lzma.FORMAT_ALONE)
    with open(path, "wb") as f:
        f.write(struct.pack("<Bi", mode, 20240101) + _pack(beatmap) + _pack(player) + _pack("hash") + struct.pack("<6H", 1, 2, 3, 4, 5, 6))
        f.write(struct.pack("<iHBi", 1000, 50, 1, 0) + _pack("") + struct.pack("<qi", 638396640000000000, len(block)) + block + struct.pack("<q", 0))
