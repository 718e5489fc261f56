"""Log files that grow in place, as a stream of their lines, and datagrams of a game server."""
from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads, and that are looked at for the last line's end at once.
SPLIT, BLOCK = 32 << 20, 1 << 16


class Stretch(InputPartition):
    """The lines of a file that begin from start on and before stop; first is where the batch's first line begins."""

    def __init__(self, path: str, first: int, start: int, stop: int):
        self.path, self.first, self.start, self.stop = path, first, start, stop


def whole_lines(path: str) -> tuple[int, int]:
    """Up to which byte the file has whole lines, and a checksum of its first; 0 and 0 without one."""
    with open(path, "rb") as file:
        at = file.seek(0, os.SEEK_END)
        while at > 0:
            begin = max(0, at - BLOCK)
            file.seek(begin)
            place = file.read(at - begin).rfind(b"\n")
            if place >= 0:
                file.seek(0)
                return begin + place + 1, zlib.crc32(file.readline()) or 1
            at = begin
    return 0, 0


class GrowingReader(DataSourceStreamReader):
    """An offset has, for each file, the end of its whole lines and the checksum of its first line.

    A file that is shorter than before, or whose first line is another one, was
    begun anew and is read from its start.  A batch that comes again after a
    failure reads the same bytes.
    """

    def __init__(self, pattern: str, from_start: bool):
        self.pattern, self.from_start = pattern, from_start

    def _ends(self) -> dict:
        ends = {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                ends[path] = list(whole_lines(path))
            except OSError:  # gone, or a folder
                continue
        return ends

    def initialOffset(self) -> dict:
        return {} if self.from_start else self._ends()

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path, (stop, mark) in end.items():
            was, known = start.get(path, (0, 0))
            first = was if known == mark and was <= stop else 0
            out += [Stretch(path, first, a, min(a + SPLIT, stop)) for a in range(first, stop, SPLIT)]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        try:
            file = open(partition.path, "rb")  # noqa: SIM115
        except FileNotFoundError:
            return
        with file:
            at = partition.start
            if at > partition.first:  # a line that began before is the task's before
                file.seek(at - 1)
                at += len(file.readline()) - 1
            file.seek(at)
            while at < partition.stop and (line := file.readline()):
                yield partition.path, at, line.decode("utf-8", "replace").rstrip("\r\n")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Format growing_lines: path is a pattern of files on a disk that driver and executors share; fromStart is true or false."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, at long, value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], self.options.get("fromstart", self.options.get("fromStart", "true")).lower() == "true")


def growing_lines(spark: SparkSession, pattern: str, from_start: bool = True) -> DataFrame:
    """A stream of the lines (match_id, seq, value) of all files that fit the pattern, each line once, when it is whole.

    match_id is the file's path and seq where the line begins.  Files that
    appear later are read from their start; without from_start, those that
    are there already give only what is written from now on.
    """
    spark.dataSource.register(GrowingLines)
    rows = spark.readStream.format("growing_lines").option("path", pattern).option("fromStart", str(from_start).lower()).load()
    return rows.select(F.col("path").alias("match_id"), F.col("at").alias("seq"), "value")


def datagram_lines(payload: str | Column) -> Column:
    """The lines of a datagram of a game server: without the bytes FF and the letter before a log line, and without empty ones."""
    body = F.unhex(F.regexp_replace(F.hex(payload), "^(FF)+", ""))
    each = F.split(F.make_valid_utf8(body.cast("string")), r"\r\n|\r|\n")
    bare = F.transform(each, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\x00 \r\n]+|[\x00 \r\n]+$", ""), r"^[RS](?=L \d\d/)", ""))
    return F.filter(bare, lambda x: x != "")
