"""One way into every source, by the extension of a path."""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..schema import Matches
from . import converters, frames, ingest, replays, server_log

#: Which adapter reads which extension.
ADAPTERS = {"osr": "osr", "log": "log", "txt": "log", "json": "ingest", "jsonl": "ingest", "ndjson": "ingest", "csv": "ingest"}


def load_any(spark: SparkSession, path: str, tickrate: float = 64.0, game: str = "", adapter: str = "") -> Matches:
    """Matches of path; adapter (osr, log, ingest, telemetry, dissect, frames, frames_csv) overrides the extension."""
    kind = adapter or ADAPTERS.get(path.rstrip("/").rpartition(".")[2].lower(), "")
    if kind == "osr":
        return replays.load(spark, path)
    if kind == "log":
        return server_log.load(spark, path, tickrate, game or "cs2")
    if kind == "ingest":
        return ingest.load(spark, path, tickrate, game or "unknown")
    if kind in ("frames", "frames_csv"):
        return frames.load(spark, path, tickrate, game or "cs2", "csv" if kind == "frames_csv" else "parquet")
    whole = lambda: spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("match_id"), "value")
    if kind == "telemetry":
        return converters.telemetry(whole())
    if kind == "dissect":
        return converters.dissections(whole())
    raise ValueError(f"no adapter for {path}")


def cut_ticks(m: Matches, ticks: int) -> Matches:
    """Only the first ticks of each match."""
    first = m.ticks.groupBy("match_id").agg(F.min("tick").alias("_first"))
    kept = m.ticks.join(first, "match_id").filter(F.col("tick") <= F.col("_first") + ticks).drop("_first")
    return Matches(kept, m.kills, m.shots, m.rounds, m.players, m.matches)
