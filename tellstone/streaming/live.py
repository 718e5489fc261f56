"""Live logs: a roster, rounds and bursts of kills, as streams."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.scalar import steam64
from ..sources.server_log import LINE_TIME, ROUND, kills_of

#: Fixed value: a line of a console's status list, with or without the sign before the number.
STATUS = r'^\s*(?:#\s*)?\d+\s+(?:\d+\s+)?"(.*)"\s+(STEAM_\d:\d:\d+|\[U:1:\d+\])'


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of log lines (match_id, value) from files that appear in a folder."""
    return spark.readStream.text(folder).select(F.input_file_name().alias("match_id"), "value")


def roster(status: DataFrame) -> DataFrame:
    """steamid and name of console status lines."""
    found = status.filter(F.col("value").rlike(STATUS))
    return found.select(*[c for c in status.columns if c != "value"], steam64(F.regexp_extract("value", STATUS, 2)).alias("steamid"), F.regexp_extract("value", STATUS, 1).alias("name"))


def state_roster(payloads: DataFrame, column: str = "value") -> DataFrame:
    """steamid and name of everyone in game-state payloads, and of the player itself if not among them."""
    listed = F.from_json(F.get_json_object(column, "$.allplayers"), "map<string,struct<name:string>>")
    own = F.create_map(F.get_json_object(column, "$.player.steamid"), F.struct(F.get_json_object(column, "$.player.name").alias("name")))
    both = F.when(F.get_json_object(column, "$.player.steamid").isNull(), listed).when(listed.isNull(), own).otherwise(F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(listed), k)), listed))
    return payloads.select(F.explode(both).alias("id", "p")).select(steam64("id").alias("steamid"), F.coalesce("p.name", F.lit("")).alias("name"))


def first_seen(found: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """Each player once; repeats within the delay are dropped, with bounded state."""
    return found.withWatermark(time, delay).dropDuplicatesWithinWatermark(["steamid"])


def kill_stream(log: DataFrame) -> DataFrame:
    """match_id, event_time, attacker and victim of the kills in a stream of lines."""
    when = F.try_to_timestamp(F.nullif(LINE_TIME("value"), F.lit("")), F.lit("MM/dd/yyyy - HH:mm:ss"))
    return kills_of(log).select("match_id", when.alias("event_time"), "attacker", "victim", "weapon", "headshot").filter("attacker <> victim")


def round_stream(log: DataFrame) -> DataFrame:
    when = F.try_to_timestamp(F.nullif(LINE_TIME("value"), F.lit("")), F.lit("MM/dd/yyyy - HH:mm:ss"))
    return log.filter(F.col("value").rlike(ROUND)).select("match_id", when.alias("event_time"))


ALERTS = "match_id string, attacker long, event_time timestamp, size int"
STATE = "times array<long>, alerted array<long>"


def burst_alerts(kills: DataFrame, window_seconds: float = 1.2, least: int = 3, delay: str = "10 seconds") -> DataFrame:
    """An alert for each kill that ends a group of at least least within the window, once a group.

    State is the times of a player's kills that a kill not yet dropped can
    join, so it stays small; a player without kills past the watermark loses
    its state.  Events
    later than the delay are dropped.  Groups are by event time, whatever the
    order in a batch.
    """

    nothing = pd.DataFrame({"match_id": pd.Series(dtype=str), "attacker": pd.Series(dtype="int64"), "event_time": pd.Series(dtype="datetime64[ns]"), "size": pd.Series(dtype="int32")})

    span = int(window_seconds * 1_000_000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield nothing
            return
        times, alerted = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        new = sorted(int(t.value) // 1000 for b in batches for t in b["event_time"])
        out = []
        # A late kill joins those before and after it; what no kill can join any more, by the watermark, goes.
        floor = state.getCurrentWatermarkMs() * 1000 - span
        times, alerted = sorted([x for x in times if x >= floor] + new), [x for x in alerted if x >= floor]
        for i, t in enumerate(times):
            first = next(x for x in times if t - x <= span)
            size = i + 1 - times.index(first)
            if size >= least and not any(first <= x <= t for x in alerted):
                out.append((key[0], key[1], pd.Timestamp(t, unit="us"), size))
                alerted.append(t)
        state.update((times, alerted))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (times[-1] if times else 0) // 1000) + 60_000)
        yield pd.DataFrame(out, columns=list(nothing.columns)) if out else nothing

    timed = kills.select("match_id", "attacker", "event_time").withWatermark("event_time", delay)
    return timed.groupBy("match_id", "attacker").applyInPandasWithState(update, ALERTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, path: str, mode: str = "append", timers: bool = False) -> DataFrame:
    """Run a stream over what is there now and return the rows that it gives, from tables under path that all executors share.

    In complete mode each batch is the whole result, and the last one counts.
    A stream whose state has timers of processing time always has a batch to
    run; with timers, only batches with new rows are run, so that it ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/drained={number}")

    spark, empty = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, str(not timers and before == "true").lower())
    try:
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(empty, before)
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    found = spark.read.schema(StructType([*stream.schema.fields, StructField("drained", LongType())])).parquet(f"{path}/batches")
    if mode == "complete":
        found = found.filter(F.col("drained") == found.agg(F.max("drained")).first()[0])
    return found.select(*stream.columns)


def watch_folder(spark: SparkSession, folder: str, checkpoint: str, handle, seconds: int = 30, failed: str | None = None):
    """Call handle(batch of new files' lines, batch number) as files appear.

    A batch that fails is written with its error under failed, a folder of
    JSON lines, and doesn't end the stream; without that folder it does, and
    its files come again after a restart.
    """

    def safe(batch: DataFrame, number: int) -> None:
        try:
            handle(batch, number)
        except Exception as e:
            if failed is None:
                raise
            batch.select("match_id", "value", F.lit(number).alias("batch"), F.lit(str(e)).alias("error")).write.mode("append").json(failed)

    return lines(spark, folder).writeStream.foreachBatch(safe).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
