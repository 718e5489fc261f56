"""Dedicated-server text logs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import position, steam64
from ..operators.timeline import as_of
from ..schema import OPEN_END, Matches

#: How lines of the log look.
STAMP = r"^L (\d\d/\d\d/\d{4} - \d\d:\d\d:\d\d)"
WHO = r'"(.*?)<(\d+)><([^>]*)><([^>]*)>"(?: \[([-\d. ]+)\])?'
KILL = STAMP + r": " + WHO + r" killed " + WHO + r' with "([^"]*)"(.*)$'
ROUND = STAMP + r': World triggered "Round_Start"'


def LINE_TIME(line) -> Column:
    return F.regexp_extract(line if isinstance(line, Column) else F.col(line), STAMP, 1)


def _side(name: Column) -> Column:
    return F.when(F.upper(name).isin("CT", "BLUE"), 3).when(F.upper(name).isin("TERRORIST", "T", "RED"), 2).otherwise(0)


def kill_parts(line: str = "value") -> dict[str, Column]:
    """What a kill line says; null or empty for other lines."""
    part = lambda i: F.regexp_extract(line, KILL, i)
    return {
        "attacker": steam64(part(4)), "attacker_name": part(2), "attacker_team": _side(part(5)),
        "victim": steam64(part(9)), "victim_name": part(7), "victim_team": _side(part(10)), "weapon": part(12), "headshot": part(13).contains("headshot"),
    }


def kills_of(lines: DataFrame, line: str = "value") -> DataFrame:
    """The kill lines among lines, with what they say."""
    part = lambda i: F.regexp_extract(line, KILL, i)
    found = lines.filter(F.col(line).rlike(KILL))
    flags = part(13)
    out = found.withColumns({
        "attacker_name": part(2), "attacker": steam64(part(4)), "attacker_team": _side(part(5)), "attacker_pos": position(part(6)),
        "victim_name": part(7), "victim": steam64(part(9)), "victim_team": _side(part(10)), "victim_pos": position(part(11)), "weapon": part(12),
        "headshot": flags.contains("headshot"), "through_smoke": flags.contains("throughsmoke"), "noscope": flags.contains("noscope"), "penetrated": flags.contains("penetrated").cast("int"),
    })
    return out


def load(spark: SparkSession, path: str, tickrate: float = 64.0, game: str = "cs2") -> Matches:
    """All log files under path, a match each."""
    lines = spark.read.text(path).select(F.input_file_name().alias("match_id"), F.monotonically_increasing_id().alias("seq"), "value")
    return parse(lines, tickrate, game)


def parse(lines: DataFrame, tickrate: float = 64.0, game: str = "cs2") -> Matches:
    """Matches of lines (match_id, seq, value); seq is the order in the file.

    A tick is the time since the first event of the match.  Positions of a kill
    become ticks without angles.  Lines that say nothing known are passed over.
    """
    stamp = F.unix_timestamp(F.try_to_timestamp(F.nullif(LINE_TIME("value"), F.lit("")), F.lit("MM/dd/yyyy - HH:mm:ss")))
    events = lines.withColumn("at", stamp).filter(F.col("at").isNotNull())
    kills, starts = kills_of(events), events.filter(F.col("value").rlike(ROUND))
    base = kills.select("match_id", "at").unionByName(starts.select("match_id", "at")).groupBy("match_id").agg(F.min("at").alias("base"))
    tick = ((F.col("at") - F.col("base")) * tickrate).cast("int").alias("tick")
    w = W.partitionBy("match_id").orderBy("tick", "seq")
    rounds = starts.join(base, "match_id").select("match_id", "seq", tick).withColumn("number", F.row_number().over(w)).withColumn("end_tick", F.coalesce(F.lead("tick").over(w) - 1, F.lit(OPEN_END)).cast("int"))
    rounds = rounds.select("match_id", F.col("number").cast("int").alias("number"), F.col("tick").alias("start_tick"), "end_tick")
    kills = kills.join(base, "match_id").withColumn("tick", tick)
    flat = kills.select("match_id", "seq", "tick", "attacker", "victim", "weapon", "headshot", "noscope", "through_smoke", "penetrated", "attacker_name", "attacker_team", "attacker_pos", "victim_name", "victim_team", "victim_pos")
    flat = as_of(flat, rounds.select("match_id", "start_tick", "number"), ["match_id"], "tick", "start_tick", "number").withColumnRenamed("number", "round_num")
    sides = [flat.select("match_id", (F.col("seq") * 2 + k).alias("seq"), "tick", F.col(who).alias("steamid"), F.col(f"{who}_name").alias("name"), F.col(f"{who}_team").alias("team"), F.col(f"{who}_pos").alias("pos"), "round_num") for k, who in enumerate(("attacker", "victim"))]
    seen = sides[0].unionByName(sides[1])
    players = seen.groupBy("match_id", "steamid").agg(F.max_by("name", "seq").alias("name"), F.coalesce(F.max_by("team", F.when(F.col("team") != 0, F.col("seq"))), F.lit(0)).alias("team"))
    teams = players.select("match_id", "steamid", F.col("team").alias("own"))
    ticks = seen.filter("pos is not null").join(teams, ["match_id", "steamid"]).select("match_id", "seq", "tick", "steamid", "pos.x", "pos.y", "pos.z", F.lit(0.0).alias("pitch"), F.lit(0.0).alias("yaw"), F.lit(True).alias("is_alive"), F.col("own").alias("team"), F.lit(100).alias("health"), F.col("round_num").cast("int").alias("round_num"), F.lit(0).alias("keys"))
    caps = flat.groupBy("match_id").agg(F.max(F.col("attacker_pos").isNotNull() | F.col("victim_pos").isNotNull()).alias("pos"), (F.countDistinct(F.when(F.col("attacker_team") != 0, F.col("attacker_team"))) + F.countDistinct(F.when(F.col("victim_team") != 0, F.col("victim_team")))).alias("sides"))
    have = F.array_compact(F.array(F.when(F.col("pos"), "positions"), F.lit("kills"), F.lit("kill_flags"), F.when(F.col("sides") >= 2, "teams")))
    matches = caps.select("match_id", F.col("match_id").alias("source"), F.lit("").alias("map_name"), F.lit(game).alias("game"), F.lit(float(tickrate)).alias("tickrate"), F.array_sort(have).alias("capabilities"))
    shots = lines.sparkSession.createDataFrame([], "match_id string, seq long, tick int, steamid long, weapon string, round_num int")
    kept = flat.select("match_id", "seq", "tick", "attacker", "victim", "weapon", "headshot", F.col("round_num").cast("int").alias("round_num"), "noscope", "through_smoke", "penetrated")
    return Matches(ticks, kept, shots, rounds, players.select("match_id", "steamid", "name", "team"), matches)
