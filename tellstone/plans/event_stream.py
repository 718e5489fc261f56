"""A match made of a stream of user events: days are rounds, purchases are kills."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.timeline import bounds
from ..schema import CAPABILITIES, OPEN_END, Matches


def as_match(events: DataFrame) -> Matches:
    """events (event_id, user_id, tick, event_type, k, day) as one match that supports kills and their flags."""
    spark = events.sparkSession
    match = F.lit("events").alias("match_id")
    rounds = bounds(events.groupBy("day").agg(F.min("tick").alias("start_tick")).withColumn("match_id", F.lit("events")), ["match_id"], "start_tick", OPEN_END)
    rows = events.join(rounds.select("day", F.col("number").alias("round_num")), "day")
    kills = rows.filter("event_type = 'purchase'").select(match, F.col("event_id").alias("seq"), "tick", F.col("user_id").alias("attacker"), (-F.col("event_id") - 1).alias("victim"), F.lit("").alias("weapon"), (F.col("k") % 2 == 1).alias("headshot"), "round_num", (F.col("k").bitwiseAND(4) != 0).alias("noscope"), (F.col("k").bitwiseAND(2) != 0).alias("through_smoke"), F.col("k").bitwiseAND(1).alias("penetrated"))
    shots = rows.filter("event_type = 'click'").select(match, F.col("event_id").alias("seq"), "tick", F.col("user_id").alias("steamid"), F.lit("").alias("weapon"), "round_num")
    players = events.groupBy(F.col("user_id").alias("steamid")).agg(F.lit(0).alias("team")).select(match, "steamid", F.concat(F.lit("user "), "steamid").alias("name"), "team")
    matches = spark.range(1).select(match, F.lit("events").alias("source"), F.lit("").alias("map_name"), F.lit("").alias("game"), F.lit(1.0).alias("tickrate"), F.array(F.lit("kill_flags"), F.lit("kills")).alias("capabilities"))
    return Matches(Matches.empty(spark).ticks, kills, shots, rounds.select("match_id", "number", "start_tick", "end_tick"), players, matches)


def as_field(events: DataFrame) -> Matches:
    """events (event_id, user_id, tick, event_type, value, k) as one match with positions, angles and keys.

    A user's n-th event is the n-th tick; errors are ticks of a dead player,
    purchases kills of the user beside it (0 and 1, 2 and 3, ...), clicks
    shots.  Rounds have 20 ticks.
    """
    spark, match = events.sparkSession, F.lit("field").alias("match_id")
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("tick", "event_id"))
    turn = F.col("value") * 3.6
    rows = events.withColumn("t", rank).withColumn("round_num", F.floor(F.col("t") / 20).cast("int") + 1)
    team = (F.col("user_id") % 2 + 2).cast("int")
    ticks = rows.select(
        match, F.col("t").cast("long").alias("seq"), F.col("t").alias("tick"), F.col("user_id").alias("steamid"), (F.col("value") * 10).alias("x"), (F.col("k") * 100.0).alias("y"), F.lit(0.0).alias("z"),
        ((F.col("k") % 9) * 10.0 - 40).alias("pitch"), (turn - 360 * F.floor(turn / 360) - 180).alias("yaw"), (F.col("event_type") != "error").alias("is_alive"), team.alias("team"), F.lit(100).alias("health"), "round_num", F.col("k").alias("keys"),
    )
    beside = F.col("user_id") + 1 - 2 * (F.col("user_id") % 2)
    kills = rows.filter("event_type = 'purchase'").select(match, F.col("t").cast("long").alias("seq"), F.col("t").alias("tick"), F.col("user_id").alias("attacker"), beside.alias("victim"), F.lit("").alias("weapon"), F.lit(False).alias("headshot"), "round_num", F.lit(False).alias("noscope"), F.lit(False).alias("through_smoke"), F.lit(0).alias("penetrated"))
    shots = rows.filter("event_type = 'click'").select(match, F.col("t").cast("long").alias("seq"), F.col("t").alias("tick"), F.col("user_id").alias("steamid"), F.lit("").alias("weapon"), "round_num")
    rounds = rows.select(match, F.col("round_num").alias("number"), ((F.col("round_num") - 1) * 20).alias("start_tick"), (F.col("round_num") * 20 - 1).alias("end_tick")).distinct()
    players = events.groupBy(F.col("user_id").alias("steamid")).agg(F.max(team).alias("team")).select(match, "steamid", F.concat(F.lit("user "), "steamid").alias("name"), "team")
    matches = spark.range(1).select(match, F.lit("events").alias("source"), F.lit("").alias("map_name"), F.lit("").alias("game"), F.lit(4.0).alias("tickrate"), F.array(*map(F.lit, CAPABILITIES)).alias("capabilities"))
    return Matches(ticks, kills, shots, rounds, players, matches)
