"""The tables of a set of matches, and what a source can support."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICKS = "match_id string, seq long, tick int, steamid long, x double, y double, z double, pitch double, yaw double, is_alive boolean, team int, health int, round_num int, keys int"
KILLS = "match_id string, seq long, tick int, attacker long, victim long, weapon string, headshot boolean, round_num int, noscope boolean, through_smoke boolean, penetrated int"
SHOTS = "match_id string, seq long, tick int, steamid long, weapon string, round_num int"
ROUNDS = "match_id string, number int, start_tick int, end_tick int"
PLAYERS = "match_id string, steamid long, name string, team int"
MATCHES = "match_id string, source string, map_name string, game string, tickrate double, capabilities array<string>"
EVIDENCE = "struct<kind:string,round:int,tick:int,detail:string,target:string>"
SIGNALS = f"match_id string, steamid long, name string, value double, samples long, confident boolean, raw map<string,double>, evidence array<{EVIDENCE}>"
OBSERVATIONS = "match_id string, steamid long, name string, team int, kills long, deaths long, headshots long, shots long, score double, signals map<string,struct<value:double,samples:long,confident:boolean,raw:map<string,double>>>, flags array<string>, evidence array<struct<signal:string,kind:string,round:int,tick:int,detail:string,target:string>>"
BAN_CHECKS = "steamid long, checked_at long, vac_banned int, game_bans int, days_since_ban int, community_ban int, economy_ban string, raw string"
WATCHLIST = "steamid long, label string, reason string, added_at long, last_seen long, times_seen int"

#: The end of a round that is still open.
OPEN_END = 1_000_000_000
CAPABILITIES = ("angles", "cursor", "health", "keys", "kill_flags", "kills", "positions", "shots", "teams")
#: Support levels, least first, and what each stands for where a source says no more.
SUPPORT = ("none", "account", "events", "positional", "full")


@dataclass
class Matches:
    """Any number of matches; every table has match_id."""

    ticks: DataFrame
    kills: DataFrame
    shots: DataFrame
    rounds: DataFrame
    players: DataFrame
    matches: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Matches:
        return Matches(*(spark.createDataFrame([], s) for s in (TICKS, KILLS, SHOTS, ROUNDS, PLAYERS, MATCHES)))

    def union(self, other: Matches) -> Matches:
        names = ("ticks", "kills", "shots", "rounds", "players", "matches")
        return Matches(*(getattr(self, n).unionByName(getattr(other, n)) for n in names))


def team_of(m: Matches) -> DataFrame:
    """match_id, steamid, name and team of the roster: the player's own team, else that of the last tick, else 0."""
    last = m.ticks.groupBy("match_id", "steamid").agg(F.max_by("team", "seq").alias("_team"))
    joined = m.players.join(last, ["match_id", "steamid"], "left")
    return joined.select("match_id", "steamid", F.coalesce(F.nullif("name", F.lit("")), F.col("steamid").cast("string")).alias("name"), F.coalesce(F.nullif("team", F.lit(0)), "_team", F.lit(0)).alias("team"))


def indexed(ticks: DataFrame) -> DataFrame:
    """One row a player and tick, the last one read."""
    rest = [c for c in ticks.columns if c not in ("match_id", "steamid", "tick")]
    kept = ticks.groupBy("match_id", "steamid", "tick").agg(F.max_by(F.struct(*rest), "seq").alias("_row"))
    return kept.select("match_id", "steamid", "tick", *[F.col(f"_row.{c}").alias(c) for c in rest])
