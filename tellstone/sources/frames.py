"""Tables of frames and events that a parser of binary replays has written, as matches."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.timeline import as_of
from ..plans.catalog import CAPS
from ..schema import KILLS, OPEN_END, ROUNDS, SHOTS, Matches

#: Names of the parser's columns, the first that a table has counts.
NAMES = {
    "steamid": ("steamid", "steam_id"), "name": ("name", "player_name"), "x": ("X", "x"), "y": ("Y", "y"), "z": ("Z", "z"),
    "pitch": ("pitch", "eye_pitch"), "yaw": ("yaw", "eye_yaw"), "is_alive": ("is_alive",), "team": ("team_num", "team_number"), "health": ("health",),
    "attacker": ("attacker_steamid", "attacker_steam_id"), "victim": ("user_steamid", "victim_steamid", "user_steam_id"),
    "headshot": ("headshot",), "weapon": ("weapon",), "penetrated": ("penetrated",), "through_smoke": ("thrusmoke", "through_smoke"), "noscope": ("noscope",),
    "shooter": ("user_steamid", "user_steam_id", "steamid"), "map": ("map_name", "map"),
}


def lenient_int(x: Column, default: int | None = 0) -> Column:
    """A whole number, of numbers without their fraction; default for what is none."""
    return F.coalesce(x.try_cast("long"), F.lit(default).cast("long"))


def lenient_bool(x: Column, kind: str, default: bool = True) -> Column:
    """Whether a word says yes or a number isn't 0; default for null."""
    if kind == "boolean":
        return F.coalesce(x, F.lit(default))
    if kind == "string":
        return F.when(x.isNull(), default).otherwise(F.lower(F.trim(x)).isin("1", "true", "t", "yes"))
    return F.when(x.isNull(), default).otherwise(F.coalesce(x.try_cast("long") != 0, F.lit(True)))


def _pick(df: DataFrame, name: str, required: bool = False) -> str | None:
    found = next((c for c in NAMES[name] if c in df.columns), None)
    if required and found is None:
        raise ValueError(f"none of the columns {', '.join(NAMES[name])} is there: {', '.join(sorted(df.columns)[:40])}")
    return found


def _int(df: DataFrame, name: str, default: int | None = 0) -> Column:
    column = _pick(df, name)
    return F.lit(default).cast("long") if column is None else lenient_int(F.col(f"`{column}`"), default)


def _bool(df: DataFrame, name: str, default: bool) -> Column:
    column = _pick(df, name)
    return F.lit(default) if column is None else lenient_bool(F.col(f"`{column}`"), df.schema[column].dataType.simpleString(), default)


def _text(df: DataFrame, name: str) -> Column:
    column = _pick(df, name)
    return F.lit("") if column is None else F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def _tick(df: DataFrame) -> Column:
    return lenient_int(F.col("tick"), None).cast("int")


def from_frames(frames: DataFrame, deaths: DataFrame | None = None, fires: DataFrame | None = None, starts: DataFrame | None = None, headers: DataFrame | None = None, tickrate: float = 64.0, game: str = "cs2") -> Matches:
    """Matches of tables that all have match_id, and those with times tick.

    frames has a row a player and tick; rows without a player, a tick of 0 or
    more, a place or an aim are left out.  A round begins at each tick of
    starts and ends before the next.  deaths and fires without an id are left
    out.  Kills have flags if deaths has a column of any.  The name of a player
    is the first that is seen and the team the last that isn't 0.
    """
    spark = frames.sparkSession
    places = {k: F.col(f"`{_pick(frames, k, True)}`").try_cast("double") for k in ("x", "y", "z", "pitch", "yaw")}
    _pick(frames, "steamid", True)
    rows = frames.select(
        "match_id", F.monotonically_increasing_id().alias("seq"), _tick(frames).alias("tick"), _int(frames, "steamid").alias("steamid"), *[v.alias(k) for k, v in places.items()],
        _bool(frames, "is_alive", True).alias("is_alive"), _int(frames, "team").cast("int").alias("team"), _int(frames, "health", 100).cast("int").alias("health"), _text(frames, "name").alias("name"),
    )
    rows = rows.filter("tick >= 0 and steamid <> 0").dropna(subset=list(places))
    rounds = spark.createDataFrame([], ROUNDS)
    if starts is not None:
        begun = starts.select("match_id", _tick(starts).alias("start_tick")).dropna().distinct()
        w = W.partitionBy("match_id").orderBy("start_tick")
        rounds = begun.select("match_id", F.row_number().over(w).alias("number"), "start_tick", F.coalesce(F.lead("start_tick").over(w) - 1, F.lit(OPEN_END)).alias("end_tick"))

    def numbered(df: DataFrame) -> DataFrame:
        found = as_of(df, rounds.select("match_id", "start_tick", "number"), ["match_id"], "tick", "start_tick", "number")
        return found.withColumn("round_num", F.col("number").cast("int")).drop("number")

    kills, shots, flags = spark.createDataFrame([], KILLS), spark.createDataFrame([], SHOTS), False
    if deaths is not None and _pick(deaths, "attacker") and _pick(deaths, "victim"):
        flags = any(_pick(deaths, k) for k in ("penetrated", "through_smoke", "noscope"))
        kills = deaths.select(
            "match_id", F.monotonically_increasing_id().alias("seq"), lenient_int(F.col("tick")).cast("int").alias("tick"), _int(deaths, "attacker").alias("attacker"), _int(deaths, "victim").alias("victim"), _text(deaths, "weapon").alias("weapon"),
            _bool(deaths, "headshot", False).alias("headshot"), _bool(deaths, "noscope", False).alias("noscope"), _bool(deaths, "through_smoke", False).alias("through_smoke"), _int(deaths, "penetrated").cast("int").alias("penetrated"),
        )
        kills = numbered(kills.filter("attacker <> 0 and victim <> 0")).select(*spark.createDataFrame([], KILLS).columns)
    if fires is not None and _pick(fires, "shooter"):
        shots = fires.select("match_id", F.monotonically_increasing_id().alias("seq"), lenient_int(F.col("tick")).cast("int").alias("tick"), _int(fires, "shooter").alias("steamid"), _text(fires, "weapon").alias("weapon"))
        shots = numbered(shots.filter("steamid <> 0")).select(*spark.createDataFrame([], SHOTS).columns)
    players = rows.groupBy("match_id", "steamid").agg(F.min_by("name", "seq").alias("name"), F.coalesce(F.max_by("team", F.when(F.col("team") != 0, F.struct("tick", "seq"))), F.lit(0)).alias("team"))
    players = players.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.col("steamid").cast("string")))
    caps = F.array_sort(F.array(*map(F.lit, [*CAPS["full"], *(["kill_flags"] if flags else [])])))
    maps = None if headers is None or not _pick(headers, "map") else headers.groupBy("match_id").agg(F.max(_text(headers, "map")).alias("map_name"))
    matches = rows.select("match_id").distinct()
    matches = matches.withColumn("map_name", F.lit("")) if maps is None else matches.join(maps, "match_id", "left").fillna("", ["map_name"])
    matches = matches.select("match_id", F.col("match_id").alias("source"), "map_name", F.lit(game).alias("game"), F.lit(float(tickrate)).alias("tickrate"), caps.alias("capabilities"))
    ticks = numbered(rows.drop("name")).withColumn("keys", F.lit(0))
    return Matches(ticks, kills, shots, rounds, players, matches)


def load(spark: SparkSession, path: str, tickrate: float = 64.0, game: str = "cs2", kind: str = "parquet") -> Matches:
    """Matches of the tables ticks, player_death, weapon_fire, round_start and header in a folder; all but the first may be missing."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()

    def table(name: str) -> DataFrame | None:
        place = f"{path.rstrip('/')}/{name}"
        file = next((x for x in (f"{place}.{kind}", place) if fs_path(x).getFileSystem(conf).exists(fs_path(x))), None)
        return None if file is None else spark.read.option("header", True).format(kind).load(file)

    frames = table("ticks")
    if frames is None:
        raise ValueError(f"no table of ticks in {path}")
    return from_frames(frames, table("player_death"), table("weapon_fire"), table("round_start"), table("header"), tickrate, game)
