"""Match records of third-party tools: battle-royale telemetry and tactical-round dissections."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import clock_seconds, exact_int, number, stable_id, truth
from ..schema import OPEN_END, Matches

#: Kinds of telemetry events.
KILLS = ("LogPlayerKill", "LogPlayerKillV2")


def _get(path: str, column: str = "e") -> Column:
    return F.get_json_object(column, f"$.{path}")


def _who(path: str) -> Column:
    return F.coalesce(F.nullif(_get(f"{path}.accountId"), F.lit("")), F.nullif(_get(f"{path}.name"), F.lit("")))


def telemetry(files: DataFrame, tickrate: float = 10.0) -> Matches:
    """Matches of telemetry files (match_id, value), each a list of events.

    Ticks count from the first kill, position or shot in the file's order.
    """
    spark = files.sparkSession
    events = files.select("match_id", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "e")).select("match_id", F.col("pos").cast("long").alias("seq"), "e", _get("_T").alias("kind"), F.unix_micros(F.try_to_timestamp(_get("_D"))).alias("us"))
    timed = events.filter(F.col("kind").isin(*KILLS, "LogPlayerPosition", "LogPlayerAttack"))
    killer = F.coalesce(_who("killer"), _who("finisher"))
    usable = F.when(F.col("kind").isin(*KILLS), killer.isNotNull() & _who("victim").isNotNull() & (killer != _who("victim"))).when(F.col("kind") == "LogPlayerPosition", _who("character").isNotNull() & _get("character.location").isNotNull()).otherwise(_who("attacker").isNotNull())
    timed = timed.filter(usable)
    base = timed.filter("us is not null").groupBy("match_id").agg(F.min_by("us", "seq").alias("base"))
    timed = timed.join(base, "match_id", "left").withColumn("tick", F.coalesce(((F.col("us") - F.col("base")) / 1e6 * tickrate).cast("int"), F.lit(0)))
    people = None
    for path in ("victim", "killer", "finisher", "character", "attacker"):
        each = events.select("match_id", "seq", _who(path).alias("account"), _get(f"{path}.name").alias("name"), exact_int(_get(f"{path}.teamId")).cast("int").alias("team"))
        people = each if people is None else people.unionByName(each)
    listed = events.filter("kind = 'LogMatchStart'").select("match_id", "seq", F.explode(F.from_json(_get("characters"), "array<string>")).alias("c"))
    inner = F.coalesce(F.get_json_object("c", "$.character"), F.col("c"))
    listed = listed.select("match_id", "seq", inner.alias("c")).select("match_id", "seq", F.coalesce(F.get_json_object("c", "$.accountId"), F.get_json_object("c", "$.name")).alias("account"), F.get_json_object("c", "$.name").alias("name"), exact_int(F.get_json_object("c", "$.teamId")).cast("int").alias("team"))
    people = people.unionByName(listed).filter("account is not null").withColumn("steamid", stable_id("account"))
    players = people.groupBy("match_id", "steamid").agg(F.min_by(F.coalesce("name", "account"), "seq").alias("name"), F.coalesce(F.max_by("team", F.when(F.col("team") != 0, F.col("seq"))), F.lit(0)).alias("team"))
    weapon = F.coalesce(_get("damageCauserName"), _get("killerDamageInfo.damageCauserName"), _get("weapon.itemId"), _get("weapon"), F.lit(""))
    kills = timed.filter(F.col("kind").isin(*KILLS)).select("match_id", "seq", "tick", stable_id(killer).alias("attacker"), stable_id(_who("victim")).alias("victim"), weapon.alias("weapon"), (F.lower(F.coalesce(_get("damageReason"), F.lit(""))) == "headshot").alias("headshot"), F.lit(1).alias("round_num"), F.lit(False).alias("noscope"), F.lit(False).alias("through_smoke"), F.lit(0).alias("penetrated"))
    at = timed.filter("kind = 'LogPlayerPosition'").withColumn("steamid", stable_id(_who("character")))
    at = at.join(players.select("match_id", "steamid", "team"), ["match_id", "steamid"])
    ticks = at.select("match_id", "seq", "tick", "steamid", *[number(_get(f"character.location.{k}")).alias(k) for k in "xyz"], F.lit(0.0).alias("pitch"), F.lit(0.0).alias("yaw"), F.lit(True).alias("is_alive"), "team", exact_int(_get("character.health"), 100).cast("int").alias("health"), F.lit(1).alias("round_num"), F.lit(0).alias("keys"))
    shots = timed.filter("kind = 'LogPlayerAttack'").select("match_id", "seq", "tick", stable_id(_who("attacker")).alias("steamid"), weapon.alias("weapon"), F.lit(1).alias("round_num"))
    starts = events.filter("kind = 'LogMatchStart'").groupBy("match_id").agg(F.min_by(F.coalesce(_get("mapName"), _get("map")), "seq").alias("map_name"))
    rounds = starts.select("match_id", F.lit(1).alias("number"), F.lit(0).alias("start_tick"), F.lit(OPEN_END).alias("end_tick"))
    return Matches(ticks, kills, shots, rounds, players, _matches(files, starts, kills, ticks, shots, players, "pubg", tickrate, spark))


def _matches(files, told, kills, ticks, shots, players, game, tickrate, spark) -> DataFrame:
    out = files.select("match_id").join(told, "match_id", "left")
    for df, name in ((kills, "kills"), (ticks, "positions"), (shots, "shots")):
        if df is not None:
            out = out.join(df.select("match_id").distinct().withColumn(name, F.lit(True)), "match_id", "left")
        else:
            out = out.withColumn(name, F.lit(False))
    sides = players.filter("team <> 0").groupBy("match_id").agg((F.countDistinct("team") >= 2).alias("teams"))
    out = out.join(sides, "match_id", "left")
    caps = F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("kills", "positions", "shots", "teams")]))
    return out.select("match_id", F.col("match_id").alias("source"), F.coalesce("map_name", F.lit("unknown")).alias("map_name"), F.lit(game).alias("game"), F.lit(float(tickrate)).alias("tickrate"), caps.alias("capabilities"))


def dissections(files: DataFrame, tickrate: float = 1.0) -> Matches:
    """Matches of round files (match_id, value), each a round or a list of them; kills only.

    Rounds follow one another, each as long as its last kill, at least one
    second, and one second apart.  Names are looked up among the players of the
    match; of equal names the one seen last counts.
    """
    spark = files.sparkSession
    listed = F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    rounds = files.select("match_id", F.posexplode(listed).alias("i", "e")).withColumn("number", exact_int(F.coalesce(_get("header.roundNumber"), _get("roundNumber"), (F.col("i") + 1).cast("string"))).cast("int"))
    people = rounds.select("match_id", "i", F.posexplode(F.from_json(_get("players"), "array<string>")).alias("j", "p"))
    ident = F.coalesce(*[F.nullif(F.get_json_object("p", f"$.{k}"), F.lit("")) for k in ("profileID", "id", "username")])
    people = people.select("match_id", F.struct("i", "j").alias("at"), stable_id(ident).alias("steamid"), F.coalesce(F.get_json_object("p", "$.username"), F.lit("")).alias("name"), (exact_int(F.get_json_object("p", "$.teamIndex")).cast("int") + 2).alias("team")).filter("steamid is not null")
    players = people.groupBy("match_id", "steamid").agg(F.min_by("name", "at").alias("name"), F.max_by("team", "at").alias("team"), F.min("at").alias("first"))
    names = players.groupBy("match_id", "name").agg(F.max_by("steamid", "first").alias("steamid"))
    events = rounds.select("match_id", "i", "number", F.posexplode(F.from_json(_get("matchFeedback"), "array<string>")).alias("j", "f"))
    get = lambda k: F.get_json_object("f", f"$.{k}")
    events = events.filter(F.lower(F.trim(F.coalesce(get("type.name"), get("type")))) == "kill")
    seconds = F.coalesce(get("timeInSeconds").try_cast("double"), clock_seconds(get("time")), F.lit(0.0))
    kills = events.select("match_id", "i", "j", "number", get("username").alias("a"), get("target").alias("b"), seconds.alias("s"), F.coalesce(get("weapon"), F.lit("")).alias("weapon"), truth(get("headshot")).alias("headshot"))
    for side, who in (("a", "attacker"), ("b", "victim")):
        kills = kills.join(names.select("match_id", F.col("name").alias(side), F.col("steamid").alias(who)), ["match_id", side])
    kills = kills.filter("attacker <> victim")
    length = rounds.select("match_id", "i", "number").join(kills.groupBy("match_id", "i").agg(F.max("s").alias("s")), ["match_id", "i"], "left").withColumn("length", F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(1.0)))
    w = W.partitionBy("match_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    length = length.withColumn("start", F.coalesce(F.sum(F.col("length") + 1).over(w), F.lit(0.0)))
    kept = kills.join(length.select("match_id", "i", "start"), ["match_id", "i"])
    kept = kept.select("match_id", (F.col("i").cast("long") * (1 << 20) + F.col("j")).alias("seq"), ((F.col("start") + F.col("s")) * tickrate).cast("int").alias("tick"), "attacker", "victim", "weapon", "headshot", F.col("number").alias("round_num"), F.lit(False).alias("noscope"), F.lit(False).alias("through_smoke"), F.lit(0).alias("penetrated"))
    spans = length.select("match_id", "number", (F.col("start") * tickrate).cast("int").alias("start_tick"), ((F.col("start") + F.col("length")) * tickrate).cast("int").alias("end_tick"))
    told = rounds.groupBy("match_id").agg(F.max_by(F.coalesce(_get("header.map.name"), _get("header.map"), _get("map.name"), _get("map")), "i").alias("map_name"))
    empty = Matches.empty(spark)
    players = players.drop("first")
    return Matches(empty.ticks, kept, empty.shots, spans, players, _matches(files, told, kept, None, None, players, "r6siege", tickrate, spark))
