"""The signals of all players of all matches at once, in long form."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import aim_error, array_mean, array_stdev, distance, mean, median, ramp, ratio, spherical, stdev
from ..operators.timeline import bursts, last_island, sessions, within
from ..params import Params
from ..schema import Matches, indexed, team_of
from . import aims

ID = ["match_id", "steamid"]
#: Rows of a side of a match whose aims are compared with as many of another in one task.
SIDE = 1 << 19
EVIDENCE_LIST = "array<struct<kind:string,round:int,tick:int,detail:string,target:string>>"


def _evidence(kind: str, round_num, tick, detail, target=None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), round_num.cast("int").alias("round"), tick.cast("int").alias("tick"), detail.alias("detail"), (F.lit("") if target is None else target).cast("string").alias("target"))


def _gathered(when: Column | None, order: list[str], item: Column, n: int) -> Column:
    """The first n items of the group, in the order of the columns, as an aggregate."""
    row = F.struct(*order, item.alias("item"))
    return F.slice(F.transform(F.sort_array(F.collect_list(row if when is None else F.when(when, row))), lambda x: x["item"]), 1, n)


def _signal(df: DataFrame, name: str, value: Column, samples: Column, confident: Column, raw: dict[str, Column], evidence: Column | str | None = None) -> DataFrame:
    pairs = [x for k, v in raw.items() for x in (F.lit(k), v.cast("double"))]
    none = F.array().cast(EVIDENCE_LIST)
    shown = none if evidence is None else F.coalesce(F.col(evidence) if isinstance(evidence, str) else evidence, none)
    return df.select(*ID, F.lit(name).alias("name"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"), F.coalesce(samples.cast("long"), F.lit(0)).alias("samples"), F.coalesce(confident, F.lit(False)).alias("confident"), F.create_map(*pairs).alias("raw"), shown.alias("evidence"))


def _several(df: DataFrame, entries: list[tuple]) -> DataFrame:
    """Several signals of each row at once, so that what they are made of is computed once."""
    kind = "struct<name:string,value:double,samples:bigint,confident:boolean,raw:map<string,double>,evidence:" + EVIDENCE_LIST + ">"
    each = []
    for name, value, samples, confident, raw, shown in entries:
        pairs = [x for k, v in raw.items() for x in (F.lit(k), v.cast("double"))]
        evidence = F.coalesce(F.col(shown) if isinstance(shown, str) else shown, F.array().cast(EVIDENCE_LIST))
        each.append(F.struct(F.lit(name).alias("name"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"), F.coalesce(samples.cast("long"), F.lit(0)).alias("samples"), F.coalesce(confident, F.lit(False)).alias("confident"), F.create_map(*pairs).alias("raw"), evidence.alias("evidence")).cast(kind))
    return df.select(*ID, F.explode(F.array(*each)).alias("s")).select(*ID, "s.*")


def _own_kills(m: Matches) -> DataFrame:
    """Kills of others, with the attacker as steamid and the victim's name."""
    names = team_of(m).select("match_id", F.col("steamid").alias("victim"), F.col("name").alias("victim_name"))
    own = m.kills.filter("attacker <> victim").withColumnRenamed("attacker", "steamid").join(names, ["match_id", "victim"], "left")
    return own.withColumn("victim_name", F.coalesce("victim_name", F.col("victim").cast("string")))


def _side(ticks: DataFrame, who: str, prefix: str, columns: tuple[str, ...] = ("x", "y", "z", "pitch", "yaw", "is_alive")) -> DataFrame:
    """One row a player and tick, named for a side of a join."""
    return ticks.select("match_id", F.col("steamid").alias(who), "tick", *[F.col(c).alias(f"{prefix}{c}") for c in columns])


def _listed(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row a key with an array of each column, in the order of the first."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rows"))
    return rows.select(*keys, *[F.col(f"_rows.{c}").alias(c) for c in columns])


def _roster(m: Matches, counted: DataFrame) -> DataFrame:
    """counted for every player of the roster, nulls where there is nothing."""
    return m.players.select(*ID).distinct().join(counted, ID, "left")


def snap(m: Matches, p: Params) -> DataFrame:
    """snap and jitter: how the aim comes to the victim around the first shot of the fight."""
    c, back, gap = p.snap, int(p.ticks(2500)), int(p.ticks(250))
    kills = _own_kills(m).select(*ID, "seq", "victim", "victim_name", F.col("tick").alias("kill_tick"), "round_num").withColumn("low", F.col("kill_tick") - back)
    shots = m.shots.select(*ID, F.col("tick").alias("shot"))
    near = within(kills, shots, ID, "low", "kill_tick", "shot", 256).groupBy(*ID, "seq").agg(F.sort_array(F.collect_list("shot"), asc=False).alias("shots"))
    kills = kills.join(near, [*ID, "seq"], "left")
    # Back from the last shot, as long as shots are no more than the gap apart.
    chain = F.aggregate("shots", F.struct(F.element_at("shots", 1).alias("at"), F.lit(True).alias("open")), lambda a, t: F.struct(F.when(a["open"] & (a["at"] - t <= gap), t).otherwise(a["at"]).alias("at"), (a["open"] & (a["at"] - t <= gap)).alias("open")), lambda a: a["at"])
    kills = kills.withColumn("anchor", F.when(F.size(F.coalesce("shots", F.array().cast("array<int>"))) > 0, chain).otherwise(F.col("kill_tick"))).drop("shots", "low")
    at = kills.withColumn("tick", F.explode(F.sequence(F.col("anchor") - c.lookback_ticks, F.col("anchor") + c.lookahead_ticks)))
    ticks = indexed(m.ticks)
    seen = at.join(_side(ticks, "steamid", "a_"), [*ID, "tick"]).join(_side(ticks, "victim", "b_"), ["match_id", "victim", "tick"], "left")
    error = F.when(F.col("b_is_alive"), aim_error("a_", "b_"))
    frames = seen.groupBy(*ID, "seq", "victim_name", "kill_tick", "round_num").agg(F.sort_array(F.collect_list(F.struct("tick", F.col("a_pitch").alias("pitch"), F.col("a_yaw").alias("yaw"), error.alias("error")))).alias("f"))
    frames = frames.withColumn("errors", F.transform("f", lambda x: x["error"])).withColumn("known", F.filter("errors", lambda e: e.isNotNull())).filter((F.size("f") >= 4) & (F.size("known") >= 4))
    frames = frames.withColumn("peak", F.coalesce(F.array_max(F.transform(F.sequence(F.lit(2), F.size("f")), lambda i: spherical(F.element_at("f", i - 1)["pitch"], F.element_at("f", i - 1)["yaw"], F.element_at("f", i)["pitch"], F.element_at("f", i)["yaw"]))), F.lit(0.0)))
    # At each place: whether the aim stays, without leaving again, once it is there.
    tail = lambda i: F.filter(F.slice("errors", i, 10_000), lambda e: e.isNotNull())
    stays = F.transform(F.sequence(F.lit(1), F.size("errors")), lambda i: ~F.exists(F.slice("errors", i + 1, c.lookback_ticks), lambda e: F.coalesce(e > c.on_target_deg * 2.5, F.lit(False))) & (F.size(tail(i)) >= c.post_lock_min_ticks) & (array_stdev(tail(i)) <= c.post_lock_max_stdev))
    frames = frames.withColumn("marks", F.arrays_zip("errors", stays.alias("stays"), F.sequence(F.lit(1), F.size("errors")).alias("at")))
    frames = frames.withColumn("marks", F.transform("marks", lambda x: F.struct(x["errors"].alias("error"), x["stays"].alias("stays"), x["at"].alias("at"))))
    none = F.lit(None).cast("int")

    def scan(a: Column, x: Column) -> Column:
        off, on = F.coalesce(x["error"] >= c.off_target_deg, F.lit(False)), F.coalesce(x["error"] <= c.on_target_deg, F.lit(False)) & a["off"].isNotNull()
        hit = on & a["to"].isNull() & (x["at"] - a["off"] <= c.max_transition_ticks) & x["stays"]
        return F.struct(F.when(off, x["at"]).when(on, none).otherwise(a["off"]).alias("off"), F.when(hit, a["off"]).otherwise(a["from"]).alias("from"), F.when(hit, x["at"]).otherwise(a["to"]).alias("to"))

    frames = frames.withColumn("hit", F.aggregate("marks", F.struct(none.alias("off"), none.alias("from"), none.alias("to")), scan))
    frames = frames.withColumn("locked", F.filter("known", lambda e: e <= c.jitter_window_deg))
    frames = frames.withColumn("snapped", F.col("hit.to").isNotNull()).withColumn("windowed", F.size("locked") >= c.min_jitter_samples).withColumn("flat", F.col("windowed") & (array_stdev(F.col("locked")) <= c.low_jitter_deg))
    off, on = F.element_at("errors", F.col("hit.from")), F.element_at("errors", F.col("hit.to"))
    detail = F.format_string("error %.1f deg -> %.1f deg in %d tick(s), peak %.0f deg/tick", off, on, F.col("hit.to") - F.col("hit.from"), F.col("peak"))
    snapped = _evidence("snap", F.col("round_num"), F.element_at("f", F.col("hit.to"))["tick"], detail, F.col("victim_name"))
    still = _evidence("flat_aim", F.col("round_num"), F.col("kill_tick"), F.format_string("mean error %.2f deg, deviation %.3f deg in %d ticks", array_mean(F.col("locked")), array_stdev(F.col("locked")), F.size("locked")), F.col("victim_name"))
    counted = _roster(m, frames.groupBy(*ID).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("snapped").alias("snaps"), F.count_if(F.col("peak") >= c.extreme_angvel).alias("extreme"), F.avg("peak").alias("peak"), F.count_if("windowed").alias("locked"), F.count_if("flat").alias("flat"),
        _gathered(F.col("snapped"), ["seq"], snapped, 8).alias("seen"), _gathered(F.col("flat"), ["seq"], still, 6).alias("stills"),
    )).withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n", "snaps", "extreme", "locked", "flat")})
    snap_rate, flat_rate = ratio("snaps", "n"), ratio("flat", "locked")
    value = F.greatest(ramp(snap_rate, 0.05, 0.45), 0.7 * ramp(ratio("extreme", "n"), 0.10, 0.60))
    entries = [
        ("snap", value, F.col("n"), F.col("n") >= 5, {"kills": F.col("n"), "snaps": F.col("snaps"), "snap_rate": F.round(snap_rate, 3), "extreme_flicks": F.col("extreme"), "mean_peak": F.round(F.coalesce("peak", F.lit(0.0)), 1)}, "seen"),
        ("jitter", ramp(flat_rate, 0.15, 0.70), F.col("locked"), F.col("locked") >= 4, {"windows": F.col("locked"), "flat": F.col("flat"), "flat_rate": F.round(flat_rate, 3)}, "stills"),
    ]
    return _several(counted, entries)


def reaction(m: Matches, p: Params) -> DataFrame:
    """Time from when the victim came into view of a resting aim to the first shot."""
    c = p.reaction
    wide, ticks = c.fov_deg * 1.05, indexed(m.ticks)
    kills = _own_kills(m).select(*ID, "seq", "victim", "victim_name", F.col("tick").alias("kill_tick"), "round_num")
    # Whether a player sees another at a tick is found once for all kills of that pair, in stretches of 256 ticks.
    spread = kills.withColumn("_stretch", F.explode(F.sequence(F.floor((F.col("kill_tick") - 255) / 256), F.floor(F.col("kill_tick") / 256))))
    own = _side(ticks, "steamid", "a_").filter("a_is_alive").drop("a_is_alive").withColumn("_stretch", F.floor(F.col("tick") / 256))
    both = spread.select(*ID, "victim", "_stretch").distinct().join(own, [*ID, "_stretch"]).join(_side(ticks, "victim", "b_", ("x", "y", "z", "is_alive")).filter("b_is_alive"), ["match_id", "victim", "tick"])
    good = both.filter(distance("a_x", "a_y", "a_z", "b_x", "b_y", "b_z") <= c.max_range).filter(aim_error("a_", "b_") <= wide)
    seen = good.groupBy(*ID, "victim", "_stretch").agg(F.collect_list("tick").alias("seen"))  # 256 at most
    found = spread.join(seen, [*ID, "victim", "_stretch"]).groupBy(*ID, "seq", "victim", "victim_name", "kill_tick", "round_num").agg(F.flatten(F.collect_list("seen")).alias("ok"))
    found = found.withColumn("ok", F.sort_array(F.filter("ok", lambda t: t.between(F.col("kill_tick") - 255, F.col("kill_tick"))), asc=False))
    found = found.withColumn("exposure", last_island(F.col("ok"), F.col("kill_tick"), 5)).filter("exposure is not null").drop("ok")
    # What stands just before the exposure: the error six ticks earlier, and how fast the aim moved.
    near = found.withColumn("tick", F.explode(F.sequence(F.col("exposure") - F.lit(max(6, c.steady_ticks)), F.col("exposure"))))
    near = near.join(_side(ticks, "steamid", "a_"), [*ID, "tick"]).join(_side(ticks, "victim", "b_"), ["match_id", "victim", "tick"], "left")
    keys = [*ID, "seq", "victim_name", "kill_tick", "round_num", "exposure"]
    near = near.groupBy(*keys).agg(
        F.max(F.when((F.col("tick") == F.col("exposure") - 6) & F.col("b_x").isNotNull(), aim_error("a_", "b_"))).alias("before"),
        F.sort_array(F.collect_list(F.when(F.col("tick") >= F.col("exposure") - c.steady_ticks, F.struct("tick", "a_pitch", "a_yaw")))).alias("f"),
    ).filter((F.col("before").isNull() | (F.col("before") > wide)) & (F.size("f") >= 3))
    moved = F.transform(F.sequence(F.lit(2), F.size("f")), lambda i: spherical(F.element_at("f", i - 1)["a_pitch"], F.element_at("f", i - 1)["a_yaw"], F.element_at("f", i)["a_pitch"], F.element_at("f", i)["a_yaw"]))
    near = near.filter(F.array_max(moved) <= c.steady_deg_per_tick).drop("before", "f")
    spread = near.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col("exposure") / 256), F.floor(F.col("kill_tick") / 256))))
    shots = m.shots.select(*ID, F.col("tick").alias("shot"), F.floor(F.col("tick") / 256).alias("_stretch"))
    fired = spread.join(shots, [*ID, "_stretch"], "left").groupBy(*keys).agg(F.min(F.when(F.col("shot").between(F.col("exposure"), F.col("kill_tick")), F.col("shot"))).alias("shot"))
    found = fired.withColumn("ms", p.ms(F.coalesce("shot", "kill_tick") - F.col("exposure"))).filter("ms between 0 and 2000")
    item = _evidence("reaction", F.col("round_num"), F.col("exposure"), F.format_string("shot %.0f ms after the target came into view", "ms"), F.col("victim_name"))
    counted = _roster(m, found.groupBy(*ID).agg(F.count(F.lit(1)).alias("n"), F.median("ms").alias("median"), F.avg("ms").alias("mean"), stdev("ms").alias("sd"), F.count_if(F.col("ms") <= c.fast_ms).alias("fast"), F.count_if(F.col("ms") <= c.impossible_ms).alias("impossible"), _gathered(F.col("ms") <= c.impossible_ms, ["seq"], item, 8).alias("seen")))
    enough = F.coalesce(F.col("n") >= c.min_samples, F.lit(False))
    consistency = ramp("sd", c.low_stdev_ms * 2.0, c.low_stdev_ms * 0.4) * F.when(F.col("median") > c.fast_ms * 1.5, 0.3).otherwise(1.0)
    value = F.when(enough, F.greatest(ramp(ratio("impossible", "n"), 0.05, 0.40), 0.85 * ramp(ratio("fast", "n"), 0.25, 0.80), 0.75 * consistency)).otherwise(0.0)
    raw = {"samples": F.coalesce("n", F.lit(0)), "median_ms": F.when(enough, F.round("median", 1)), "mean_ms": F.when(enough, F.round("mean", 1)), "sd_ms": F.when(enough, F.round("sd", 1)), "fast_rate": F.when(enough, F.round(ratio("fast", "n"), 3)), "impossible": F.when(enough, F.col("impossible"))}
    return _signal(counted, "reaction", value, F.col("n"), enough, raw, "seen")


def tracking(m: Matches, p: Params) -> DataFrame:
    """tracking and prefire: the aim follows, or already rests on, an enemy without any action."""
    c, team = p.tracking, team_of(m)
    ticks = indexed(m.ticks)
    # A side's players are dealt to parts of about SIDE rows, to four sooner; each part meets each of other sides in one task, which keeps no pairs but for its own.
    sizes = m.ticks.groupBy(*ID).agg(F.count(F.lit(1)).alias("rows")).join(team, ID).groupBy("match_id", "team").agg(F.sum("rows").alias("rows"))
    parts = F.greatest(F.ceil(F.col("rows") / SIDE), F.least(F.lit(4), F.ceil(F.col("rows") * 8 / SIDE))).cast("int")
    split = sizes.groupBy("match_id").agg(F.collect_list(F.struct("team", parts.alias("parts"))).alias("split"))  # a row a match

    def dealt(listed: DataFrame, own: str, who: str, other: str) -> DataFrame:
        """listed, of team own_team, with the part of its player and, in a row each, the parts of others."""
        parts = F.filter("split", lambda s: s["team"] == F.col(f"{own}_team"))[0]["parts"]
        rows = listed.join(F.broadcast(split), "match_id").withColumn(f"{own}_part", F.pmod(F.xxhash64(who), parts).cast("int"))
        rows = rows.withColumn("side", F.explode(F.filter("split", lambda s: s["team"] != F.col(f"{own}_team")))).drop("split")
        return rows.withColumn(f"{other}_team", F.col("side.team")).withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.col("side.parts") - 1))).drop("side")

    acts = m.shots.select(*ID, "tick").unionByName(m.kills.select("match_id", F.col("attacker").alias("steamid"), "tick")).unionByName(m.kills.select("match_id", F.col("victim").alias("steamid"), "tick"))
    acts = acts.groupBy(*ID).agg(F.sort_array(F.collect_set("tick")).alias("acts"))
    me = m.ticks.withColumn("rn", F.row_number().over(W.partitionBy(*ID).orderBy("seq"))).filter("is_alive and tick is not null and x is not null and y is not null and z is not null and pitch is not null and yaw is not null")
    me = _listed(me.withColumnRenamed("round_num", "round"), ID, ["rn", "tick", "round", "x", "y", "z", "pitch", "yaw"]).join(acts, ID, "left")
    me = dealt(me.join(team.select(*ID, F.col("team").alias("a_team")), ID), "a", "steamid", "b").filter("b_team <> 0")
    him = _listed(ticks.filter("is_alive and tick is not null and x is not null and y is not null and z is not null").withColumnRenamed("steamid", "enemy"), ["match_id", "enemy"], ["tick", "x", "y", "z"])
    him = him.join(team.filter("team <> 0").select("match_id", F.col("steamid").alias("enemy"), F.col("name").alias("enemy_name"), F.col("team").alias("b_team")), ["match_id", "enemy"])
    him = dealt(him, "b", "enemy", "a")
    him = him.toDF(*him.columns)  # names of its own, as both sides come from the same tables
    tile = ["match_id", "a_team", "a_part", "b_team", "b_part"]
    folded = me.groupBy(*tile).cogroup(him.groupBy(*tile)).applyInArrow(aims.follow(c, 8), aims.FOUND)
    detail = lambda i: F.format_string("aim followed %.0f deg of target movement for %.0f ms at %.0f units without a shot", i["travel"], p.ms(i["span"]).cast("double"), i["d"])
    shown = F.transform("items", lambda i: F.struct(i["rn"].alias("rn"), i["target"].alias("who"), F.struct(F.lit("wall_track").alias("kind"), i["round"].alias("round"), i["start"].alias("tick"), detail(i).alias("detail"), i["target"].alias("target")).alias("item")))
    items = F.sort_array(F.flatten(F.collect_list("shown")))
    counted = folded.withColumn("shown", shown).groupBy(*ID).agg(F.sum("episodes").alias("episodes"), F.sum("locked").alias("locked"), F.slice(F.transform(items, lambda i: i["item"]), 1, 8).alias("seen"))
    alive = m.ticks.groupBy(*ID).agg(F.count_if("is_alive").alias("alive"), F.count(F.lit(1)).alias("rows"))
    rounds = m.rounds.groupBy("match_id").agg(F.count(F.lit(1)).alias("rounds"))
    sides = team.filter("team <> 0").groupBy("match_id").agg(F.min("team").alias("low"), F.max("team").alias("high"))
    has = team.join(sides, "match_id").filter("team <> low or team <> high").select(*ID).distinct().withColumn("has", F.lit(True))
    counted = _roster(m, counted).join(alive, ID, "left").join(rounds, "match_id", "left").join(has, ID, "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("episodes", "locked")}).withColumn("rounds", F.greatest(F.coalesce("rounds", F.lit(0)), F.lit(1)))
    per_round, share = ratio("episodes", "rounds"), ratio("locked", "alive")
    samples = F.when(F.col("has"), F.col("alive")).otherwise(F.coalesce("rows", F.lit(0)))
    a = _signal(counted, "tracking", F.greatest(ramp(per_round, 0.10, 0.90), 0.8 * ramp(share, 0.003, 0.04)), samples, F.col("has") & (F.col("alive") >= 2000), {"episodes": F.col("episodes"), "episodes_per_round": F.round(per_round, 2), "locked_ticks": F.col("locked"), "share_of_life": F.round(share, 4)}, "seen")
    return a.unionByName(_prefire(m, p, ticks, has))


def _prefire(m: Matches, p: Params, ticks: DataFrame, has: DataFrame) -> DataFrame:
    offsets = [int(p.ticks(500)), int(p.ticks(1000))]
    kills = _own_kills(m).select(*ID, "seq", "victim", "victim_name", F.col("tick").alias("kill_tick"), "round_num").join(has, ID, "left_semi")
    at = kills.withColumn("off", F.explode(F.array(*map(F.lit, offsets)))).withColumn("tick", F.col("kill_tick") - F.col("off"))
    both = at.join(_side(ticks, "steamid", "a_"), [*ID, "tick"]).join(_side(ticks, "victim", "b_"), ["match_id", "victim", "tick"]).filter("a_is_alive and b_is_alive").withColumn("error", aim_error("a_", "b_"))
    seen = both.groupBy(*ID, "seq", "victim_name", "kill_tick", "round_num").agg(F.count(F.lit(1)).alias("n"), F.max("error").alias("error")).filter(F.col("n") == len(offsets)).withColumn("hit", F.col("error") <= p.tracking.lock_deg)
    item = _evidence("prefire", F.col("round_num"), F.col("kill_tick") - offsets[-1], F.format_string("aim was on the target already, at most %.1f deg off", "error"), F.col("victim_name"))
    counted = _roster(m, seen.groupBy(*ID).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), _gathered(F.col("hit"), ["seq"], item, 6).alias("seen"))).withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n", "hits")})
    rate = ratio("hits", "n")
    return _signal(counted, "prefire", ramp(rate, 0.15, 0.65), F.col("n"), F.col("n") >= 5, {"kills": F.col("n"), "hits": F.col("hits"), "rate": F.round(rate, 3)}, "seen")


def recoil(m: Matches, p: Params) -> DataFrame:
    """Bursts of shots whose error is too small and too even."""
    c, ticks = p.recoil, indexed(m.ticks)
    shots = sessions(m.shots, ID, ["tick", "seq"], "tick", c.max_gap_ticks, "burst")
    groups = shots.groupBy(*ID, "burst").agg(F.min("tick").alias("start"), F.max("tick").alias("end"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= c.min_shots).withColumn("until", F.col("end") + 64)
    kills = _own_kills(m).select(*ID, "seq", "victim", "victim_name", F.col("tick").alias("kill_tick"))
    hit = within(groups, kills, ID, "start", "until", "kill_tick", 256).groupBy(*ID, "burst", "start").agg(F.min_by(F.struct("victim", "victim_name"), "seq").alias("v"))
    hit = hit.select(*ID, "burst", "start", "v.victim", "v.victim_name")
    both = shots.join(hit, [*ID, "burst"]).join(_side(ticks, "steamid", "a_"), [*ID, "tick"]).join(_side(ticks, "victim", "b_"), ["match_id", "victim", "tick"]).filter("b_is_alive").withColumn("error", aim_error("a_", "b_"))
    series = both.groupBy(*ID, "burst", "start", "victim_name").agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean"), stdev("error").alias("sd")).filter(F.col("n") >= c.min_shots)
    series = series.withColumn("perfect", (F.col("mean") <= c.perfect_error_deg) & (F.col("sd") <= c.flat_spread_deg))
    # The round of a burst is the first that holds its start; rounds of a match are few.
    listed = m.rounds.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("start_tick", "number", "end_tick"))).alias("rounds"))
    series = series.join(listed, "match_id", "left").withColumn("round_num", F.coalesce(F.try_element_at(F.filter("rounds", lambda r: F.col("start").between(r["start_tick"], r["end_tick"])), F.lit(1))["number"], F.lit(0)))
    item = _evidence("recoil", F.col("round_num"), F.col("start"), F.format_string("%d shots with mean error %.2f deg and spread %.2f deg", "n", "mean", "sd"), F.col("victim_name"))
    counted = _roster(m, series.groupBy(*ID).agg(F.count(F.lit(1)).alias("n"), F.count_if("perfect").alias("perfect"), F.avg("mean").alias("error"), _gathered(F.col("perfect"), ["start"], item, 6).alias("seen"))).withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n", "perfect")})
    rate = ratio("perfect", "n")
    return _signal(counted, "recoil", ramp(rate, 0.15, 0.65), F.col("n"), F.col("n") >= c.min_bursts, {"bursts": F.col("n"), "perfect": F.col("perfect"), "rate": F.round(rate, 3), "mean_error": F.round("error", 2)}, "seen")


def movement(m: Matches, p: Params) -> DataFrame:
    """Jumps of the aim, and how often it comes straight back."""
    c = p.movement
    w = W.partitionBy(*ID).orderBy("seq")
    rows = m.ticks.filter("is_alive").select(*ID, "seq", "tick", "pitch", "yaw", "round_num")
    looked = {"p0": F.lag("pitch").over(w), "y0": F.lag("yaw").over(w), "t0": F.lag("tick").over(w)}
    for k in range(1, c.return_window_ticks + 1):
        looked |= {f"p{k}n": F.lead("pitch", k).over(w), f"y{k}n": F.lead("yaw", k).over(w)}
    rows = rows.withColumns(looked).withColumn("pair", F.coalesce(F.col("tick") - F.col("t0") == 1, F.lit(False))).withColumn("jump", F.when(F.col("pair"), spherical("p0", "y0", "pitch", "yaw")))
    deltas = [spherical("p0", "y0", f"p{k}n", f"y{k}n") for k in range(1, c.return_window_ticks + 1)]
    back = F.coalesce(*[F.when(d <= c.return_tolerance_deg, d) for d in deltas])
    rows = rows.withColumn("back", F.when(F.col("jump") >= c.snap_back_deg, back))
    counted = _roster(m, rows.groupBy(*ID).agg(F.count(F.lit(1)).alias("alive"), F.count_if("pair").alias("n"), F.count_if(F.col("jump") >= c.teleport_deg).alias("teleports"), F.count_if(F.col("jump") >= c.snap_back_deg).alias("jumps"), F.count_if(F.col("back").isNotNull()).alias("returns"), _gathered(F.col("back").isNotNull(), ["seq"], _evidence("silent_aim", F.col("round_num"), F.col("tick"), F.format_string("aim jumped %.0f deg and came back to %.1f deg", "jump", "back")), 8).alias("seen")))
    enough = F.coalesce((F.col("alive") >= 32) & (F.col("n") >= c.min_ticks), F.lit(False))
    samples = F.when(F.coalesce("alive", F.lit(0)) < 32, F.coalesce("alive", F.lit(0))).otherwise(F.col("n"))
    rate = ratio("returns", "jumps")
    value = F.when(enough, F.greatest(0.5 * ramp(ratio("teleports", "n"), 0.0005, 0.006), F.when(F.col("jumps") >= 8, ramp(rate, 0.05, 0.30)).otherwise(0.0))).otherwise(0.0)
    raw = {"ticks": samples, **{k: F.when(enough, F.col(k)) for k in ("teleports", "jumps", "returns")}, "return_rate": F.when(enough, F.round(rate, 3))}
    return _signal(counted, "movement", value, samples, enough & (F.col("jumps") >= 8), raw, F.when(enough, F.col("seen")))


def context(m: Matches, p: Params) -> DataFrame:
    """Shares of kills through smoke, through walls and without a scope."""
    c = p.context
    why = F.array_compact(F.array(F.when(F.col("through_smoke"), "through smoke"), F.when(F.col("penetrated") != 0, F.format_string("through a wall (%d)", "penetrated")), F.when(F.col("noscope"), "without a scope")))
    own = _own_kills(m).withColumn("why", why)
    item = _evidence("context", F.col("round_num"), F.col("tick"), F.concat(F.array_join("why", ", "), F.lit(" with "), F.coalesce(F.nullif("weapon", F.lit("")), F.lit("a weapon"))), F.col("victim_name"))
    counted = own.groupBy(*ID).agg(F.count(F.lit(1)).alias("n"), F.count_if("through_smoke").alias("smoke"), F.count_if(F.col("penetrated") != 0).alias("wall"), F.count_if("noscope").alias("noscope"), _gathered(F.size("why") > 0, ["seq"], item, 6).alias("seen"))
    counted = _roster(m, counted).withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n", "smoke", "wall", "noscope")})
    parts = F.sort_array(F.array(*[ramp(ratio(k, "n"), r * 0.5, r * 2.0) for k, r in (("smoke", c.smoke_rate), ("wall", c.wallbang_rate), ("noscope", c.noscope_rate))]), asc=False)
    enough = F.col("n") >= c.min_kills
    value = F.when(enough, F.least(F.lit(1.0), parts[0] * 0.7 + parts[1] * 0.3)).otherwise(0.0)
    raw = {"kills": F.col("n")} | {k: F.when(enough, F.col(k)) for k in ("smoke", "wall", "noscope")} | {f"{k}_rate": F.when(enough, F.round(ratio(k, "n"), 3)) for k in ("smoke", "wall", "noscope")}
    return _signal(counted, "context", value, F.col("n"), F.col("n") >= c.min_kills * 2, raw, F.when(enough, F.col("seen")))


def burst(m: Matches, p: Params) -> DataFrame:
    """Kills in quick succession, and how even the time between kills is."""
    c = p.burst
    window, own = p.ticks(c.window_ms), _own_kills(m)
    found = bursts(own, [*ID, "round_num"], "tick", ["seq"], window, c.min_burst_kills)
    gaps = own.withColumn("gap", p.ms(F.col("tick") - F.lag("tick").over(W.partitionBy(*ID, "round_num").orderBy("tick", "seq"))))
    counted = _roster(m, gaps.groupBy(*ID).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("round_num").alias("rounds"), F.count("gap").alias("gaps"), F.median("gap").alias("median"), F.stddev_samp("gap").alias("sd")))
    counted = counted.join(found.groupBy(*ID).agg(F.count(F.lit(1)).alias("bursts"), F.max("size").alias("biggest"), _gathered(None, ["round_num", "end"], _evidence("burst", F.col("round_num"), F.col("start"), F.format_string("%d kills in %.0f ms", "size", p.ms(F.col("end") - F.col("start")).cast("double"))), 6).alias("seen")), ID, "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n", "bursts", "biggest", "gaps")})
    enough = F.col("n") >= c.min_kills
    rate = ratio("bursts", F.greatest("rounds", F.lit(1)))
    relative = F.when(F.col("median") != 0, F.coalesce("sd", F.lit(0.0)) / F.col("median")).otherwise(1.0)
    regularity = F.when((F.col("gaps") >= c.min_gap_samples) & (F.col("median") <= c.fast_gap_ms), ramp(relative, 0.55, 0.15)).otherwise(0.0)
    value = F.when(enough, F.greatest(ramp(rate, 0.08, 0.45), 0.7 * regularity)).otherwise(0.0)
    raw = {"kills": F.col("n"), "bursts": F.when(enough, F.col("bursts")), "biggest": F.when(enough, F.col("biggest")), "bursts_per_round": F.when(enough, F.round(rate, 3)), "median_gap_ms": F.when(enough, F.round("median", 1)), "gap_sd_ms": F.when(enough, F.round("sd", 1))}
    return _signal(counted, "burst", value, F.col("n"), enough & (F.col("n") >= c.min_kills * 2) & (F.col("rounds") >= 5), raw, F.when(enough, F.col("seen")))


def cursor(m: Matches, p: Params) -> DataFrame:
    """tremor, cursor_jump and key_timing of two-dimensional input, in the order it was read."""
    c, w = p.cursor, W.partitionBy(*ID).orderBy("seq")
    back = lambda k, n: F.lag(k, n).over(w)
    rows = m.ticks.select(*ID, "seq", "tick", "x", "y", "keys")
    rows = rows.withColumn("n", F.row_number().over(w))
    jerk = F.hypot(*[F.col(k) - 3 * back(k, 1) + 3 * back(k, 2) - back(k, 3) for k in ("x", "y")])
    step = F.hypot(F.col("x") - back("x", 1), F.col("y") - back("y", 1))
    rows = rows.withColumns({"step": step, "jerk": F.when((F.col("n") > 3) & (step >= c.min_speed), jerk / F.greatest(step, F.lit(1e-6))), "speed": step / F.greatest(F.lit(1), F.col("tick") - back("tick", 1))})
    rows = rows.withColumn("next", F.lead("speed").over(w)).withColumn("next_tick", F.col("tick"))
    rows = rows.withColumn("stop", F.coalesce((F.col("speed") >= c.jump_speed) & (F.col("next") < c.stop_speed), F.lit(False)))
    stats = _roster(m, rows.groupBy(*ID).agg(F.count(F.lit(1)).alias("rows"), F.min_by("tick", "seq").alias("first"), F.count("jerk").alias("n"), F.median("jerk").alias("jerk"), F.median(F.when(F.col("jerk").isNotNull(), F.col("step"))).alias("speed"), F.count("speed").alias("speeds"), F.count_if(F.col("speed") >= c.jump_speed).alias("jumps"), F.count_if("stop").alias("stops"), _gathered(F.col("stop"), ["seq"], _evidence("cursor_jump", F.lit(1), F.col("tick"), F.format_string("jump of %.0f px/tick, then a stop (%.2f px/tick)", "speed", "next")), 6).alias("seen"))).withColumns({k: F.coalesce(k, F.lit(0)) for k in ("rows", "n", "speeds", "jumps", "stops")})
    long = F.col("rows") >= c.min_samples
    enough = long & (F.col("n") >= c.min_samples // 4)
    value = F.when(enough, ramp("jerk", c.human_jerk, c.smooth_jerk)).otherwise(0.0)
    one = F.when(enough & (value >= 0.5), F.array(_evidence("tremor", F.lit(1), F.col("first"), F.format_string("median jerk %.3f over %d moving samples", "jerk", "n"))))
    tremor = ("tremor", value, F.when(long, F.col("n")).otherwise(F.col("rows")), enough & (F.col("n") >= c.min_samples // 2), {"moving": F.when(enough, F.col("n")), "median_jerk": F.when(enough, F.round("jerk", 4)), "median_speed": F.when(enough, F.round("speed", 3))}, one)
    rate = ratio("stops", "jumps")
    value = F.when(long, F.greatest(0.4 * ramp(ratio("jumps", "speeds"), 0.001, 0.02), F.when(F.col("jumps") >= 5, ramp(rate, 0.15, 0.6)).otherwise(0.0))).otherwise(0.0)
    jump = ("cursor_jump", value, F.when(long, F.col("speeds")).otherwise(F.col("rows")), long & (F.col("speeds") >= c.min_samples) & (F.col("jumps") >= 5), {k: F.when(long, v) for k, v in {"samples": F.col("speeds"), "jumps": F.col("jumps"), "stops": F.col("stops"), "stop_rate": F.round(rate, 3)}.items()}, F.when(long, F.col("seen")))
    return _several(stats, [tremor, jump]).unionByName(_keys(m, p, rows, stats))


def _keys(m: Matches, p: Params, rows: DataFrame, stats: DataFrame) -> DataFrame:
    c = p.cursor
    w = W.partitionBy(*ID, "key").orderBy("seq")
    each = rows.withColumn("key", F.explode(F.array(*map(F.lit, (1, 2, 4, 8))))).withColumn("down", F.col("keys").bitwiseAND(F.col("key")) != 0)
    turns = each.withColumn("was", F.lag("down", 1, False).over(w)).filter("down <> was")
    turns = turns.withColumn("end", F.lead("tick").over(w)).withColumn("released", F.lag("tick").over(w))
    press = turns.filter("down").withColumn("held", F.col("end") - F.col("tick")).withColumn("gap", F.col("tick") - F.col("released"))
    counted = press.groupBy(*ID).agg(F.count("held").alias("presses"), F.count_if(F.col("held") > 0).alias("n"), F.stddev_samp(F.when(F.col("held") > 0, p.ms(F.col("held")))).alias("sd"), F.avg(F.when(F.col("held") > 0, p.ms(F.col("held")))).alias("mean"), F.median("gap").alias("gap"))
    counted = stats.select(*ID, "rows", "first").join(counted, ID, "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("presses", "n")})
    long = F.col("rows") >= c.min_samples
    enough = long & (F.col("presses") >= c.min_presses) & (F.col("n") >= c.min_presses)
    samples = F.when(~long, F.col("rows")).when(F.col("presses") < c.min_presses, F.col("presses")).otherwise(F.col("n"))
    relative = F.when(F.col("mean") != 0, F.coalesce("sd", F.lit(0.0)) / F.col("mean")).otherwise(1.0)
    value = F.when(enough, ramp(relative, c.human_key_spread, c.robot_key_spread)).otherwise(0.0)
    one = F.when(enough & (value >= 0.5), F.array(_evidence("key_timing", F.lit(1), F.col("first"), F.format_string("%d presses of %.0f ms on average, relative spread %.3f", "n", "mean", relative))))
    raw = {"presses": F.when(enough, F.col("n")), "mean_ms": F.when(enough, F.round("mean", 1)), "sd_ms": F.when(enough, F.round("sd", 1)), "relative_spread": F.when(enough, F.round(relative, 3)), "median_gap_ms": F.when(enough, F.round(p.ms(F.col("gap")), 1))}
    return _signal(counted, "key_timing", value, samples, enough & (F.col("n") >= c.min_presses * 2), raw, one)
