"""Which detectors a match supports, the score of each player, and its flags."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Params
from ..schema import Matches, team_of
from . import signals as s

#: Signals that support no high score alone.
WEAK = ("burst",)


@dataclass(frozen=True)
class Detector:
    """A plan over all matches, the capabilities it needs and the signals it gives."""

    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    plan: Callable[[Matches, Params], DataFrame]


DETECTORS = (
    Detector("snap", ("angles", "kills", "positions"), ("snap", "jitter"), s.snap),
    Detector("reaction", ("angles", "kills", "positions", "shots"), ("reaction",), s.reaction),
    Detector("tracking", ("angles", "positions", "teams"), ("tracking", "prefire"), s.tracking),
    Detector("recoil", ("angles", "kills", "positions", "shots"), ("recoil",), s.recoil),
    Detector("movement", ("angles",), ("movement",), s.movement),
    Detector("context", ("kill_flags", "kills"), ("context",), s.context),
    Detector("burst", ("kills",), ("burst",), s.burst),
    Detector("cursor_tremor", ("cursor",), ("tremor",), s.cursor),
    Detector("cursor_jump", ("cursor",), ("cursor_jump",), s.cursor),
    Detector("cursor_keys", ("cursor", "keys"), ("key_timing",), s.cursor),
)


def missing(capabilities: Column, needs: tuple[str, ...]) -> Column:
    """The needs that are not in an array of capabilities, sorted."""
    return F.sort_array(F.array_except(F.array(*map(F.lit, sorted(needs))), capabilities))


def skipped(matches: DataFrame, extra: tuple[Detector, ...] = ()) -> DataFrame:
    """match_id, signal and the missing capabilities of each signal that a match can't have."""
    rows = [F.struct(F.lit(sig).alias("signal"), missing(F.col("capabilities"), d.needs).alias("missing")) for d in (*DETECTORS, *extra) for sig in d.gives]
    out = matches.select("match_id", F.explode(F.array(*rows)).alias("r")).select("match_id", "r.signal", "r.missing")
    return out.filter(F.size("missing") > 0)


def detect(m: Matches, p: Params | None = None, extra: tuple[Detector, ...] = ()) -> DataFrame:
    """All signals of all players, each only in matches whose capabilities support it.

    One row a match with capabilities is enough to tell which plans any match
    needs; plans that no match supports aren't run.
    """
    p = p or Params()
    have = m.matches.select("match_id", "capabilities")
    known = {frozenset(r[0]) for r in have.select(F.array_sort("capabilities")).distinct().collect()}  # sets of nine capabilities
    out, done = None, set()
    for d in (*DETECTORS, *extra):
        if d.plan in done or not any(set(d.needs) <= k for k in known):
            continue
        done.add(d.plan)
        mine = [x for x in (*DETECTORS, *extra) if x.plan is d.plan]
        allowed = F.filter(F.flatten(F.array(*[F.when(F.size(missing(F.col("capabilities"), x.needs)) == 0, F.array(*map(F.lit, x.gives))).otherwise(F.array().cast("array<string>")) for x in mine])), lambda x: x.isNotNull())
        found = d.plan(m, p).join(have.select("match_id", allowed.alias("_allowed")), "match_id").filter(F.array_contains("_allowed", F.col("name"))).drop("_allowed")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return s._signal(m.players.select(*s.ID).limit(0), "none", F.lit(0.0), F.lit(0), F.lit(False), {"none": F.lit(0.0)})
    return out


def score(found: DataFrame, p: Params | None = None, keys: tuple[str, ...] = ("match_id", "steamid")) -> DataFrame:
    """keys and score, 0 to 100, from signals in long form (name, value, confident).

    The mean by the signals' weights, unconfident ones counting less; two or
    more strong confident signals raise it a little; weak signals alone are
    capped.  Signals without a weight count for the raise only.
    """
    p = p or Params()
    c = p.scoring
    weights = F.create_map(*[F.lit(x) for kv in sorted(c.weights.items()) for x in kv])
    w = F.element_at(weights, F.col("name")) * F.when(F.col("confident"), 1.0).otherwise(c.unconfident_weight)
    got = found.withColumn("_w", w).groupBy(*keys).agg(
        F.sum(F.col("_w") * F.col("value")).alias("_sum"), F.sum("_w").alias("_weight"),
        F.count_if(F.col("confident") & (F.col("value") >= c.strong_value)).alias("_strong"),
        F.bool_and(F.col("name").isin(*WEAK)).alias("_weak"),
    )
    base = F.coalesce(F.try_divide("_sum", "_weight"), F.lit(0.0))
    raised = F.when(F.col("_strong") >= 2, F.least(F.lit(1.0), base * (1 + c.corroboration * (F.col("_strong") - 1)))).otherwise(base) * 100
    # Millionths of a tenth first: in which order weights were summed decides no half.
    shown = F.when((F.col("_weight") > 0) & F.col("_weak"), F.least(raised, F.lit(c.weak_only_cap))).otherwise(raised)
    return got.select(*keys, (F.rint(F.rint(shown * 1e7) / 1e6) / 10).alias("score"))


def flags(p: Params, entries: Column, kills: Column, hs_pct: Column, scored: Column) -> Column:
    """Flags of a player from the entries (name, value, confident) of its signals."""
    c = p.scoring
    small = kills < c.min_kills_for_score
    names = F.transform(entries, lambda e: e["name"])
    weak = (F.size(names) > 0) & (F.size(F.array_except(names, F.array(*map(F.lit, WEAK)))) == 0)
    each = F.transform(entries, lambda e: F.when(e["confident"] & (e["value"] >= 0.6), F.concat(F.lit("strong:"), e["name"])).when(e["confident"] & (e["value"] >= 0.35), F.concat(F.lit("moderate:"), e["name"])))
    tail = F.array(F.when((kills >= 10) & (hs_pct >= 80), "high_hs_pct"), F.when((scored >= c.review_threshold) & ~small, "review"))
    return F.array_compact(F.concat(F.array(F.when(small, "small_sample"), F.when(weak, "weak_signal_only")), each, tail))


def totals(m: Matches) -> DataFrame:
    """kills, deaths, headshots and shots of each player of the roster."""
    kills = m.kills.filter("attacker <> victim").groupBy("match_id", F.col("attacker").alias("steamid")).agg(F.count(F.lit(1)).alias("kills"), F.count_if("headshot").alias("headshots"))
    deaths = m.kills.groupBy("match_id", F.col("victim").alias("steamid")).agg(F.count(F.lit(1)).alias("deaths"))
    shots = m.shots.groupBy("match_id", "steamid").agg(F.count(F.lit(1)).alias("shots"))
    out = team_of(m)
    for side in (kills, deaths, shots):
        out = out.join(side, ["match_id", "steamid"], "left")
    return out.fillna(0, ["kills", "deaths", "headshots", "shots"])


def analyze(m: Matches, p: Params | None = None, extra: tuple[Detector, ...] = (), only: list[int] | None = None) -> DataFrame:
    """Observations: a row for each player of each match."""
    p = p or Params()
    found = detect(m, p, extra)
    if only:
        found = found.filter(F.col("steamid").isin(*only))
    entry = F.struct("name", "value", "samples", "confident", "raw")
    items = F.transform("evidence", lambda e: F.struct(F.col("name").alias("signal"), e["kind"].alias("kind"), e["round"].alias("round"), e["tick"].alias("tick"), e["detail"].alias("detail"), e["target"].alias("target")))
    order = F.create_map(*[F.lit(x) for i, d in enumerate(g for d in (*DETECTORS, *extra) for g in d.gives) for x in (d, i)])
    grouped = found.withColumn("_at", F.coalesce(F.try_element_at(order, F.col("name")), F.lit(99))).groupBy("match_id", "steamid").agg(
        F.sort_array(F.collect_list(F.struct("_at", F.struct("name", "value", "samples", "confident").alias("e")))).alias("_sorted"),
        F.map_from_entries(F.collect_list(F.struct("name", F.struct("value", "samples", "confident", "raw")))).alias("signals"),
        F.flatten(F.collect_list(items)).alias("evidence"),
    )
    out = totals(m)
    if only:
        out = out.filter(F.col("steamid").isin(*only))
    out = out.join(grouped, ["match_id", "steamid"], "left").join(score(found, p), ["match_id", "steamid"], "left")
    out = out.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("hs_pct", F.when(F.col("kills") > 0, 100.0 * F.col("headshots") / F.col("kills")).otherwise(0.0))
    entries = F.coalesce(F.transform("_sorted", lambda x: x["e"]), F.array().cast("array<struct<name:string,value:double,samples:bigint,confident:boolean>>"))
    ordered = F.array_sort("evidence", lambda a, b: F.when(a["round"] < b["round"], -1).when(a["round"] > b["round"], 1).when(a["tick"] < b["tick"], -1).when(a["tick"] > b["tick"], 1).otherwise(0))
    return out.select("match_id", "steamid", "name", "team", "kills", "deaths", "headshots", "shots", "hs_pct", "score", "signals", flags(p, entries, F.col("kills"), F.col("hs_pct"), F.col("score")).alias("flags"), ordered.alias("evidence"))
