"""The detectors over matches that events make, and SQL of the same rules."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import geometry as g
from .params import Burst, Context, Cursor, Movement, Params, Reaction, Recoil, Snap, Tracking
from .plans import signals
from .plans.event_stream import as_field, as_match
from .queries import DAY, SQL, E, events, query, scored, shown

#: Thresholds that events reach; ticks are four a second.
P = Params(
    movement=Movement(teleport_deg=90, snap_back_deg=25, return_window_ticks=3, return_tolerance_deg=20, min_ticks=20),
    cursor=Cursor(min_samples=40, min_presses=5, human_jerk=4.0, smooth_jerk=1.0, jump_speed=400, stop_speed=200, human_key_spread=1.5, robot_key_spread=0.2),
    tracking=Tracking(lock_deg=60), recoil=Recoil(max_gap_ticks=4, min_shots=2, perfect_error_deg=100, flat_spread_deg=40, min_bursts=2),
    reaction=Reaction(fov_deg=120, max_range=4000, impossible_ms=500, fast_ms=1500, low_stdev_ms=900, min_samples=1, steady_deg_per_tick=150), tickrate=4.0,
)
SPARSE = Params(burst=Burst(window_ms=2.0 * DAY * 1000, fast_gap_ms=3.0 * DAY * 1000), context=Context(min_kills=4), tickrate=1.0)

FIELD = f"""{E}, f AS (SELECT user_id AS sid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) AS INTEGER) AS t, event_type AS kind, value * 10 AS x, k * 100.0::DOUBLE AS y, (k % 9) * 10.0::DOUBLE - 40 AS pitch,
  value * 3.6::DOUBLE - 360 * floor(value * 3.6::DOUBLE / 360) - 180 AS yaw, event_type <> 'error' AS alive, k FROM e),
players AS (SELECT DISTINCT sid FROM f),
kills AS (SELECT sid, t AS kt, sid + 1 - 2 * (sid % 2) AS victim FROM f WHERE kind = 'purchase')"""


def _ramp(x: str, low: float, high: float) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({x}) - {low}::DOUBLE) / ({high}::DOUBLE - {low}::DOUBLE)))"


def _ratio(a: str, b: str) -> str:
    return f"coalesce(CASE WHEN {b} <> 0 THEN {a}::DOUBLE / {b} END, 0)"


def _between(pa: str, ya: str, pb: str, yb: str) -> str:
    r = lambda x: f"radians({x})"
    dot = f"cos({r(pa)}) * cos({r(ya)}) * cos({r(pb)}) * cos({r(yb)}) + cos({r(pa)}) * sin({r(ya)}) * cos({r(pb)}) * sin({r(yb)}) + sin({r(pa)}) * sin({r(pb)})"
    return f"CASE WHEN {dot} IS NOT NULL THEN round_even(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {dot})))) * 1e9::DOUBLE, 0) / 1e9::DOUBLE END"


#: Degrees between the aim of a and where b stands; all stand at one height.
AIM = _between("a.pitch", "a.yaw", "CASE WHEN b.x = a.x AND b.y = a.y THEN 0.0 ELSE -0.0 END", "degrees(atan2(b.y - a.y, b.x - a.x))")


def _shown(found: DataFrame, name: str) -> DataFrame:
    return found.filter(F.col("name") == name).select("steamid", g.shown("value").alias("value"), "samples", "confident", F.size("evidence").cast("long").alias("evidence"))


def _sql(ctes: str, value: str, samples: str, confident: str, evidence: str, source: str) -> str:
    return f"WITH RECURSIVE {ctes} SELECT sid AS steamid, {shown(value)} AS value, CAST({samples} AS BIGINT) AS samples, coalesce({confident}, false) AS confident, CAST({evidence} AS BIGINT) AS evidence FROM {source}"


_move = f"""{FIELD}, a AS (SELECT *, lag(pitch) OVER w AS p0, lag(yaw) OVER w AS y0, lag(t) OVER w AS t0, {', '.join(f'lead(pitch, {k}) OVER w AS p{k}, lead(yaw, {k}) OVER w AS y{k}' for k in (1, 2, 3))} FROM f WHERE alive WINDOW w AS (PARTITION BY sid ORDER BY t)),
j AS (SELECT *, t - t0 = 1 AS pair, CASE WHEN t - t0 = 1 THEN {_between('p0', 'y0', 'pitch', 'yaw')} END AS jump, least({', '.join(_between('p0', 'y0', f'p{k}', f'y{k}') for k in (1, 2, 3))}) AS nearest FROM a),
c AS (SELECT sid, count(*) AS alive_n, count_if(pair) AS n, count_if(jump >= 90) AS teleports, count_if(jump >= 25) AS jumps, count_if(jump >= 25 AND nearest <= 20) AS returns FROM j GROUP BY sid),
s AS (SELECT sid, coalesce(alive_n, 0) AS alive_n, coalesce(n, 0) AS n, coalesce(teleports, 0) AS teleports, coalesce(jumps, 0) AS jumps, coalesce(returns, 0) AS returns, coalesce(alive_n >= 32 AND n >= 20, false) AS enough FROM players LEFT JOIN c USING (sid))"""


@query(_sql(_move, f"CASE WHEN enough THEN greatest(0.5 * {_ramp(_ratio('teleports', 'n'), 0.0005, 0.006)}, CASE WHEN jumps >= 8 THEN {_ramp(_ratio('returns', 'jumps'), 0.05, 0.30)} ELSE 0 END) ELSE 0 END", "CASE WHEN alive_n < 32 THEN alive_n ELSE n END", "enough AND jumps >= 8", "CASE WHEN enough THEN least(8, returns) ELSE 0 END", "s"))
def det_movement(spark, d):
    return _shown(signals.movement(as_field(events(spark, d)), P), "movement")


_sparse = f"""{E}, b AS (SELECT DISTINCT day FROM e), r AS (SELECT day, row_number() OVER (ORDER BY day) AS round_num FROM b), players AS (SELECT DISTINCT user_id AS sid FROM e),
kills AS (SELECT user_id AS sid, tick, event_id, k, round_num FROM e JOIN r USING (day) WHERE event_type = 'purchase')"""
_context = f"""{_sparse}, c AS (SELECT sid, count(*) AS n, count_if((k & 2) <> 0) AS smoke, count_if((k & 1) <> 0) AS wall, count_if((k & 4) <> 0) AS noscope, count_if((k & 7) <> 0) AS flagged FROM kills GROUP BY sid),
s0 AS (SELECT sid, coalesce(n, 0) AS n, coalesce(flagged, 0) AS flagged, list_reverse_sort([{_ramp(_ratio('smoke', 'n'), 0.06, 0.24)}, {_ramp(_ratio('wall', 'n'), 0.09, 0.36)}, {_ramp(_ratio('noscope', 'n'), 0.10, 0.40)}]) AS p FROM players LEFT JOIN c USING (sid)),
context AS (SELECT sid, n AS samples, CASE WHEN n >= 4 THEN least(1.0, p[1] * 0.7 + p[2] * 0.3) ELSE 0 END AS value, n >= 8 AS confident, CASE WHEN n >= 4 THEN least(6, flagged) ELSE 0 END AS evidence FROM s0)"""


@query(_sql(_context, "value", "samples", "confident", "evidence", "context"))
def det_context(spark, d):
    return _shown(signals.context(as_match(events(spark, d)), SPARSE), "context")


_burst = f"""k1 AS (SELECT *, row_number() OVER (PARTITION BY sid, round_num ORDER BY tick, event_id) AS rn, tick - lag(tick) OVER (PARTITION BY sid, round_num ORDER BY tick, event_id) AS gap, lead(tick) OVER (PARTITION BY sid, round_num ORDER BY tick, event_id) AS nxt FROM kills),
k2 AS (SELECT *, rn - min(rn) OVER x + 1 AS size, min(tick) OVER x AS start FROM k1 WINDOW x AS (PARTITION BY sid, round_num ORDER BY tick RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW)),
k3 AS (SELECT sid, count(*) AS bursts FROM k2 WHERE size >= 3 AND (nxt IS NULL OR nxt - start > {2 * DAY}) GROUP BY sid),
k4 AS (SELECT sid, count(*) AS n, count(DISTINCT round_num) AS rounds, count(gap) AS gaps, median(gap * 1000.0::DOUBLE) AS med, stddev_samp(gap * 1000.0::DOUBLE) AS sd FROM k1 GROUP BY sid),
s1 AS (SELECT sid, coalesce(n, 0) AS n, coalesce(rounds, 0) AS rounds, coalesce(gaps, 0) AS gaps, med, sd, coalesce(bursts, 0) AS bursts FROM players LEFT JOIN k4 USING (sid) LEFT JOIN k3 USING (sid)),
burst AS (SELECT sid, n AS samples, CASE WHEN n >= 6 THEN greatest({_ramp(_ratio('bursts', 'greatest(rounds, 1)'), 0.08, 0.45)}, 0.7 * CASE WHEN gaps >= 8 AND med <= {3 * DAY * 1000} THEN {_ramp('CASE WHEN med <> 0 THEN coalesce(sd, 0) / med ELSE 1.0 END', 0.55, 0.15)} ELSE 0 END) ELSE 0 END AS value,
  n >= 12 AND rounds >= 5 AS confident, CASE WHEN n >= 6 THEN least(6, bursts) ELSE 0 END AS evidence FROM s1)"""


@query(_sql(f"{_sparse}, {_burst}", "value", "samples", "confident", "evidence", "burst"))
def det_burst(spark, d):
    return _shown(signals.burst(as_match(events(spark, d)), SPARSE), "burst")


_cursor = f"""{FIELD}, h AS (SELECT *, row_number() OVER w AS n, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step,
  sqrt(pow(x - 3 * lag(x, 1) OVER w + 3 * lag(x, 2) OVER w - lag(x, 3) OVER w, 2) + pow(y - 3 * lag(y, 1) OVER w + 3 * lag(y, 2) OVER w - lag(y, 3) OVER w, 2)) AS third, t - lag(t) OVER w AS dt FROM f WINDOW w AS (PARTITION BY sid ORDER BY t)),
h1 AS (SELECT *, CASE WHEN n > 3 AND step >= 0.5 THEN third / greatest(step, 1e-6::DOUBLE) END AS jerk, step / greatest(1, dt) AS speed FROM h),
h2 AS (SELECT *, lead(speed) OVER (PARTITION BY sid ORDER BY t) AS nxt FROM h1),
s AS (SELECT sid, count(*) AS rows, count(jerk) AS n, median(jerk) AS jerk, count(speed) AS speeds, count_if(speed >= 400) AS jumps, count_if(speed >= 400 AND nxt < 200) AS stops FROM h2 GROUP BY sid)"""
_tremor = f"CASE WHEN rows >= 40 AND n >= 10 THEN {_ramp('jerk', 4.0, 1.0)} ELSE 0 END"


@query(_sql(_cursor, _tremor, "CASE WHEN rows >= 40 THEN n ELSE rows END", "rows >= 40 AND n >= 20", f"CASE WHEN {_tremor} >= 0.5 THEN 1 ELSE 0 END", "s"))
def det_tremor(spark, d):
    return _shown(signals.cursor(as_field(events(spark, d)), P), "tremor")


@query(_sql(_cursor, f"CASE WHEN rows >= 40 THEN greatest(0.4 * {_ramp(_ratio('jumps', 'speeds'), 0.001, 0.02)}, CASE WHEN jumps >= 5 THEN {_ramp(_ratio('stops', 'jumps'), 0.15, 0.6)} ELSE 0 END) ELSE 0 END", "CASE WHEN rows >= 40 THEN speeds ELSE rows END", "rows >= 40 AND speeds >= 40 AND jumps >= 5", "CASE WHEN rows >= 40 THEN least(6, stops) ELSE 0 END", "s"))
def det_cursor_jump(spark, d):
    return _shown(signals.cursor(as_field(events(spark, d)), P), "cursor_jump")


_keys = f"""{FIELD}, q AS (SELECT sid, t, bit, (k & bit) <> 0 AS down FROM f, (VALUES (1), (2), (4), (8)) b(bit)),
q1 AS (SELECT *, coalesce(lag(down) OVER (PARTITION BY sid, bit ORDER BY t), false) AS was FROM q),
q2 AS (SELECT *, lead(t) OVER (PARTITION BY sid, bit ORDER BY t) - t AS held FROM q1 WHERE down <> was),
q3 AS (SELECT sid, count(held) AS presses, count_if(held > 0) AS n, stddev_samp(CASE WHEN held > 0 THEN held * 250.0::DOUBLE END) AS sd, avg(CASE WHEN held > 0 THEN held * 250.0::DOUBLE END) AS mean FROM q2 WHERE down GROUP BY sid),
s AS (SELECT sid, rows, coalesce(presses, 0) AS presses, coalesce(n, 0) AS n, CASE WHEN mean <> 0 THEN coalesce(sd, 0) / mean ELSE 1.0 END AS relative FROM (SELECT sid, count(*) AS rows FROM f GROUP BY sid) LEFT JOIN q3 USING (sid)),
v AS (SELECT *, rows >= 40 AND presses >= 5 AND n >= 5 AS enough, CASE WHEN rows >= 40 AND presses >= 5 AND n >= 5 THEN {_ramp('relative', 1.5, 0.2)} ELSE 0 END AS value FROM s)"""


@query(_sql(_keys, "value", "CASE WHEN rows < 40 THEN rows WHEN presses < 5 THEN presses ELSE n END", "enough AND n >= 10", "CASE WHEN value >= 0.5 THEN 1 ELSE 0 END", "v"))
def det_key_timing(spark, d):
    return _shown(signals.cursor(as_field(events(spark, d)), P), "key_timing")


_prefire = f"""{FIELD}, o AS (SELECT kills.*, off FROM kills, (VALUES (2), (4)) o(off)),
g AS (SELECT o.sid, kt, count(*) AS n, max({AIM}) AS error FROM o JOIN f a ON a.sid = o.sid AND a.t = kt - off JOIN f b ON b.sid = victim AND b.t = kt - off WHERE a.alive AND b.alive GROUP BY ALL HAVING count(*) = 2),
c AS (SELECT sid, count(*) AS n, count_if(error <= 60) AS hits FROM g GROUP BY sid), s AS (SELECT sid, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits FROM players LEFT JOIN c USING (sid))"""


@query(_sql(_prefire, _ramp(_ratio("hits", "n"), 0.15, 0.65), "n", "n >= 5", "least(6, hits)", "s"))
def det_prefire(spark, d):
    return _shown(signals.tracking(as_field(events(spark, d)), P), "prefire")


_recoil = f"""{FIELD}, s0 AS (SELECT sid, t, CASE WHEN t - lag(t) OVER (PARTITION BY sid ORDER BY t) <= 4 THEN 0 ELSE 1 END AS new FROM f WHERE kind = 'click'),
s1 AS (SELECT sid, t, sum(new) OVER (PARTITION BY sid ORDER BY t ROWS UNBOUNDED PRECEDING) AS burst FROM s0),
s2 AS (SELECT sid, burst, min(t) AS start, max(t) AS stop FROM s1 GROUP BY ALL HAVING count(*) >= 2),
s3 AS (SELECT s2.sid, burst, arg_min(victim, kt) AS victim FROM s2 JOIN kills ON kills.sid = s2.sid AND kt BETWEEN start AND stop + 64 GROUP BY ALL),
s4 AS (SELECT s1.sid, s1.burst, count(*) AS n, avg({AIM}) AS mean, coalesce(stddev_samp({AIM}), 0) AS sd FROM s3 JOIN s1 ON s1.sid = s3.sid AND s1.burst = s3.burst JOIN f a ON a.sid = s1.sid AND a.t = s1.t JOIN f b ON b.sid = victim AND b.t = s1.t WHERE b.alive GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT sid, count(*) AS n, count_if(mean <= 100 AND sd <= 40) AS perfect FROM s4 GROUP BY sid), s AS (SELECT sid, coalesce(n, 0) AS n, coalesce(perfect, 0) AS perfect FROM players LEFT JOIN c USING (sid))"""


@query(_sql(_recoil, _ramp(_ratio("perfect", "n"), 0.15, 0.65), "n", "n >= 2", "least(6, perfect)", "s"))
def det_recoil(spark, d):
    return _shown(signals.recoil(as_field(events(spark, d)), P), "recoil")


_reaction = f"""{FIELD}, v0 AS (SELECT kills.sid, kt, victim, a.t FROM kills JOIN f a ON a.sid = kills.sid AND a.t BETWEEN kt - 255 AND kt JOIN f b ON b.sid = victim AND b.t = a.t WHERE a.alive AND b.alive AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 4000 AND {AIM} <= 126.0::DOUBLE),
v1 AS (SELECT *, CASE WHEN coalesce(lead(t) OVER (PARTITION BY sid, kt ORDER BY t), kt + 1) - t > 5 THEN 1 ELSE 0 END AS far FROM v0),
v2 AS (SELECT *, sum(far) OVER (PARTITION BY sid, kt ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS island FROM v1),
v3 AS (SELECT sid, kt, victim, min(t) AS exposure FROM v2 WHERE island = 0 GROUP BY ALL),
v4 AS (SELECT v3.sid, kt, v3.victim, exposure, {AIM} AS before FROM v3 LEFT JOIN f a ON a.sid = v3.sid AND a.t = exposure - 6 LEFT JOIN f b ON b.sid = victim AND b.t = exposure - 6),
v5 AS (SELECT v4.sid, kt, exposure, before, a.t, {_between('lag(a.pitch) OVER w', 'lag(a.yaw) OVER w', 'a.pitch', 'a.yaw')} AS moved FROM v4 JOIN f a ON a.sid = v4.sid AND a.t BETWEEN exposure - 5 AND exposure WINDOW w AS (PARTITION BY v4.sid, kt ORDER BY a.t)),
v6 AS (SELECT sid, kt, exposure FROM v5 WHERE before IS NULL OR before > 126 GROUP BY sid, kt, exposure HAVING count(*) >= 3 AND max(moved) <= 150),
v7 AS (SELECT v6.sid, (coalesce(min(f.t), kt) - exposure) * 250.0::DOUBLE AS ms FROM v6 LEFT JOIN f ON f.sid = v6.sid AND kind = 'click' AND f.t BETWEEN exposure AND kt GROUP BY v6.sid, kt, exposure),
c AS (SELECT sid, count(*) AS n, median(ms) AS med, coalesce(stddev_samp(ms), 0) AS sd, count_if(ms <= 1500) AS fast, count_if(ms <= 500) AS impossible FROM v7 WHERE ms BETWEEN 0 AND 2000 GROUP BY sid),
s AS (SELECT * FROM players LEFT JOIN c USING (sid))"""


@query(_sql(_reaction, f"CASE WHEN n >= 1 THEN greatest({_ramp(_ratio('impossible', 'n'), 0.05, 0.40)}, 0.85 * {_ramp(_ratio('fast', 'n'), 0.25, 0.80)}, 0.75 * {_ramp('sd', 1800, 360)} * CASE WHEN med > 2250 THEN 0.3 ELSE 1 END) ELSE 0 END", "coalesce(n, 0)", "n >= 1", "least(8, coalesce(impossible, 0))", "s"))
def det_reaction(spark, d):
    return _shown(signals.reaction(as_field(events(spark, d)), P), "reaction")


#: The whole way to scores: the two signals that a match of kills supports, weighted, flagged, first to review first.
MATCH_SCORES = f"""WITH RECURSIVE {_context.replace('n >= 4', 'n >= 8').replace('n >= 8 AS confident', 'n >= 16 AS confident')}, {_burst},
t AS (SELECT sid, count(*) AS kills, count_if(k % 2 = 1) AS headshots FROM kills GROUP BY sid), u AS (SELECT user_id AS sid, count(*) AS shots FROM e WHERE event_type = 'click' GROUP BY 1),
w AS (SELECT c.sid, c.value AS cv, c.confident AS cc, b.value AS bv, b.confident AS bc, c.evidence + b.evidence AS evidence, CASE WHEN c.confident THEN 0.14::DOUBLE ELSE 0.14::DOUBLE * 0.35 END AS cw, CASE WHEN b.confident THEN 0.12::DOUBLE ELSE 0.12::DOUBLE * 0.35 END AS bw FROM context c JOIN burst b USING (sid)),
x AS (SELECT *, (cw * cv + bw * bv) / (cw + bw) AS base, (cc AND cv >= 0.55)::INT + (bc AND bv >= 0.55)::INT AS strong FROM w),
y AS (SELECT *, {scored('100 * CASE WHEN strong >= 2 THEN least(1.0, base * 1.08) ELSE base END')} AS score FROM x),
z AS (SELECT y.*, coalesce(kills, 0) AS kills, coalesce(headshots, 0) AS headshots, coalesce(shots, 0) AS shots FROM y LEFT JOIN t USING (sid) LEFT JOIN u USING (sid))
SELECT sid AS steamid, 'user ' || sid AS name, kills, CAST(0 AS BIGINT) AS deaths, headshots, shots, score, array_to_string(list_filter([CASE WHEN kills < 6 THEN 'small_sample' END,
  CASE WHEN cc AND cv >= 0.6 THEN 'strong:context' WHEN cc AND cv >= 0.35 THEN 'moderate:context' END, CASE WHEN bc AND bv >= 0.6 THEN 'strong:burst' WHEN bc AND bv >= 0.35 THEN 'moderate:burst' END,
  CASE WHEN kills >= 10 AND 100.0 * headshots / kills >= 80 THEN 'high_hs_pct' END, CASE WHEN score >= 55 AND kills >= 6 THEN 'review' END], lambda v: v IS NOT NULL), ',') AS flags, CAST(evidence AS INTEGER) AS evidence FROM z"""
SQL["match_scores"] = MATCH_SCORES


#: Thresholds under which random aims snap and rest now and then.
AIMED = Params(snap=Snap(lookback_ticks=4, lookahead_ticks=6, off_target_deg=70, on_target_deg=55, max_transition_ticks=3, extreme_angvel=150, low_jitter_deg=22, min_jitter_samples=4, jitter_window_deg=90, post_lock_max_stdev=32, post_lock_min_ticks=4), tickrate=4.0)

_aimed = f"""{FIELD},
near AS (SELECT kills.sid, kt, s.t, row_number() OVER (PARTITION BY kills.sid, kt ORDER BY s.t DESC) AS n, max(s.t) OVER (PARTITION BY kills.sid, kt) AS last
  FROM kills JOIN f s ON s.sid = kills.sid AND s.kind = 'click' AND s.t BETWEEN kt - 10 AND kt),
anchors AS (SELECT sid, kt, min(t) AS anchor FROM near WHERE t + n = last + 1 GROUP BY 1, 2),
frames AS (
  SELECT k.sid, k.kt, a.t, {_between('a.pitch', 'a.yaw', 'lag(a.pitch) OVER w', 'lag(a.yaw) OVER w')} AS moved, row_number() OVER w AS i,
    CASE WHEN b.alive THEN {AIM} END AS error
  FROM kills k LEFT JOIN anchors n ON n.sid = k.sid AND n.kt = k.kt JOIN f a ON a.sid = k.sid AND a.t BETWEEN coalesce(n.anchor, k.kt) - 4 AND coalesce(n.anchor, k.kt) + 6
    LEFT JOIN f b ON b.sid = k.victim AND b.t = a.t
  WINDOW w AS (PARTITION BY k.sid, k.kt ORDER BY a.t)),
marked AS (
  SELECT *, max(i) FILTER (error >= 70) OVER before AS off, max(i) FILTER (error <= 55) OVER before AS again, coalesce(bool_or(error > 55 * 2.5) OVER (PARTITION BY sid, kt ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), false) AS leaves,
    count(error) OVER tail AS left_n, stddev_samp(error) OVER tail AS left_sd
  FROM frames WINDOW before AS (PARTITION BY sid, kt ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), tail AS (PARTITION BY sid, kt ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fights AS (
  SELECT sid, kt, coalesce(max(moved), 0) AS peak, count(error) FILTER (error <= 90) AS locked, coalesce(stddev_samp(error) FILTER (error <= 90), 0) AS sd,
    min(t) FILTER (error <= 55 AND off IS NOT NULL AND (again IS NULL OR again < off) AND i - off <= 3 AND NOT leaves AND left_n >= 4 AND coalesce(left_sd, 0) <= 32) AS hit
  FROM marked GROUP BY 1, 2 HAVING count(*) >= 4 AND count(error) >= 4),
c AS (
  SELECT sid, count(*) AS n, count(hit) AS snaps, count_if(peak >= 150) AS extreme, count_if(locked >= 4) AS locked, count_if(locked >= 4 AND sd <= 22) AS flat,
    string_agg(hit, ',' ORDER BY kt) FILTER (hit IS NOT NULL) AS hits, string_agg(kt, ',' ORDER BY kt) FILTER (locked >= 4 AND sd <= 22) AS stills
  FROM fights GROUP BY sid),
s AS (SELECT sid, coalesce(n, 0) AS n, coalesce(snaps, 0) AS snaps, coalesce(extreme, 0) AS extreme, coalesce(locked, 0) AS locked, coalesce(flat, 0) AS flat, coalesce(hits, '') AS hits, coalesce(stills, '') AS stills FROM players LEFT JOIN c USING (sid))"""


def _first(column: str, n: int) -> str:
    return f"array_to_string(string_split({column}, ',')[1:{n}], ',')"


def _with_ticks(found: DataFrame, name: str) -> DataFrame:
    """As _shown(), with the ticks of the evidence in their order."""
    ticks = F.array_join(F.transform("evidence", lambda e: e["tick"].cast("string")), ",")
    return found.filter(F.col("name") == name).select("steamid", g.shown("value").alias("value"), "samples", "confident", ticks.alias("ticks"))


@query(f"WITH RECURSIVE {_aimed} SELECT sid AS steamid, {shown(f"greatest({_ramp(_ratio('snaps', 'n'), 0.05, 0.45)}, 0.7 * {_ramp(_ratio('extreme', 'n'), 0.10, 0.60)})")} AS value, CAST(n AS BIGINT) AS samples, n >= 5 AS confident, {_first('hits', 8)} AS ticks FROM s")
def det_snap(spark, d):
    return _with_ticks(signals.snap(as_field(events(spark, d)), AIMED), "snap")


@query(f"WITH RECURSIVE {_aimed} SELECT sid AS steamid, {shown(_ramp(_ratio('flat', 'locked'), 0.15, 0.70))} AS value, locked AS samples, locked >= 4 AS confident, {_first('stills', 6)} AS ticks FROM s")
def det_jitter(spark, d):
    return _with_ticks(signals.snap(as_field(events(spark, d)), AIMED), "jitter")


#: Thresholds under which aims follow an enemy for some ticks, with and without an action near.
FOLLOWING = Params(tracking=Tracking(lock_deg=50, min_distance=900, min_lock_ticks=2, ignore_window_ticks=1, min_target_travel_deg=40), tickrate=4.0)

_followed = f"""{FIELD},
seen AS (
  SELECT a.sid, b.sid AS enemy, a.t, degrees(atan2(b.y - a.y, b.x - a.x)) AS yaw, a.t - row_number() OVER (PARTITION BY a.sid, b.sid ORDER BY a.t) AS island
  FROM f a JOIN f b ON b.t = a.t AND b.sid % 2 <> a.sid % 2 AND a.alive AND b.alive AND sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) >= 900 AND {AIM} <= 50),
rows AS (SELECT *, row_number() OVER b AS i, max(t) OVER (PARTITION BY sid, enemy, island) - min(t) OVER (PARTITION BY sid, enemy, island) + 1 AS long FROM seen WINDOW b AS (PARTITION BY sid, enemy, island ORDER BY t)),
acts AS (SELECT DISTINCT sid, t FROM (SELECT sid, t FROM f WHERE kind IN ('click', 'purchase') UNION ALL SELECT victim, kt FROM kills)),
fold AS (
  SELECT sid, enemy, island, i, t, yaw, true AS is_on, t AS start, 0.0::DOUBLE AS travel, false AS counted, 0 AS new, 0 AS locked FROM rows WHERE i = 1 AND long >= 2
  UNION ALL
  SELECT sid, enemy, island, i, t, yaw, NOT (ripe AND near), CASE WHEN is_on THEN start ELSE t END, CASE WHEN is_on THEN way ELSE 0 END, is_on AND (counted OR (ripe AND NOT near)), CAST(ripe AND NOT near AS INTEGER),
    CASE WHEN is_on AND counted THEN 1 WHEN ripe AND NOT near THEN t - start + 1 ELSE 0 END
  FROM (
    SELECT r.sid, r.enemy, r.island, r.i, r.t, r.yaw, p.is_on, p.start, p.counted, p.travel + {_between('0', 'p.yaw', '0', 'r.yaw')} AS way,
      p.is_on AND NOT p.counted AND r.t - p.start + 1 >= 2 AND p.travel + {_between('0', 'p.yaw', '0', 'r.yaw')} >= 40 AS ripe,
      EXISTS (SELECT 1 FROM acts x WHERE x.sid = r.sid AND abs(x.t - p.start) <= 1) AS near
    FROM fold p JOIN rows r ON r.sid = p.sid AND r.enemy = p.enemy AND r.island = p.island AND r.i = p.i + 1)),
told AS (SELECT sid, start, row_number() OVER (PARTITION BY sid ORDER BY t, 'user ' || enemy) AS n FROM fold WHERE new = 1),
c AS (SELECT sid, sum(new) AS episodes, sum(locked) AS locked FROM fold GROUP BY 1),
s AS (
  SELECT p.sid, coalesce(episodes, 0) AS episodes, coalesce(locked, 0) AS locked, (SELECT count(*) FROM f WHERE f.sid = p.sid AND alive) AS living, (SELECT count(DISTINCT t // 20) FROM f) AS rounds,
    coalesce((SELECT string_agg(start, ',' ORDER BY n) FROM told WHERE told.sid = p.sid AND n <= 8), '') AS ticks
  FROM players p LEFT JOIN c ON c.sid = p.sid)"""


@query(f"WITH RECURSIVE {_followed} SELECT sid AS steamid, {shown(f"greatest({_ramp(_ratio('episodes', 'rounds'), 0.10, 0.90)}, 0.8 * {_ramp(_ratio('locked', 'living'), 0.003, 0.04)})")} AS value, CAST(living AS BIGINT) AS samples, living >= 2000 AS confident, ticks FROM s")
def det_tracking(spark, d):
    found = signals.tracking(as_field(events(spark, d)), FOLLOWING)
    return _with_ticks(found, "tracking")
