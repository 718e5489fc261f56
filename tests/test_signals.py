import pytest
from pyspark.sql import functions as F

from tellstone.functions import geometry as g
from tellstone.params import Params, Tracking
from tellstone.plans import score, signals, simulation
from tellstone.schema import Matches


@pytest.fixture(scope="module")
def observed(spark):
    rows = simulation.match(7, 10)
    for k, v in simulation.match(23, 6, {}).items():
        rows[k] = rows[k] + v
    m = simulation.to_matches(spark, rows)
    m = Matches(*(getattr(m, n).cache() for n in ("ticks", "kills", "shots", "rounds", "players", "matches")))
    found = score.analyze(m).collect()
    return {(r.match_id, r.name): r for r in found}


def test_cheats_rank_above_honest_players(observed):
    for match in ("synthetic-7",):
        mine = {n: r.score for (k, n), r in observed.items() if k == match}
        honest = [v for n, v in mine.items() if n.startswith("honest")]
        assert len(mine) == 10 and len(honest) == 8
        assert min(v for n, v in mine.items() if not n.startswith("honest")) > max(honest)
    assert max(r.score for (k, _), r in observed.items() if k == "synthetic-23") < 55
    assert not any("review" in r.flags for (k, _), r in observed.items() if k == "synthetic-23")


def test_signals_tell_what_they_saw(observed):
    aim = observed["synthetic-7", "aimbot_3"]
    assert aim.signals["snap"].value > 0.6 and aim.signals["snap"].raw["snaps"] >= 3
    assert observed["synthetic-7", "wallhack_7"].signals["prefire"].value > 0.5
    assert set(aim.signals) == {"snap", "jitter", "reaction", "tracking", "prefire", "recoil", "movement", "burst"}
    ordered = [(e["round"], e["tick"]) for e in aim.evidence]
    assert ordered == sorted(ordered) and {e.signal for e in aim.evidence} >= {"snap", "jitter"}
    assert all(e.target for e in aim.evidence if e.signal == "snap")


def test_capabilities_gate(spark):
    rows = spark.createDataFrame([("a", ["kills"])], "match_id string, capabilities array<string>")
    got = {r.signal: r.missing for r in score.skipped(rows).collect()}
    assert got["context"] == ["kill_flags"] and got["snap"] == ["angles", "positions"] and "burst" not in got
    assert len(got) == 11


def test_cursor_profiles(spark):
    kinds = ("human", "relax", "aim_assist", "replay_bot")
    m = simulation.cursor_match(spark, {k: simulation.frames(k) for k in kinds} | {"still": [(16 * i, 5.0, 5.0, 0) for i in range(600)], "short": simulation.frames(n=50)})
    got = {r.match_id: r for r in score.analyze(m).collect()}
    assert min(got[k].score for k in kinds[1:]) > got["human"].score + 20
    assert got["still"].signals["tremor"].samples == 0 and got["short"].score == 0
    assert got["relax"].signals["key_timing"].confident


def test_score_rules(spark):
    schema = "match_id string, steamid long, name string, value double, confident boolean"
    rows = [("a", 1, "burst", 1.0, True), ("b", 1, "snap", 0.8, False), ("c", 1, "snap", 0.6, True), ("c", 1, "recoil", 0.6, True), ("d", 1, "snap", 0.5, True), ("d", 1, "plugin", 1.0, True), ("e", 1, "plugin", 1.0, True)]
    got = {r.match_id: r.score for r in score.score(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": 60.0, "b": 80.0, "c": 64.8, "d": 50.0, "e": 0.0}


def _kills(spark, ticks, round_num=1):
    m = Matches.empty(spark)
    rows = [("m", i, t, 1, 2, "", False, round_num, False, False, 0) for i, t in enumerate(ticks)]
    m.kills, m.players = spark.createDataFrame(rows, m.kills.schema), spark.createDataFrame([("m", 1, "", 2)], m.players.schema)
    return m


@pytest.mark.parametrize("seed", range(4))
def test_burst_against_two_pointers(spark, seed):
    import random

    rng = random.Random(seed)
    ticks = sorted(rng.choice([rng.randrange(900), rng.randrange(100)]) for _ in range(40))
    window, start, found, biggest = int(76.8), 0, 0, 0
    for i, t in enumerate(ticks):
        while t - ticks[start] > 76.8:
            start += 1
        if i - start + 1 >= 3:
            biggest = max(biggest, i - start + 1)
            found += i == len(ticks) - 1 or ticks[i + 1] - ticks[start] > 76.8
    got = signals.burst(_kills(spark, ticks), Params()).first()
    assert (got.raw["bursts"], got.raw["biggest"]) == (found, biggest) and window == 76


def test_empty_matches(spark):
    assert score.analyze(Matches.empty(spark)).count() == 0
    m = _kills(spark, [])
    m.matches = spark.createDataFrame([("m", "s", "", "", 64.0, ["angles", "cursor", "keys", "kill_flags", "kills", "positions", "shots", "teams"])], m.matches.schema)
    r = score.analyze(m).collect()
    assert len(r) == 1 and r[0].score == 0 and r[0].name == "1" and "small_sample" in r[0].flags


def test_params_overlay(tmp_path):
    from tellstone import params

    (tmp_path / "p.json").write_text('{"snap": {"off_target_deg": 9, "none": 1}, "scoring": {"weights": {"snap": 1}}, "x": 2}')
    p = params.load(str(tmp_path / "p.json"))
    assert p.snap.off_target_deg == 9 and p.scoring.weights["snap"] == 1 and p.scoring.weights["burst"] == 0.12
    params.save(p, str(tmp_path / "q.json"))
    assert params.load(str(tmp_path / "q.json")) == p


def test_geometry(spark):
    from tellstone.functions import geometry as g

    one = spark.range(1)
    for a, b, want in ((350, 10, -20), (10, 350, 20), (180, 0, 180)):
        assert one.select(g.angle_diff(F.lit(float(a)), F.lit(float(b)))).first()[0] == want
    assert one.select(g.ramp(F.lit(5.0), 0, 10), g.ramp(F.lit(5.0), 10, 0), g.ramp(F.lit(1.0), 3, 3)).first() == (0.5, 0.5, 0.0)
    v = F.array(*[F.lit(float(x)) for x in (2, 4, 4, 4, 5, 5, 7, 9)])
    assert abs(one.select(g.array_stdev(v)).first()[0] - 2.138) < 1e-3


def test_angles_on_a_threshold(spark):
    """Aims ten degrees up and ten down are twenty apart at every yaw, so a jump back within 20 counts."""
    rows = spark.range(10_000).select(g.spherical(F.lit(10.0), F.col("id") * 0.036 - 180, F.lit(-10.0), F.col("id") * 0.036 - 180).alias("d"))
    assert [r.d for r in rows.distinct().collect()] == [20.0]


def test_angles_like_the_sql(spark):
    """Angles of the detectors' SQL and of the queries are the same numbers but near 0 and 180, where no threshold of snap is."""
    import duckdb

    from tellstone.detector_queries import _between

    rows = spark.range(20_000).select(*[(F.pmod(F.col("id") * k, F.lit(9)) * 10.0 - 40).alias(c) for c, k in (("p", 1), ("q", 5))], *[(F.pmod(F.col("id") * k, F.lit(10_000)) * 0.036 - 180).alias(c) for c, k in (("y", 7), ("z", 31))])
    got = rows.withColumn("d", g.spherical("p", "y", "q", "z")).toArrow()
    assert duckdb.sql(f"SELECT count(*) FROM got WHERE d BETWEEN 0.01 AND 179.99 AND d <> {_between('p', 'y', 'q', 'z')}").fetchall() == [(0,)]


def _plan(found):
    return found._jdf.queryExecution().optimizedPlan().toString().splitlines()


def _field(spark):
    from tellstone.plans.event_stream import as_field
    from tellstone.queries import events

    return as_field(events(spark, "/root/testdata/sf0.001"))


def test_enemies_meet_at_ticks(spark, monkeypatch):
    """Players are never paired over a whole match, only at a tick; parts of a match's players change nothing."""
    m, p = _field(spark), Params()
    assert all("tick" in x for x in _plan(signals.tracking(m, p)) if "Join" in x and "NOT (steamid" in x)
    p = Params(tracking=Tracking(lock_deg=80, min_distance=100, min_lock_ticks=2, ignore_window_ticks=0, min_target_travel_deg=10))
    told = lambda: sorted(repr(r) for r in signals.tracking(m, p).filter("name = 'tracking'").collect())
    whole = told()
    monkeypatch.setattr(signals, "SIDE", 2)
    assert told() == whole and "wall_track" in "".join(whole)


def test_prefire_pairs_nobody(spark):
    plan = _plan(signals.tracking(_field(spark), Params()).filter("name = 'prefire'"))
    assert not [x for x in plan if "Join" in x and "NOT (steamid" in x]


def test_reaction_spreads_no_kill_over_its_ticks(spark):
    assert not [x for x in _plan(signals.reaction(_field(spark), Params())) if "explode(sequence((kill_tick" in x]


def test_means_at_a_half(spark, tmp_path):
    """The mean of 0.01, 0.35, 0.1 and 0.2 is 0.165, whose hundredth is 0.0017, in whatever order they are added."""
    from tellstone import queries

    rows = spark.createDataFrame([(k, 1, "purchase", v, '{"k": 1}') for k, v in enumerate((0.01, 0.35, 0.1, 0.2))], "event_id long, user_id long, event_type string, value double, props string")
    rows.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [r.value for r in queries._event_signals(spark, str(tmp_path)).collect()] == [0.0017]


def test_snap_at_a_half(spark, tmp_path):
    """69 of 128 fights with an aim that turns by 180 degrees make 0.6146875, whose sixth place goes up, in the query and its SQL."""
    import duckdb

    from tellstone import queries

    rows = []
    for t in range(128 * 24):
        fight, at = divmod(t, 24)
        rows.append((2 * t, t, 0, "purchase" if at == 12 else "view", 0.0 if at == 12 and fight < 69 else 50.0, '{"k": 4}'))
        rows.append((2 * t + 1, t, 1, "view", 50.0, '{"k": 94}'))
    made = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    made.select("event_id", "user_id", "event_type", "value", "props", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["det_snap"]).fetchall())
    assert [r[1] for r in want] == [0.614688, 0.0]
    assert sorted(tuple(r) for r in queries.queries()["det_snap"](spark, str(tmp_path)).collect()) == want


def test_values_are_shown_like_the_sql(spark):
    """Every share of a whole up to 640, ramped as snap, extreme flicks, prefires and rounds are."""
    import duckdb

    from tellstone.queries import shown

    shares = spark.range(1, 641).select((F.col("id")).alias("n"), F.explode(F.sequence(F.lit(0), "id")).alias("s")).withColumn("s", F.col("s") / F.col("n"))
    ramps = F.array(g.ramp("s", 0.05, 0.45), 0.7 * g.ramp("s", 0.10, 0.60), g.ramp("s", 0.15, 0.65), g.ramp("s", 0.10, 0.90))
    got = shares.select(F.explode(ramps).alias("v")).distinct().select("v", g.shown("v").alias("shown")).toArrow()
    assert duckdb.sql(f"SELECT count(*), count_if(shown <> {shown('v')}), max(abs(shown - v)) <= 0.5000001e-6 FROM got").fetchall() == [(got.num_rows, 0, True)]


def test_match_score_at_a_half(spark, tmp_path):
    """Sixteen kills, three or four a day, with five wall bangs and five noscopes, score 95.75, shown as the even 95.8 in the query and its SQL."""
    import duckdb

    from tellstone import queries

    rows = [(n, n % 5 * 86400 + n, 1, "purchase", 1.0, '{"k": %d}' % (1 if n < 5 else 4 if n < 10 else 8)) for n in range(16)]
    made = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    made.select("event_id", "user_id", "event_type", "value", "props", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["match_scores"])
    got = queries.queries()["match_scores"](spark, str(tmp_path)).select(*want.columns).collect()
    assert [r.score for r in got] == [95.8] and [tuple(r) for r in got] == want.fetchall()
