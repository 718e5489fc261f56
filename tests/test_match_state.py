import random
import time

import pytest
from pyspark.sql import functions as F

from tellstone.params import Burst, Params
from tellstone.plans import score, signals
from tellstone.sources import server_log
from tellstone.streaming import live, match_state

BASE = 76561197960265728
P = Params(burst=Burst(window_ms=4000.0, fast_gap_ms=9000.0))


def stamp(s):
    return f"L 01/15/2024 - {20 + s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}: "


def kill(s, a, v, weapon="ak47", flags=""):
    return f'{stamp(s)}"P{a}<{a}><[U:1:{a}]><CT>" killed "P{v}<{v}><[U:1:{v}]><TERRORIST>" with "{weapon}"{flags}'


def start(s):
    return stamp(s) + 'World triggered "Round_Start"'


def match_lines(seed, rounds=12):
    rng, out, s = random.Random(seed), [], 5
    for r in range(rounds):
        s += 1  # a kill of the second in which a round begins belongs to the round before if it comes before
        if r or seed % 2:
            out.append(start(s))
        s += rng.randrange(3, 20)
        for _ in range(rng.randrange(2, 7)):
            a = rng.choice([1, 1, 1, 2, 3])
            out.append(kill(s, a, rng.choice([4, 5, 6, a]), flags=rng.choice(["", " (headshot)"])))
            if rng.random() < 0.2:
                out += [f'# 2 1 "late {rng.randrange(9)}" [U:1:{rng.randrange(20, 24)}] 05:11 34 0 active', "noise", stamp(s) + "nothing"]
            s += rng.choice([0, 0, 1, 1, 2, 30])
    return out


def table(spark, matches):
    rows = [(m, i, x) for m, lines in matches.items() for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "match_id string, seq long, value string")


def streamed(spark, tmp_path, batches, p=P, **more):
    """Records and checkpoint of a stream over the batches, one after the other."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "c")
    for rows in batches:
        rows.coalesce(1).write.mode("append").json(folder)
        stream = spark.readStream.schema("match_id string, seq long, value string").json(folder)
        got = live.drain(match_state.live_matches(match_state.tagged(stream), p, **more), out, timers=True)
    return got.collect(), f"{out}/state"


def test_tags(spark):
    lines = [start(1), kill(2, 1, 2), '# 2 1 "Some one" STEAM_1:0:12345 05:11', "x", kill(3, 1, 2).replace("[U:1:1]", "BOT"), '# 2 1 "bot" BOT 05:11', start(1).replace("01/15", "99/99")]
    got = match_state.tagged(table(spark, {"m": lines})).orderBy("seq").collect()
    assert [r.tag for r in got] == ["round", "kill", "status", None, None, None, None]
    assert (got[1].attacker - BASE, got[1].victim_name, got[1].victim_team, got[1].weapon, got[1].headshot) == (1, "P2", 2, "ak47", False)
    assert (got[2].attacker - BASE, got[2].attacker_name, got[2].at) == (24690, "Some one", None)


def test_pace_like_the_batch(spark):
    matches = {f"m{k}": match_lines(k) for k in range(6)}
    m = server_log.parse(table(spark, matches))
    want = {(r.match_id, r.steamid): (r.value, [(e.round, e.tick) for e in r.evidence or []]) for r in signals.burst(m, P).collect()}
    kills = m.kills.filter("attacker <> victim").collect()
    for (match, who), (value, seen) in want.items():
        got = match_state.pace([(k.round_num, k.tick) for k in kills if k.match_id == match and k.attacker == who], P)
        assert got[0] == pytest.approx(value, abs=1e-12) and [g[:2] for g in got[1]] == seen


def test_rounds_have_ends_and_alerts_a_value(spark, tmp_path):
    """In three batches: each record once, as when all lines come one by one."""
    matches = {f"m{k}": match_lines(k) for k in range(4)}
    rows = table(spark, matches)
    got, checkpoint = streamed(spark, tmp_path, [rows.filter("seq < 9"), rows.filter("seq >= 9 and seq < 30"), rows.filter("seq >= 30")])
    again, _ = streamed(spark, tmp_path / "one", [rows])
    expect = []
    for match, lines in matches.items():
        base = number = begun = None
        number, roster, kills, told = 0, {}, {}, set()
        stamped = [x for x in lines if x.startswith("L ") and ("killed" in x or "Round" in x)]
        for i, x in enumerate(lines):
            if x.startswith("#"):
                who, name = int(x.split("[U:1:")[1].split("]")[0]), x.split('"')[1]
                if who not in roster:
                    roster[who] = name
                    expect.append((match, "joined", who, name, None, None, None, None))
            if not x.startswith("L ") or ("killed" not in x and "Round" not in x):
                continue
            s = int(x[15:17]) * 3600 + int(x[18:20]) * 60 + int(x[21:23])
            base = s if base is None else base
            tick = (s - base) * 64
            if "Round" in x:
                if begun is not None:
                    expect.append((match, "round", None, None, number, begun, tick - 1, None))
                number, begun = number + 1, tick
                continue
            a, v = (int(x.split("[U:1:")[k].split("]")[0]) for k in (1, 2))
            for who in (a, v):
                if who not in roster:
                    roster[who] = f"P{who}"
                    expect.append((match, "joined", who, f"P{who}", None, None, None, None))
            if a != v:
                kills.setdefault(a, []).append((number, tick))
            later = stamped[stamped.index(x) + 1 :] if stamped.count(x) == 1 else lines[i + 1 :]
            after = next((y for y in later if y.startswith("L ") and ("killed" in y or "Round" in y)), None)
            if after is None or after[15:23] != x[15:23]:
                for who in {int(y.split("[U:1:")[1].split("]")[0]) for y in lines[: i + 1] if "killed" in y and y[15:23] == x[15:23]}:
                    value, groups = match_state.pace(kills.get(who, []), P)
                    if value >= 0.6 and groups and (who, groups[-1][1]) not in told:
                        told.add((who, groups[-1][1]))
                        expect.append((match, "burst", who, f"P{who}", groups[-1][0], groups[-1][1], None, groups[-1][2]))
    plain = lambda rows: sorted(repr((r.match_id, r.kind, r.steamid and r.steamid - BASE, r.name, r.number, r.tick, r.end_tick, r["size"])) for r in rows)
    assert sum(e[1] == "burst" for e in expect) > 3
    assert plain(again) == sorted(map(repr, expect)) == plain(got)
    assert all(r.value >= 0.6 for r in got if r.kind == "burst")

    # The state, read as a table, gives the report of the same lines.
    m = match_state.snapshot(spark, checkpoint, P)
    whole = server_log.parse(rows)
    assert sorted(map(tuple, m.rounds.collect())) == sorted(map(tuple, whole.rounds.collect()))
    whole.matches = whole.matches.withColumn("capabilities", F.array(F.lit("kills"), F.lit("teams")))
    report = lambda m: sorted(repr(tuple(r)) for r in score.analyze(m, P).select("match_id", "steamid", "name", "team", "kills", "deaths", "headshots", "score", "flags", F.col("signals")["burst"]["value"]).collect())
    assert report(m) == report(whole) and len(report(m)) > 12
    assert {r.match_id: (r.kills, r.rounds) for r in match_state.summary(m).collect()} == {r.match_id: (r.kills, r.rounds) for r in match_state.summary(whole).collect()}


def test_names_come_later(spark, tmp_path):
    rows = table(spark, {"m": ['# 2 1 "" [U:1:7] 05:11', '# 2 1 "" [U:1:7] 05:12', '# 2 1 "A" [U:1:7] 05:13', '# 2 1 "B" [U:1:7] 05:14']})
    got, _ = streamed(spark, tmp_path, [rows.filter("seq < 1"), rows.filter("seq >= 1")])
    assert [(r.kind, r.name) for r in sorted(got, key=lambda r: r.seq)] == [("joined", ""), ("named", "A")]


def test_idle_matches_end(spark, tmp_path):
    first, then = table(spark, {"m": [start(1), start(9)]}), table(spark, {"other": ["noise"]})
    folder, out = str(tmp_path / "in"), str(tmp_path / "c")
    got = []
    for rows in (first, then):
        rows.coalesce(1).write.mode("append").json(folder)
        stream = spark.readStream.schema("match_id string, seq long, value string").json(folder)
        got = live.drain(match_state.live_matches(match_state.tagged(stream), P, idle=0), out, timers=True).collect()
        time.sleep(0.1)
    assert [(r.number, r.tick, r.end_tick) for r in got] == [(1, 0, 511), (2, 512, 1_000_000_000)]


def test_risk_once_a_player(spark, tmp_path):
    rows = table(spark, {"m": [kill(1, 1, 2), kill(2, 1, 3), kill(3, 4, 1), kill(4, 5, 1)]})
    got, _ = streamed(spark, tmp_path, [rows.filter("seq < 2"), rows.filter("seq >= 2")])
    risks = spark.createDataFrame([(BASE + 1, "own", 55.4, ["new", "private"], None), (BASE + 2, "", 39.9, ["new"], None), (BASE + 3, None, 40.0, ["x"], None), (BASE + 4, None, None, None, "no net")], "steamid long, name string, risk double, reasons array<string>, error string")
    found = match_state.risk_alerts(spark.createDataFrame(got, match_state.RECORDS), risks).collect()
    assert sorted((r.steamid - BASE, r.kind, r.name, r.detail) for r in found) == [(1, "risk", "own", "risk 55 - new, private"), (3, "risk", "P3", "risk 40 - x"), (4, "risk_error", "P4", "lookup failed: no net")]


def test_new_players_in_groups(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("m", i, i % 23, f"n{i % 23}") for i in range(40)] + [("k", 0, 5, "five")]
    spark.createDataFrame(rows, "match_id string, seq long, steamid long, name string").coalesce(1).write.json(folder)
    stream = spark.readStream.schema("match_id string, seq long, steamid long, name string").json(folder)
    query = match_state.new_players(stream, 10, 2.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    end = time.time() + 90
    while time.time() < end and (not query.recentProgress or spark.read.schema(match_state.GROUPS).parquet(out).count() < 4):
        time.sleep(0.5)
    query.stop()
    got = sorted(spark.read.parquet(out).collect(), key=lambda r: (r.match_id, r.number))
    assert [(r.match_id, r.number, r.steamids) for r in got] == [("k", 1, [5]), ("m", 1, list(range(10))), ("m", 2, list(range(10, 20))), ("m", 3, [20, 21, 22])]
    assert got[1].names == [f"n{i}" for i in range(10)]


def test_alert_lines(spark):
    rows = spark.createDataFrame([("risk", 7, "own", "risk 55 - new"), ("risk_error", 8, "", "lookup failed"), ("a_long_kind_of_alert", 9, None, "x")], "kind string, steamid long, name string, detail string")
    got = [r.value for r in match_state.alert_lines(rows, F.lit("2024-01-15 20:00:05").cast("timestamp")).collect()]
    assert got == ["[20:00:05] risk         own: risk 55 - new", "[20:00:05] risk_error   8: lookup failed", "[20:00:05] a_long_kind_of_alert 9: x"]


def test_halves_of_risks_are_even(spark):
    records = spark.createDataFrame([("m", k, "joined", k, "p", None, None, None, None, None) for k in range(3)], match_state.RECORDS)
    risks = spark.createDataFrame([(0, "", 40.5, ["x"], None), (1, "", 41.5, ["x"], None), (2, "", 40.51, ["x"], None)], "steamid long, name string, risk double, reasons array<string>, error string")
    assert sorted(r.detail for r in match_state.risk_alerts(records, risks).collect()) == ["risk 40 - x", "risk 41 - x", "risk 42 - x"]


def test_players_are_looked_up_once_a_batch():
    """However many kills a batch has, the state is asked and told once for each player."""
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    from pyspark.sql import Row

    machine = match_state.LiveMatch(P, 0.6, 60)
    state = {k: MagicMock() for k in ("clock", "rounds", "kills", "players", "roster", "reported")}
    for s in state.values():
        s.exists.return_value, s.getValue.return_value, s.containsKey.return_value = False, None, False
    machine.handle = MagicMock(listTimers=lambda: iter(()))
    machine.__dict__.update(state)
    line = dict.fromkeys(f.split(" ")[0] for f in match_state.LINES.split(", ")) | {"match_id": "m", "tag": "kill", "attacker": 1, "attacker_name": "a", "victim": 2, "victim_name": "b", "weapon": "w", "headshot": False}
    out = list(machine.handleInputRows(("m",), iter([Row(**(line | {"seq": k, "at": k * 60})) for k in range(50)]), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)))
    assert [(r.kind, r.steamid) for r in out if r.kind == "joined"] == [("joined", 1), ("joined", 2)]
    assert [state[k].getValue.call_count for k in ("players", "roster")] == [2, 2] == [state[k].updateValue.call_count for k in ("players", "roster")]


def test_rounds_without_kills(spark, tmp_path):
    """The state of rounds gives those of the whole state, in three batches, and gets few lines of a match."""
    rows = table(spark, {f"m{k}": ["noise", *match_lines(k, rounds=30)] for k in range(4)})
    batches = [rows.filter("seq < 9"), rows.filter("seq >= 9 and seq < 30"), rows.filter("seq >= 30")]
    whole, checkpoint = streamed(spark, tmp_path / "whole", batches)
    folder, out = str(tmp_path / "in"), str(tmp_path / "c")
    for part in batches:
        part.coalesce(1).write.mode("append").json(folder)
        stream = spark.readStream.schema("match_id string, seq long, value string").json(folder)
        got = live.drain(match_state.live_rounds(match_state.tagged(stream), P), out, timers=True)
    plain = lambda found: sorted(map(repr, found))
    assert plain(got.collect()) == plain(r for r in whole if r.kind == "round") and got.count() > 100
    assert plain(match_state.rounds_of(spark, f"{out}/state").collect()) == plain(match_state.snapshot(spark, checkpoint, P).rounds.collect())

    tags = match_state.tagged(rows).coalesce(1)
    n = {r.tag: r["count"] for r in tags.groupBy("tag").count().collect()}
    few = {r.tag: r["count"] for r in match_state.thinned(tags, ("round",)).groupBy("tag").count().collect()}
    assert n["kill"] > 400 and few["kill"] <= 16 and few[None] <= 16 and few["round"] == n["round"]
    assert {r.match_id: r.seq for r in match_state.thinned(tags, ("round",)).filter("tag = 'kill'").groupBy("match_id").agg(F.min("seq").alias("seq")).collect()} == {r.match_id: r.seq for r in tags.filter("tag = 'kill'").groupBy("match_id").agg(F.min("seq").alias("seq")).collect()}


def test_bursts_beyond_six(spark, tmp_path):
    """A player with a group of kills in each of nine rounds gives an alert for each from the second on, in the query and its SQL."""
    import duckdb

    from tellstone import queries

    day, rows = 86400, []
    for r in range(9):
        at = 10 * r * day
        rows += [(at, "signup", 7), (at + 60, "purchase", 1), (at + 120, "purchase", 2), (at + 180, "purchase", 3)]
    made = spark.createDataFrame([(n, t, 4, kind, 1.0, f'{{"k": {k}}}') for n, (t, kind, k) in enumerate(rows)], "event_id long, t long, user_id long, event_type string, value double, props string")
    made.select("event_id", "user_id", "event_type", "value", "props", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["live_bursts"])
    got = sorted(tuple(r) for r in queries.queries()["live_bursts"](spark, str(tmp_path)).select(*want.columns).collect())
    assert [r[want.columns.index("number")] for r in got] == list(range(2, 10)) and got == sorted(want.fetchall())
    assert len(match_state.pace([(r, 100 * r + k) for r in range(9) for k in range(3)], P)[1]) == 9
