import json

import pytest
from pyspark.sql import functions as F

from tellstone.plans import score, simulation
from tellstone.sources import converters, ingest, loader, replays, server_log

BASE = 76561197960265728


def _files(spark, *texts):
    return spark.createDataFrame([(f"m{k}", t) for k, t in enumerate(texts)], "match_id string, value string")


def test_json_lines(spark, tmp_path):
    rows = [
        {"type": "meta", "game": "own", "map": "arena", "tickrate": 30, "players": {str(BASE + 9): "late"}},
        {"type": "round", "start_tick": 0, "end_tick": 90},
        {"frame": 1, "player_id": BASE + 1, "name": "a", "side": "CT", "pos_x": 1, "pos_y": 2, "pos_z": 3, "view_pitch": -4.5, "view_yaw": 45},
        {"type": "tick", "tick": 2, "steamid": str(BASE + 2), "team": "RED", "x": 1, "alive": "sim", "hp": "55"},
        {"type": "tick", "tick": 3, "steamid": 0},
        {"kind": "weapon_fire", "tick": 2, "attacker": BASE + 1, "gun": "ak"},
        {"type": "death", "tick": 3, "killer": 76561198123456789, "killed": BASE + 2, "hs": 1, "through_smoke": True, "penetrated": 2},
    ]
    (tmp_path / "x.jsonl").write_text("# comment\n\n" + "\n".join(map(json.dumps, rows)))
    m = loader.load_any(spark, str(tmp_path / "x.jsonl"))
    a, b = m.ticks.orderBy("tick").collect()
    assert (a.tick, a.steamid, a.yaw, a.team, a.health, a.is_alive) == (1, BASE + 1, 45.0, 3, 100, True)
    assert (b.steamid, b.team, b.is_alive, b.health) == (BASE + 2, 2, True, 55)
    k = m.kills.first()
    assert (k.attacker, k.victim, k.headshot, k.through_smoke, k.penetrated) == (76561198123456789, BASE + 2, True, True, 2)
    assert m.shots.first().steamid == BASE + 1 and m.rounds.first().number == 1
    info = m.matches.first()
    assert info.capabilities == ["angles", "kill_flags", "kills", "positions", "shots", "teams"] and (info.map_name, info.game, info.tickrate) == ("arena", "own", 30.0)
    assert {r.steamid: r.name for r in m.players.collect()} == {BASE + 1: "a", BASE + 2: str(BASE + 2), BASE + 9: "late"}


def test_json_lines_errors(spark, tmp_path):
    for k, bad in enumerate(('{"type": "what"}', "{broken")):
        (tmp_path / f"{k}.jsonl").write_text(bad)
        with pytest.raises(Exception, match="unknown record type|not JSON"):
            loader.load_any(spark, str(tmp_path / f"{k}.jsonl")).matches.collect()
    with pytest.raises(ValueError, match="no adapter"):
        loader.load_any(spark, "x.dem")


def test_csv_and_object(spark, tmp_path):
    (tmp_path / "x.csv").write_text(f"tick,steamid,name,team,x,y,z,pitch,yaw\n1,{BASE + 1},a,CT,1,2,3,,\n2,{BASE + 3},b,T,1,2,3,,\n")
    m = loader.load_any(spark, str(tmp_path / "x.csv"))
    assert m.matches.first().capabilities == ["positions", "teams"] and {r.steamid for r in m.ticks.collect()} == {BASE + 1, BASE + 3}
    body = {"meta": {"game": "g"}, "ticks": [{"tick": 5, "id": BASE + 1, "yaw": 1}], "kills": [{"tick": 1, "attacker": 5, "victim": 6}], "rounds": [{"number": 4, "start": 1}]}
    (tmp_path / "x.json").write_text(json.dumps(body, indent=1))
    m = loader.load_any(spark, str(tmp_path / "x.json"))
    assert m.matches.first().capabilities == ["angles", "kills"] and m.rounds.first().end_tick == 10**9 and m.rounds.first().number == 4


def test_mapping(spark):
    data = {"frames": [{"n": i, "players": [{"pid": BASE + 1, "pos": {"x": i}, "rot": [1, 30.0]}]} for i in range(5)], "events": {"kills": [{"f": 3, "k": BASE + 1, "v": BASE + 2}]}}
    spec = {"meta": {"game": "own", "tickrate": 60}, "ticks": {"path": "frames[].players[]", "fields": {"tick": "$parent.n", "steamid": "pid", "x": "pos.x", "yaw": "rot.1", "team": "$const:CT"}}, "kills": {"path": "events.kills[]", "fields": {"tick": "f", "attacker": "k", "victim": "v"}}}
    m = ingest.mapped(_files(spark, json.dumps(data)), spec)
    assert sorted((r.tick, r.x, r.yaw, r.team) for r in m.ticks.collect()) == [(i, float(i), 30.0, 3) for i in range(5)]
    assert m.kills.count() == 1 and m.matches.first().tickrate == 60.0
    with pytest.raises(ValueError, match="no fields"):
        ingest.mapped(_files(spark, "{}"), {"ticks": {"path": "a[]"}})


LOG = """L 01/15/2024 - 20:00:00: World triggered "Round_Start"
L 01/15/2024 - 20:00:05: "A<1><STEAM_1:0:1><CT>" [0 0 0] killed "B<2><STEAM_1:1:2><TERRORIST>" [500 0 0] with "ak47" (headshot)
nonsense
L 01/15/2024 - 20:00:07: "A<1><STEAM_1:0:1><CT>" killed "C<x><3><[U:1:9]><TERRORIST>" with "knife" (throughsmoke) (penetrated) (noscope)
L 01/15/2024 - 20:01:00: World triggered "Round_Start"
L 01/15/2024 - 20:01:05: "B<2><STEAM_1:1:2><TERRORIST>" [1 2 3] killed "A<1><STEAM_1:0:1><CT>" [4 5 6] with "awp"
"""


def test_server_log(spark, tmp_path):
    (tmp_path / "m.log").write_text(LOG)
    m = loader.load_any(spark, str(tmp_path / "m.log"))
    kills = m.kills.orderBy("tick").collect()
    assert [(k.attacker - BASE, k.victim - BASE, k.weapon, k.round_num) for k in kills] == [(2, 5, "ak47", 1), (2, 9, "knife", 1), (5, 2, "awp", 2)]
    assert kills[1].tick - kills[0].tick == 128 and kills[0].headshot and kills[1].noscope and kills[1].through_smoke and kills[1].penetrated == 1
    assert [tuple(r)[1:] for r in m.rounds.orderBy("number").collect()] == [(1, 0, 3839), (2, 3840, 10**9)]
    assert m.matches.first().capabilities == ["kill_flags", "kills", "positions", "teams"]
    assert m.ticks.count() == 4 and {r.name: r.team for r in m.players.collect()} == {"A": 3, "B": 2, "C<x>": 2} or m.players.count() == 3
    report = score.analyze(m).collect()
    assert len(report) == 3 and all(set(r.signals) == {"burst", "context"} for r in report)


def test_replay_round_trip(spark, tmp_path):
    samples = simulation.frames(n=500)
    replays.write_replay(str(tmp_path / "a.osr"), samples, "Zoë")
    (tmp_path / "b.osr").write_bytes(b"\x00\x01")
    m = loader.load_any(spark, str(tmp_path / "*.osr"))
    got = m.ticks.orderBy("seq").collect()
    assert [(r.x, r.y, r["keys"]) for r in got] == [s[1:] for s in samples] and [r.tick for r in got] == [int(s[0] * 60 / 1000) for s in samples]
    assert m.players.first().name == "Zoë" and m.matches.first().capabilities == ["cursor", "keys", "positions"]
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("path").alias("match_id"), "content")
    head = {r.error is None: r for r in replays.played_at(replays.headers(files)).collect()}
    assert head[True].count_100 == 2 and head[True].max_combo == 50 and head[False].error


def test_frame_text(spark):
    texts = spark.createDataFrame([("a", "-1|0|0|0,-1|0|0|0,16|10|20|1,16|11|21|0,-12345|0|0|9999,"), ("b", "bad,16|1|2,16|1|2|3,"), ("c", "")], "match_id string, frames string")
    got = [(r.match_id, r.ms, r.x, r["keys"]) for r in replays.frames(texts).orderBy("match_id", "seq").collect()]
    assert got == [("a", 16, 10.0, 1), ("a", 32, 11.0, 0), ("b", 16, 1.0, 3)]


def test_telemetry(spark):
    who = lambda n, t=1: {"accountId": f"acc.{n}", "name": n, "teamId": t, "health": 90, "location": {"x": 1, "y": 2, "z": 3}}
    events = [{"_T": "LogMatchStart", "_D": "2024-01-01T00:00:00Z", "mapName": "Erangel", "characters": [{"character": who("z", 4)}]}, {"_T": "LogPlayerPosition", "_D": "2024-01-01T00:00:10Z", "character": who("a")}]
    events += [{"_T": "LogPlayerKillV2", "_D": f"2024-01-01T00:00:{20 + i}.500Z", "killer": who("a"), "victim": who(f"v{i}", 2), "damageReason": "HeadShot", "damageCauserName": "w"} for i in range(6)]
    events += [{"_T": "LogPlayerKillV2", "_D": "2024-01-01T00:01:00Z", "killer": who("a"), "victim": who("a")}, {"_T": "LogPlayerAttack", "_D": "2024-01-01T00:00:12Z", "attacker": who("a"), "weapon": {"itemId": "gun"}}]
    m = converters.telemetry(_files(spark, json.dumps(events)))
    assert m.kills.count() == 6 and sorted(r.tick for r in m.kills.collect())[0] == 105 and all(r.headshot for r in m.kills.collect())
    assert m.shots.first().weapon == "gun" and m.matches.first().capabilities == ["kills", "positions", "shots", "teams"] and m.players.count() == 8


def test_dissections(spark):
    people = [{"profileID": "p1", "username": "A", "teamIndex": 0}, {"profileID": "p2", "username": "B", "teamIndex": 1}]
    rounds = [{"header": {"roundNumber": n, "map": {"name": "Bank"}}, "players": people, "matchFeedback": [{"type": {"name": "Kill"}, "username": "A", "target": "B", "timeInSeconds": 30.0, "headshot": True}, {"type": "Plant", "username": "A"}, {"type": "kill", "username": "A", "target": "nobody", "timeInSeconds": 99}]} for n in (1, 2)]
    m = converters.dissections(_files(spark, json.dumps(rounds)))
    assert sorted((r.tick, r.round_num) for r in m.kills.collect()) == [(30, 1), (61, 2)]
    assert sorted(tuple(r)[1:] for r in m.rounds.collect()) == [(1, 0, 30), (2, 31, 61)] and m.matches.first().capabilities == ["kills", "teams"]


def test_lines_round_trip(spark, tmp_path):
    rows = simulation.match(5, 1, {}, length=300)
    m = simulation.to_matches(spark, rows)
    ingest.write_lines(m, str(tmp_path / "out"))
    back = ingest.json_lines(spark.read.text(str(tmp_path / "out")).select("match_id", F.monotonically_increasing_id().alias("seq"), "value"))
    got = ingest.build(back)
    assert got.ticks.count() == m.ticks.count() and got.kills.count() == m.kills.count() and got.shots.count() == m.shots.count()
    one = lambda x: sorted(map(tuple, x.ticks.filter("tick < 1003").select("tick", "steamid", "x", "yaw", "is_alive", "team").collect()))
    assert one(got) == one(m)


def test_frames_with_fractions(spark):
    from tellstone.sources import replays

    rows = spark.createDataFrame([("m", "12.0|1|2|0,16.5|3|4|1,10|5|6|2.0,x|1|1|1,nan|1|1|1")], "match_id string, frames string")
    assert [(r.ms, r.x, r["keys"]) for r in replays.frames(rows).orderBy("seq").collect()] == [(12, 1.0, 0), (28, 3.0, 1), (38, 5.0, 2)]


def test_lifetime_segment_and_unknown_platforms(spark):
    from tellstone.plans import risk

    segment = lambda kind, name, n: f'{{"type": "{kind}", "metadata": {{"name": "{name}"}}, "stats": {{"headshots": {{"value": {n}}}}}}}'
    payload = lambda *s: f'{{"data": {{"platformInfo": {{"platformUserHandle": "h"}}, "segments": [{", ".join(s)}]}}}}'
    rows = [("tracker", "a", payload(segment("season", "Lifetime", 9000), segment("overview", "Lifetime", 3000))), ("tracker", "b", payload(segment("overview", "Now", 9000), segment("overview", "Lifetime", 10))), ("tracker", "c", "{}"), ("other", "d", "{}"), (None, "e", "{}"), ("osu", "f", None)]
    got = {r.account: (r.risk, r.error) for r in risk.platform_profiles(spark.createDataFrame(rows, "platform string, account string, payload string")).collect()}
    assert got == {"a": (25, False), "b": (0, False), "c": (0, False), "d": (0, False), "e": (0, False), "f": (0, True)}


def test_key_values():
    from tellstone.sources import valve

    assert valve.parse_text('"a" { "b" "c" // "x" "y"\n "d" "http://e" } } "f" "g" { "h" "i" }') == {"a": {"b": "c", "d": "http://e"}, "f": "g", "h": "i"}
    assert valve.parse_text('"a" { "b" "c"') == {"a": {"b": "c"}} and valve.parse_text('"a" "b') == {}
    whole = b"\x00t\x00\x01n\x00v\x00\x02k\x00\x05\x00\x00\x00\x08\x08"
    assert valve.parse_binary(whole) == {"t": {"n": "v", "k": 5}} and valve.parse_binary(whole[:12]) == {}


def test_a_record_is_parsed_once_for_its_fields(spark):
    """Nor is the text of a record computed again by the filters on its kind and its player."""
    text = F.to_json(F.struct(F.lit("tick").alias("type"), F.col("id").alias("frame"), F.lit(7).alias("uid"), F.lit(" ct ").alias("side"), F.lit(None).cast("string").alias("alive")))
    lines = spark.range(3).select(F.lit("m").alias("match_id"), F.col("id").alias("seq"), text.alias("value"))
    ticks = ingest.build(ingest.json_lines(lines)).ticks
    assert [(r.tick, r.steamid, r.team, r.is_alive, r.health, r.x) for r in ticks.orderBy("seq").collect()] == [(k, 7, 3, True, 100, 0.0) for k in range(3)]
    plan = ticks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1 and "steam_id" in plan and "$.steam_id" not in plan
