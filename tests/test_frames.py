import pytest

from tellstone.sources import frames, loader

TICKS = [
    ("m", "10", "1", "A", "0.5", "1", "2", "3", "4", "True", "2", "100"), ("m", "11", "1", "B", "1", "1", "2", "3", "4", "0", "0", "x"), ("m", "5", "2", None, "1", "1", "2", "3", "4", None, "3", "90"),
    ("m", "-1", "1", "A", "1", "1", "2", "3", "4", "1", "2", "1"), ("m", "7", "0", "A", "1", "1", "2", "3", "4", "1", "2", "1"), ("m", "7", "none", "A", "1", "1", "2", "3", "4", "1", "2", "1"), ("m", "7", "1", "A", None, "1", "2", "3", "4", "1", "2", "1"),
    ("m", "7", "1", "A", "wide", "1", "2", "3", "4", "1", "2", "1"), ("n", "3", "9", "N", "1", "1", "2", "3", "4", "yes", "2", "1"),
]


def tables(spark):
    ticks = spark.createDataFrame(TICKS, "match_id string, tick string, steam_id string, name string, X string, Y string, Z string, pitch string, yaw string, is_alive string, team_num string, health string").coalesce(1)
    deaths = spark.createDataFrame([("m", "12", "1", "2", "true", "ak", "1", "0"), ("m", "2", "1", "2", "no", None, None, "t"), ("m", "3", "", "2", "1", "x", "1", "1")], "match_id string, tick string, attacker_steamid string, user_steamid string, headshot string, weapon string, penetrated string, thrusmoke string")
    fires = spark.createDataFrame([("m", "11", "1", "ak"), ("m", "11", "bot", "ak")], "match_id string, tick string, user_steamid string, weapon string")
    starts = spark.createDataFrame([("m", "10"), ("m", "4"), ("m", "10"), ("m", "x")], "match_id string, tick string")
    return ticks, deaths, fires, starts, spark.createDataFrame([("m", "dust")], "match_id string, map_name string")


def check(m):
    assert sorted((r.match_id, r.tick, r.steamid, r.x, r.is_alive, r.team, r.health, r.round_num) for r in m.ticks.collect()) == [
        ("m", 5, 2, 1.0, True, 3, 90, 1), ("m", 10, 1, 0.5, True, 2, 100, 2), ("m", 11, 1, 1.0, False, 0, 100, 2), ("n", 3, 9, 1.0, True, 2, 1, 0)]
    assert sorted((r.tick, r.attacker, r.victim, r.headshot, r.weapon, r.penetrated, r.through_smoke, r.noscope, r.round_num) for r in m.kills.collect()) == [(2, 1, 2, False, "", 0, True, False, 0), (12, 1, 2, True, "ak", 1, False, False, 2)]
    assert [(r.tick, r.steamid, r.round_num) for r in m.shots.collect()] == [(11, 1, 2)]
    assert sorted((r.number, r.start_tick, r.end_tick) for r in m.rounds.collect()) == [(1, 4, 9), (2, 10, 1_000_000_000)]
    assert sorted((r.match_id, r.steamid, r.name, r.team) for r in m.players.collect()) == [("m", 1, "A", 2), ("m", 2, "2", 3), ("n", 9, "N", 2)]
    assert sorted((r.match_id, r.map_name, "kill_flags" in r.capabilities) for r in m.matches.collect()) == [("m", "dust", True), ("n", "", True)]


def test_frames(spark, tmp_path):
    check(frames.from_frames(*tables(spark)))
    for df, name in zip(tables(spark), ("ticks", "player_death", "weapon_fire", "round_start", "header"), strict=True):
        df.write.parquet(str(tmp_path / name))
        df.write.option("header", True).csv(str(tmp_path / "csv" / name))
    check(loader.load_any(spark, str(tmp_path), adapter="frames"))
    check(loader.load_any(spark, str(tmp_path / "csv"), adapter="frames_csv"))


def test_what_is_missing(spark, tmp_path):
    ticks = tables(spark)[0]
    alone = frames.from_frames(ticks)
    assert alone.kills.count() == alone.rounds.count() == 0 and {r.round_num for r in alone.ticks.collect()} == {0}
    with pytest.raises(ValueError, match="eye_yaw"):
        frames.from_frames(ticks.drop("yaw"))
    with pytest.raises(ValueError, match="no table of ticks"):
        frames.load(spark, str(tmp_path))


def test_lenient_numbers(spark):
    df = spark.createDataFrame([(1.9, "3"), (float("nan"), "3.5"), (None, "x"), (0.4, None)], "d double, s string")
    got = df.select(frames.lenient_int(df.d).alias("d"), frames.lenient_int(df.s, -1).alias("s"), frames.lenient_bool(df.d, "double").alias("b")).collect()
    assert [(r.d, r.s, r.b) for r in got] == [(1, 3, True), (0, -1, True), (0, -1, True), (0, -1, False)]
