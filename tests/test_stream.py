from pyspark.sql import functions as F

from tellstone.streaming import live

BASE = 76561197960265728
KILL = 'L 01/15/2024 - 20:00:{:02d}: "A<1><STEAM_1:0:{}><CT>" killed "B<2><STEAM_1:1:{}><TERRORIST>" with "ak47"\n'


def test_alerts_like_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("".join(KILL.format(s, 1, k) for k, s in enumerate((1, 1, 2, 2, 30, 50, 50, 51))) + KILL.format(5, 9, 1) + "noise\n")
    kills = live.kill_stream(live.lines(spark, str(folder)).withColumn("match_id", F.lit("m")))
    got = live.drain(live.burst_alerts(kills), str(tmp_path / "c")).collect()
    assert [(r.attacker - BASE, r["size"], r.event_time.second) for r in sorted(got, key=lambda r: r.event_time)] == [(2, 3, 2), (2, 3, 51)]


def test_roster_tells_each_player_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text('#  2 1 "Some one" STEAM_1:0:12345 05:11 34 0 active 786432\n# 3 2 "B" [U:1:7] 01:00 20 0 active\nx\n' * 2)
    rows = live.roster(live.lines(spark, str(folder))).withColumn("at", F.current_timestamp())
    got = live.drain(live.first_seen(rows, "at"), str(tmp_path / "c")).collect()
    assert sorted((r.steamid, r.name) for r in got) == [(BASE + 7, "B"), (BASE + 24690, "Some one")]


def test_state_payloads(spark):
    rows = spark.createDataFrame([(f'{{"allplayers": {{"{BASE + 1}": {{"name": "a"}}}}, "player": {{"steamid": "{BASE + 2}", "name": "own"}}}}',), (f'{{"player": {{"steamid": "{BASE + 3}", "name": "alone"}}}}',), ("{}",)], "value string")
    assert sorted((r.steamid - BASE, r.name) for r in live.state_roster(rows).collect()) == [(1, "a"), (2, "own"), (3, "alone")]


def test_late_kills_join_their_neighbours_only(spark, tmp_path):
    """Kills of two batches, the second late: no alert for kills far apart, one for the group that the late one completes."""
    folder, out = tmp_path / "in", str(tmp_path / "c")
    folder.mkdir()
    got = []
    for name, seconds in (("a", (1, 20, 40, 41)), ("b", (0, 10, 30)), ("c", (39,))):
        (folder / f"{name}.log").write_text("".join(KILL.format(s, 1, k) for k, s in enumerate(seconds)))
        kills = live.kill_stream(live.lines(spark, str(folder)).withColumn("match_id", F.lit("m")))
        got = live.drain(live.burst_alerts(kills, 2.5, 3, "5 minutes"), out).collect()
        assert len(got) == (name == "c")
    assert [(r["size"], r.event_time.second) for r in got] == [(3, 41)]


def test_failed_batches_are_kept(spark, tmp_path):
    folder, failed = tmp_path / "in", str(tmp_path / "failed")
    folder.mkdir()
    (folder / "a.log").write_text("one\n")

    def handle(batch, number):
        raise RuntimeError("no")

    query = live.watch_folder(spark, str(folder), str(tmp_path / "c"), handle, 1, failed)
    query.processAllAvailable()
    query.stop()
    assert [(r.value, r.error) for r in spark.read.json(failed).collect()] == [("one", "no")]


def test_status_lines_in_both_forms(spark):
    lines = ['#3 1 "n" STEAM_1:0:5 00:10', '  3   "nick"   [U:1:123]', '# 2 1 "a b" [U:1:7] 05:11', "x 3 y"]
    got = live.roster(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.steamid - BASE, r.name) for r in got] == [(10, "n"), (123, "nick"), (7, "a b")]
