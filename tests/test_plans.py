import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tellstone import schema
from tellstone.plans import catalog, history, learn, plugins, report, risk, share, simulation
from tellstone.schema import Matches
from tellstone.sources import launchers, valve

BASE = 76561197960265728


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    rng = random.Random(4)
    rows = []
    for k in range(600):
        p, bad = BASE + k % 200, k % 200 < 30
        sig = {n: (min(1.0, max(0.0, rng.gauss(0.7 if bad and n != "burst" else 0.2, 0.15))), 10, True, {}) for n in ("snap", "recoil", "burst")}
        rows.append((f"m{k // 20}", p, f"n{p}", 60.0 * sig["snap"][0] + 30, sig, int(bad), k))
    schema = "match_id string, steamid long, name string, score double, signals map<string,struct<value:double,samples:bigint,confident:boolean,raw:map<string,double>>>, label int, analyzed_at long"
    return spark.createDataFrame(rows, schema).cache()


def test_training_finds_the_planted_signals(spark, labelled, tmp_path):
    rows = history.split_by(learn.features(labelled, ["snap", "recoil", "burst"]), "player")
    assert not {r[0] for r in rows.filter("test").select("player").collect()} & {r[0] for r in rows.filter("not test").select("player").collect()}
    model = learn.train(rows.filter("not test"), ["snap", "recoil", "burst"])
    assert min(model.weights["snap"], model.weights["recoil"]) > abs(model.weights["burst"])
    exact = learn.train_exact(rows.filter("not test"), ["snap", "recoil", "burst"], epochs=30)
    assert exact.weights["snap"] > exact.weights["burst"]
    scored = labelled.join(rows.filter("test").select(F.col("player").alias("steamid")).distinct(), "steamid").select(F.col("steamid").alias("player"), "label", model.probability().alias("score"))
    assert learn.evaluate(scored).first().auc > 0.9
    model.save(str(tmp_path / "m.json"))
    assert learn.Model.load(str(tmp_path / "m.json")) == model and abs(sum(model.scoring_weights().values()) - 1) < 1e-3
    with pytest.raises(ValueError, match="are needed"):
        learn.train(rows.limit(5), ["snap"])


def test_exchange_names_nobody(spark, labelled, tmp_path):
    import hashlib
    import hmac

    share.exported(labelled, b"salt", ["snap", "burst"]).coalesce(1).write.json(str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.json")).read_text()
    assert str(BASE)[:12] not in text and "match" not in text and '"n7' not in text
    rows = share.read(spark, str(tmp_path / "out"))
    want = hmac.new(b"salt", str(BASE).encode(), hashlib.sha256).hexdigest()[:20]
    assert rows.count() == 600 and rows.filter(F.col("p") == want).count() == 3
    assert share.summary(spark, str(tmp_path / "out")).first().positives == 30


def test_history(spark, labelled, tmp_path):
    assert {r.name for r in history.signal_distribution(labelled).collect()} == {"snap", "recoil", "burst"}
    history.save_observations(labelled, str(tmp_path / "o"))
    history.save_observations(labelled.filter("match_id = 'm1'").withColumn("score", F.lit(1.0)), str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.count() == 600 and back.filter("score = 1.0").count() == 20
    assert history.players_of(labelled).agg(F.min("matches_seen")).first()[0] == 3
    pairs = history.co_occurrence(labelled.withColumn("team", F.lit(2)), "match_id", "steamid", "team", "score").collect()
    assert len(pairs) == 10 * 190 and all(r.together == 3 == r.same_team for r in pairs)
    watched = spark.createDataFrame([(BASE, "l", "r")], "steamid long, label string, reason string")
    assert history.watch_hits(labelled.drop("label"), watched).count() == 3
    flagged = labelled.withColumn("flags", F.when(F.col("steamid") == BASE + 1, F.array(F.lit("small_sample"))).otherwise(F.array().cast("array<string>")))
    assert not {BASE, BASE + 1} & {r.steamid for r in history.auto_watch(flagged, watched, 50).collect()}
    checks = "steamid long, vac_banned int, game_bans int, community_ban int, days_since_ban int"
    old, new = spark.createDataFrame([(1, 1, 0, 0, 5)], checks), spark.createDataFrame([(1, 1, 0, 0, 9), (2, 0, 2, 0, 1), (3, 0, 0, 0, None)], checks)
    assert {(r.steamid, r.new) for r in history.recheck(old, new).collect()} == {(1, False), (2, True)}
    assert history.ban_rollup(old.union(new)).filter("steamid = 1").first().days_since_ban == 5


def test_risk(spark):
    payloads = {"lichess": {"username": "a", "tosViolation": True}, "chesscom": {"username": "b", "status": "closed:fair_play_violations"}, "gametools": {"userName": "c", "headShots": "62%"}, "faceit": {"nickname": "d", "bans": [{"x": 1}]}, "battlemetrics": {"data": [1, 2, 3, 4, 5]}, "osu": [], "opendota": {"profile": {"personaname": "e"}}}
    xml = "<profile><steamID><![CDATA[Zed]]></steamID><vacBanned>1</vacBanned><privacyState>private</privacyState><isLimitedAccount>0</isLimitedAccount></profile>"
    rows = [(k, "acc", json.dumps(v)) for k, v in payloads.items()] + [("steamcommunity", "acc", xml), ("runescape", "acc", "-1,-1,-1\n5,5"), ("tracker", "acc", None)]
    got = risk.platform_profiles(spark.createDataFrame(rows, "platform string, account string, payload string"))
    by = {r.platform: r for r in got.collect()}
    assert {k: r.risk for k, r in by.items()} == {"lichess": 90, "chesscom": 90, "gametools": 35, "faceit": 60, "battlemetrics": 100, "osu": 40, "opendota": 0, "steamcommunity": 60, "runescape": 20, "tracker": 0}
    assert by["tracker"].error and by["steamcommunity"].shown == "Zed"
    local = spark.createDataFrame([("acc", 30, ["new"]), ("other", 5, [])], "account string, risk int, reasons array<string>")
    both = {r.account: r for r in risk.merged(local, got).collect()}
    assert both["acc"].risk == 100 and "lichess: violation of the terms" in both["acc"].reasons and both["other"].risk == 5
    account = spark.createDataFrame([(1, 0, 0, True, 10.0, 10, 2), (0, 0, 0, False, 900.0, 0, 0)], "vac_banned int, game_bans int, created_at long, private boolean, hours double, friends int, banned_friends int")
    assert sorted(r.risk for r in risk.steam_account(account, F.lit(50 * 86400)).collect()) == [25, 100]


def test_plugins(spark, tmp_path):
    (tmp_path / "good.py").write_text('REQUIRES = {"positions"}\nPRODUCES = ("far",)\ndef analyze(ticks, params):\n    return {"far": (float(ticks.x.max() > 1), len(ticks), True)}\n')
    (tmp_path / "bad.py").write_text('REQUIRES = set()\nPRODUCES = ("no",)\ndef analyze(ticks, params):\n    return 1\n')
    (tmp_path / "broken.py").write_text("x =")
    (tmp_path / "_hidden.py").write_text("x =")
    found = dict(plugins.discover(str(tmp_path)))
    assert set(found) == {"good", "bad", "broken"} and isinstance(found["broken"], str)
    from tellstone.params import Params

    m = simulation.cursor_match(spark, {"a": [(0, 5.0, 1.0, 0), (16, 6.0, 1.0, 0)]})
    assert [(r.name, r.value, r.samples) for r in found["good"].plan(m, Params()).collect()] == [("far", 1.0, 2)]
    wrong = found["bad"].plan(m, Params()).first()
    assert wrong.name == "plugin_bad_error" and wrong.evidence[0].detail
    with pytest.raises(ValueError):
        plugins.register("x", set(), (), lambda t, p: {})
    with pytest.raises(ValueError):
        plugins.register("x", set(), ("y",), lambda t, p: {}, ("deaths",))


def test_plugins_see_the_tables_they_name(spark, tmp_path):
    from tellstone.params import Params

    (tmp_path / "duel.py").write_text('REQUIRES = {"kills"}\nPRODUCES = ("duel",)\nTABLES = ("kills", "rounds", "shots")\ndef analyze(t, params):\n    return {"duel": (int(t["kills"].attacker.max() % 10) / 10, len(t["kills"]) + 10 * len(t["shots"]) + 100 * len(t["rounds"]), True)}\n')
    m = Matches.empty(spark)
    big = 76561197960265730
    m.players = spark.createDataFrame([("m", big, "a", 2), ("m", big + 1, "b", 3), ("m", big + 2, "c", 3)], schema.PLAYERS)
    kill = lambda k, a, b: ("m", k, k, a, b, "w", False, 1, False, False, 0)
    m.kills = spark.createDataFrame([kill(1, big, big + 1), kill(2, big, 5), kill(3, None, big + 1)], schema.KILLS)
    m.rounds = spark.createDataFrame([("m", 1, 0, 9), ("m", 2, 10, 19)], schema.ROUNDS)
    found = dict(plugins.discover(str(tmp_path)))["duel"].plan(m, Params()).collect()
    assert sorted((r.steamid - big, r.name, r.samples) for r in found) == [(0, "duel", 202), (1, "duel", 202), (2, "plugin_duel_error", 0)]
    assert {r.value for r in found if r.name == "duel"} == {big % 10 / 10}


def test_held_out_metrics(spark):
    rows = spark.range(800).select((F.col("id") % 200).alias("player"), (F.col("id") % 4 == 0).cast("int").alias("label"), (F.when(F.col("id") % 4 == 0, 0.9).otherwise(0.1) + F.col("id") % 7 / 100).alias("snap"))
    model = learn.train_held_out(rows, ["snap"])
    assert model.metrics == {"precision": 1.0, "recall": 1.0, "f1": 1.0, "auc": 1.0}
    assert model.trained_on["trained"] + model.trained_on["held_out"] == 800 and 120 < model.trained_on["held_out"] < 360
    with pytest.raises(ValueError):
        learn.train_held_out(rows.limit(20), ["snap"])


def test_reports_escape(spark):
    rows = [("m", 1, "<b>", 2, 3, 4, 1, 9, 33.333, 61.25, {"snap": (0.91239, 5, True, {})}, ["review"], [("snap", "snap", 1, 5, "<i>", "t")])]
    schema = "match_id string, steamid long, name string, team int, kills long, deaths long, headshots long, shots long, hs_pct double, score double, signals map<string,struct<value:double,samples:bigint,confident:boolean,raw:map<string,double>>>, flags array<string>, evidence array<struct<signal:string,kind:string,round:int,tick:int,detail:string,target:string>>"
    df = spark.createDataFrame(rows, schema)
    page = report.html(df)
    assert "<b>" not in page and "&lt;b&gt;" in page and "<i>" not in page and "verdict" in page
    assert "snap" in report.text(df) and report.ranked(df).first().signals["snap"].value == 0.912 and report.index(df).count() == 1


def test_keyvalues(spark):
    text = '"AppState"\n{\n  "name" "A \\"b\\"" // c\n  // "x" "y"\n  "dir" "C:\\\\x"\n  "inner" { "k" "v" }\n}\n'
    assert valve.parse_text(text) == {"AppState": {"name": 'A "b"', "dir": "C:\\x", "inner": {"k": "v"}}}
    assert valve.parse_text("") == {} == valve.parse_binary(b"")
    data = b"\x00shortcuts\x00\x000\x00\x01AppName\x00Game\x00\x02appid\x00\x05\x00\x00\x00\x08\x08\x08"
    assert valve.parse_binary(data) == {"shortcuts": {"0": {"AppName": "Game", "appid": 5}}}
    got = spark.createDataFrame([(text, bytearray(data))], "t string, b binary").select(F.get_json_object(valve.text_json("t"), "$.AppState.inner.k"), F.get_json_object(valve.binary_json("b"), "$.shortcuts.0.appid")).first()
    assert tuple(got) == ("v", "5")


def test_launchers(spark, tmp_path):
    apps = tmp_path / "steamapps"
    apps.mkdir()
    (apps / "appmanifest_730.acf").write_text('"AppState" { "appid" "730" "name" "Game" "installdir" "g" "SizeOnDisk" "7" }')
    (tmp_path / "a.item").write_text('{"DisplayName": "E", "AppName": "e"}')
    (tmp_path / "b.item").write_text("{")
    with sqlite3.connect(tmp_path / "l.db") as db:
        db.execute("CREATE TABLE games (name, directory, slug, installed)")
        db.executemany("INSERT INTO games VALUES (?, ?, ?, ?)", [("L", "/l", "l", 1), ("M", "/m", "m", 0)])
    (tmp_path / "bad.db").write_text("no database")
    (tmp_path / "flat" / "org.x.Tool").mkdir(parents=True)
    rows, errors = launchers.installed(spark, {"steam": (tmp_path,), "epic": (tmp_path,), "lutris": (tmp_path / "l.db",), "itch": (tmp_path / "bad.db",), "flatpak": (tmp_path / "flat",), "snap": (tmp_path / "none",), "amazon": (tmp_path / "none.db",)})
    assert {(r.name, r.launcher) for r in rows.collect()} == {("Game", "steam"), ("E", "epic"), ("L", "lutris"), ("Tool", "flatpak")} and set(errors) == {"itch"}
    twice = rows.unionByName(rows.withColumn("app_id", F.lit("")).withColumn("name", F.upper("name")))
    assert {r.app_id for r in launchers.deduplicated(twice).filter("launcher = 'steam'").collect()} == {"730"}


def test_catalog(spark):
    games = spark.createDataFrame([("cs2", "full", 730), ("tft", "account", None), ("x", "none", None)], "key string, support string, steam_appid int")
    hints = spark.createDataFrame([(2, "counter", "cs2"), (1, "counter tactics", "tft")], "ordinal int, hint string, key string")
    rows = spark.createDataFrame([("Counter Tactics", ""), ("Counter", ""), ("Other", "730"), ("Nope", "1")], "name string, app_id string")
    assert {r.name: r.key for r in catalog.identify(rows, games, hints).collect()} == {"Counter Tactics": "tft", "Counter": "cs2", "Other": "cs2", "Nope": None}
    assert {r.support: r.n for r in catalog.counts(games).collect()} == {"full": 1, "account": 1, "none": 1, "total": 3}
    assert {r.key for r in catalog.at_least(games, "account").collect()} == {"cs2", "tft"}
    assert "angles" in catalog.capabilities(games).filter("key = 'cs2'").first().capabilities


def test_no_answer_stops_the_others(spark):
    rows = [("runescape", "a", "no such player"), ("runescape", "b", ""), ("runescape", "c", "1,x,2"), ("runescape", "d", "\n\n5, 7 ,9"), ("runescape", "e", None), ("lichess", "f", "not json"), ("lichess", "g", '{"tosViolation": true}'), (None, "h", "x"), ("never heard of", "i", "1"), ("battlemetrics", "j", "[")]
    got = {r.account: (r.risk, r.reasons, r.error) for r in risk.platform_profiles(spark.createDataFrame(rows, "platform string, account string, payload string")).collect()}
    assert got == {
        "a": (20, ["no level"], False), "b": (0, ["no profile in the lists"], False), "c": (0, [], True), "d": (0, [], False), "e": (0, [], True), "f": (0, [], False),
        "g": (90, ["violation of the terms"], False), "h": (0, [], False), "i": (0, [], False), "j": (0, [], False),
    }
    plan = risk.platform_profiles(spark.createDataFrame(rows, "platform string, account string, payload string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Union" not in plan


def test_explain_takes_the_latest_of_a_source(spark):
    rows = [(1, 50.0, 3, "Cup A"), (1, 90.0, 2, "cup b"), (1, 90.0, 1, "league"), (1, 10.0, 4, "CUP c"), (2, None, 1, "x"), (2, None, 2, None)]
    df = spark.createDataFrame(rows, "steamid long, score double, at long, source string")
    best = history.explain(df, "steamid", "score", "at").orderBy("steamid").collect()
    assert [tuple(r) for r in best] == [(1, 90.0, 2, "cup b", 3), (2, None, 2, None, 1)]
    assert [tuple(r) for r in history.explain(df, "steamid", "score", "at", "source", "Cup").collect()] == [(1, 10.0, 4, "CUP c", 3)]
