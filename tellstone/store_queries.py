"""What is kept over time: checks, players, saved observations, plugins and models, with SQL of the same rules.

An order stands for a check of its customer: a high total is a ban, every
seventh order a ban in a game.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geometry as g
from .plans import history as h
from .plans import learn, plugins
from .plans.event_stream import as_match
from .queries import E, _shared, events, query, shown, table

CHECKS = """c AS (SELECT o_custkey AS steamid, o_orderdate AS at, CAST(o_totalprice > 250000 AS INTEGER) AS vac_banned, CAST(o_orderkey % 7 = 0 AS INTEGER) AS game_bans,
CAST(date_diff('day', o_orderdate, TIMESTAMP '2001-01-01') AS INTEGER) AS days_since_ban, 0 AS community_ban FROM orders)"""
BEFORE, SINCE = "at < timestamp_ntz'1997-01-01'", "at >= timestamp_ntz'1997-01-01'"


def checks(spark, d):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("steamid"), at.alias("at"), (F.col("o_totalprice") > 250000).cast("int").alias("vac_banned"), (F.col("o_orderkey") % 7 == 0).cast("int").alias("game_bans"), F.datediff(F.lit("2001-01-01").cast("date"), at.cast("date")).alias("days_since_ban"), F.lit(0).alias("community_ban"))


@query(f"WITH {CHECKS} SELECT steamid, max(vac_banned) AS vac_banned, max(game_bans) AS game_bans, min(days_since_ban) AS days_since_ban FROM c GROUP BY 1")
def ban_rollup(spark, d):
    return h.ban_rollup(checks(spark, d))


@query(f"""WITH {CHECKS}, b AS (SELECT * FROM c WHERE vac_banned > 0 OR game_bans > 0)
SELECT DISTINCT steamid, NOT EXISTS (SELECT 1 FROM b k WHERE k.steamid = b.steamid AND k.at < TIMESTAMP '1997-01-01') AS new FROM b WHERE b.at >= TIMESTAMP '1997-01-01'""")
def recheck_bans(spark, d):
    rows = checks(spark, d)
    return h.recheck(rows.filter(BEFORE), rows.filter(SINCE))


@query(f"WITH {CHECKS} SELECT steamid, count(*) AS checks, sum(vac_banned)::BIGINT AS banned FROM c GROUP BY 1")
def appended_checks(spark, d):
    """Checks written in two appends and read back."""
    rows, path = checks(spark, d), _shared(spark, "checks")
    h.save_checks(rows.filter(BEFORE), path)
    h.save_checks(rows.filter(SINCE), path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("steamid").agg(F.count(F.lit(1)).alias("checks"), F.sum("vac_banned").alias("banned"))


@query("""WITH r AS (SELECT o_custkey AS steamid, max(o_totalprice) / 5000 AS score, count(*) < 10 AS small FROM orders GROUP BY 1)
SELECT steamid, round(score, 6) AS score FROM r WHERE score >= 45 AND NOT small AND steamid NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def auto_watch(spark, d):
    report = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("steamid")).agg((F.max("o_totalprice") / 5000).alias("score"), F.when(F.count(F.lit(1)) < 10, F.array(F.lit("small_sample"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    watched = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("steamid"))
    return h.auto_watch(report, watched, 45).select("steamid", F.round("score", 6).alias("score"))


@query(f"WITH {E} SELECT user_id AS steamid, arg_max('n' || k, event_id) AS last_name, min(event_id) AS first_seen, max(event_id) AS last_seen, count(DISTINCT day) AS matches_seen FROM e GROUP BY 1")
def players_seen(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("steamid"), F.concat(F.lit("n"), "k").alias("name"), F.col("day").alias("match_id"), F.col("event_id").alias("analyzed_at"))
    return h.players_of(rows)


@query("SELECT event_id, event_type AS match_id, CASE WHEN event_type = 'purchase' THEN value * 2 ELSE value END AS value FROM events")
def saved_again(spark, d):
    """Observations saved by match; a match that is saved again is replaced, the others stay."""
    rows, path = table(spark, d, "events").select("event_id", F.col("event_type").alias("match_id"), "value"), _shared(spark, "observations")
    h.save_observations(rows, path)
    h.save_observations(rows.filter("match_id = 'purchase'").withColumn("value", F.col("value") * 2), path)
    return spark.read.schema(rows.schema).parquet(path).select("event_id", "match_id", "value")


def _share_of_kills(frames, params):
    """A plugin: kills for each shot or kill, and rounds with a kill among all."""
    kills, shots, rounds = frames["kills"], frames["shots"], frames["rounds"]
    n = len(kills) + len(shots)
    return {"kill_share": (len(kills) / n if n else 0.0, n, n >= 20), "active_rounds": (kills["round_num"].nunique() / len(rounds), len(rounds), True)}


@query(f"""WITH {E}, c AS (SELECT user_id, count_if(event_type = 'purchase') AS kills, count_if(event_type IN ('purchase', 'click')) AS n, count(DISTINCT CASE WHEN event_type = 'purchase' THEN day END) AS active, (SELECT count(DISTINCT day) FROM e) AS rounds FROM e GROUP BY 1)
SELECT user_id AS steamid, 'kill_share' AS name, {shown('coalesce(kills / nullif(n, 0), 0)')} AS value, CAST(n AS BIGINT) AS samples, n >= 20 AS confident FROM c
UNION ALL SELECT user_id, 'active_rounds', {shown('active / rounds')}, rounds, true FROM c""")
def plugin_tables(spark, d):
    """A user's detector over kills, shots and rounds."""
    found = plugins.register("shares", {"kills"}, ("kill_share", "active_rounds"), _share_of_kills, ("kills", "shots", "rounds"))
    return found.plan(as_match(events(spark, d)), None).select("steamid", "name", g.shown("value").alias("value"), "samples", "confident")


@query("""WITH r AS (SELECT d.doc_id % 100 AS player, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS label, round_even(100 / (1 + exp(-(0.5::DOUBLE - 3.0::DOUBLE * least(1.0, n_chars / 5000.0::DOUBLE)))), 1) AS score FROM documents d JOIN labels USING (doc_id)),
p AS (SELECT player, max(score) >= 50 AS hit, max(label) = 1 AS bad FROM r GROUP BY 1),
c AS (SELECT count_if(hit AND bad) AS tp, count_if(hit AND NOT bad) AS fp, count_if(NOT hit AND bad) AS fn, count_if(NOT hit AND NOT bad) AS tn FROM p),
k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rank FROM r),
a AS (SELECT coalesce((sum(CASE WHEN label = 1 THEN rank END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0) / nullif(count_if(label = 1) * count_if(label <> 1), 0), 0.5) AS auc FROM k)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(auc, 6) AS auc FROM c, a""")
def evaluated_model(spark, d):
    """Precision, recall, F1 and area under the curve of a model's probabilities."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.col("doc_id") % 100).alias("player"), (F.col("quality") == 0).cast("int").alias("label"), F.create_map(F.lit("length"), F.struct(g.clamp01(F.col("n_chars") / 5000.0).alias("value"))).alias("signals"))
    scored = rows.select("player", "label", learn.Model({"length": -3.0}, 0.5).probability().alias("score"))
    return learn.evaluate(scored).select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "auc")])


#: Stretches of the parts' names, as ordered hints: three of each part, so there are thousands.
HINTS_SQL = """h AS (
  SELECT (p_partkey * 7919 + k * 104729) % 1000003 * 3 + k AS ordinal, lower(substr(p_name, CAST(1 + (p_partkey + k) % 5 AS BIGINT), CAST(2 + (p_partkey + 3 * k) % 7 AS BIGINT))) AS hint, 'h' || p_partkey || '.' || k AS key
  FROM part, (SELECT unnest([0, 1, 2]) AS k))"""


def many_hints(spark, d):
    k, part = F.col("k"), F.col("p_partkey")
    rows = table(spark, d, "part").withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    hint = F.lower(F.substring("p_name", (1 + (part + k) % 5).cast("int"), (2 + (part + 3 * k) % 7).cast("int")))
    return rows.select(((part * 7919 + k * 104729) % 1000003 * 3 + k).alias("ordinal"), hint.alias("hint"), F.concat(F.lit("h"), part, F.lit("."), k).alias("key"))


@query(f"""WITH {HINTS_SQL} SELECT p_partkey, (SELECT arg_min(key, (ordinal, key)) FROM h WHERE contains(lower(trim(p_name || ' ' || p_type)), hint)) AS hint FROM part""")
def hint_many(spark, d):
    """The first of thousands of ordered hints in each part's name and type."""
    from .operators import hints

    rows = table(spark, d, "part").withColumn("text", F.concat("p_name", F.lit(" "), "p_type"))
    return hints.first_hint(rows, "text", many_hints(spark, d), "hint").select("p_partkey", "hint")


@query(f"""WITH {HINTS_SQL} SELECT p_partkey, (SELECT arg_min(key, (ordinal, key)) FROM h WHERE contains(lower(trim(p_brand || ' ' || p_name)), hint)) AS launcher FROM part""")
def hint_launcher(spark, d):
    """The launcher that an installed game's name and publisher hint at."""
    from .plans import catalog

    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name"), F.col("p_name").alias("publisher"))
    return catalog.launcher(rows, many_hints(spark, d)).select("p_partkey", "launcher")


#: Answers of platforms on both sides of each rule, with the risk and the reasons that they give: those of customer k are the (k mod n)-th.
ANSWERS = [
    ("lichess", '{"username": "a", "tosViolation": true}', 90, 1), ("lichess", '{"username": "a"}', 0, 0),
    ("chesscom", '{"status": "closed:fair_play_violations"}', 90, 1), ("chesscom", '{"status": "premium"}', 0, 0),
    ("gametools", '{"headShots": "40.0%"}', 35, 1), ("gametools", '{"headShots": "39.9%"}', 0, 0),
    ("osu", "[]", 40, 1), ("osu", '[{"user_id": "7", "username": "u"}]', 0, 0),
    ("faceit", '{"nickname": "f", "bans": [{"x": 1}]}', 60, 1), ("faceit", '{"nickname": "f", "bans": []}', 0, 0),
    ("openxbl", '{"people": []}', 30, 1), ("openxbl", '{"people": [{"xuid": "1", "gamertag": "g"}]}', 0, 0),
    ("battlemetrics", '{"data": [{}, {}, {}]}', 75, 1), ("battlemetrics", '{"data": [{}, {}, {}, {}, {}]}', 100, 1), ("battlemetrics", '{"data": []}', 0, 0),
    ("steamcommunity", "<p><vacBanned>1</vacBanned><privacyState>private</privacyState></p>", 60, 2), ("steamcommunity", "<p><vacBanned>0</vacBanned></p>", 0, 0),
    ("runescape", "no such player", 20, 1), ("runescape", "", 0, 1), ("runescape", "1,0,0", 20, 1), ("runescape", "1,500,9\n2,3,4", 0, 0), ("runescape", "1,many,9", 0, 0),
    ("unknown", "{}", 0, 0), ("lichess", None, 0, 0),
]


ANSWERS_SQL = "SELECT c_custkey, CASE c_custkey % {n} {risk} END AS risk, CASE c_custkey % {n} {reasons} END AS n_reasons, c_custkey % {n} IN ({failed}) AS error FROM customer".format(
    n=len(ANSWERS), risk=" ".join(f"WHEN {i} THEN {a[2]}" for i, a in enumerate(ANSWERS)), reasons=" ".join(f"WHEN {i} THEN {a[3]}" for i, a in enumerate(ANSWERS)),
    failed=", ".join(str(i) for i, a in enumerate(ANSWERS) if a[1] is None or "many" in a[1]))


@query(ANSWERS_SQL)
def platform_answers(spark, d):
    """Every rule of the platforms in one pass over captured answers, with those that fail."""
    from .plans import risk

    k = F.col("c_custkey") % len(ANSWERS)
    choose = lambda i: F.coalesce(*[F.when(k == n, F.lit(a[i])) for n, a in enumerate(ANSWERS)])
    found = risk.platform_profiles(table(spark, d, "customer").select("c_custkey", choose(0).alias("platform"), choose(1).alias("payload")))
    return found.select("c_custkey", "risk", F.size("reasons").alias("n_reasons"), "error")


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_custkey AS steamid FROM orders), m AS (SELECT DISTINCT day FROM o),
n AS (SELECT day FROM m ORDER BY day DESC LIMIT 500), w AS (SELECT c_custkey AS steamid FROM customer WHERE c_mktsegment = 'MACHINERY'),
k AS (SELECT * FROM o WHERE day IN (FROM n) OR steamid IN (FROM w)), l AS (SELECT day FROM m WHERE day IN (FROM n) OR day IN (SELECT day FROM k))
SELECT (SELECT count(*) FROM m) AS matches, (SELECT count(*) FROM m) - (SELECT count(*) FROM l) AS matches_removed, (SELECT count(*) FROM o) - (SELECT count(*) FROM k) AS observations_removed,
  (SELECT count(*) FROM w) AS protected, (SELECT count(*) FROM k) AS observations_left, (SELECT count(*) FROM l) AS matches_left, (SELECT count(*) FROM orders) AS checks_left, true AS as_announced""")
def prune_versions(spark, d):
    """Old matches leave a store in a new version, after a dry run that counts the same."""
    from .store import Store

    orders = table(spark, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("match_id"), F.col("o_custkey").alias("steamid"), F.unix_date(F.to_date("o_orderdate")).cast("long").alias("analyzed_at"))
    watched = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("steamid"))
    store = Store(spark, _shared(spark, "store"))
    store.write({"observations": orders.drop("analyzed_at"), "matches": orders.select("match_id", "analyzed_at").distinct(), "checks": checks(spark, d), "watched": watched})
    said = h.prune_store(store, 500).first()
    done = h.prune_store(store, 500, dry_run=False).first()
    left = [store.read(n).agg(F.count(F.lit(1)).alias(f"{n}_left")) for n in ("observations", "matches", "checks")]  # one row each
    out = left[0].crossJoin(left[1]).crossJoin(left[2]).withColumn("as_announced", F.lit(said == done))
    return out.select(*[F.lit(done[c]).cast("long").alias(c) for c in ("matches", "matches_removed", "observations_removed", "protected")], "observations_left", "matches_left", "checks_left", "as_announced")


@query("""WITH f AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id % 3 AS size, count(*) AS files, count(*) FILTER (user_id % 2 = 0 OR n % 2 = 1) AS pending FROM f GROUP BY 1""")
def ledger_pending(spark, d):
    """Files (a user's is as large as its events are many) of which even users' are new and odd counts have grown since they were marked."""
    from .plans import ledger

    files = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("size")).withColumn("path", F.concat(F.lit("/in/"), "user_id", F.lit(".log")))
    path = _shared(spark, "ledger")
    for batch in (0, 0, 1):  # the first comes again
        mine = files.filter(F.col("user_id") % 2 == 1).withColumn("size", F.when(F.col("size") % 2 == 1, F.col("size") - 1).otherwise(F.col("size") - (1 - batch)))
        ledger.mark(mine, path, batch, F.lit(batch))
    ledger.compact(spark, path, f"{path}_compact")
    left = ledger.pending(files, ledger.marks(spark, f"{path}_compact")).select("path", F.lit(1).alias("is_pending"))
    return files.join(left, "path", "left").groupBy((F.col("user_id") % 3).alias("size")).agg(F.count(F.lit(1)).alias("files"), F.count("is_pending").alias("pending"))


def _answers(spark, d):
    """A document for each customer: the player refers to its orders as matches; even ones are included, with an address of every third."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("total"))
    reference = F.struct(F.lit("match").alias("type"), F.col("o_orderkey").cast("string").alias("id"))
    included = F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.lit("match").alias("type"), F.col("o_orderkey").cast("string").alias("id"), F.struct("total", F.lit(None).cast("string").alias("URL")).alias("attributes")))
    asset = F.when(F.col("o_orderkey") % 3 == 0, F.struct(F.lit("asset").alias("type"), F.concat(F.lit("a"), "o_orderkey").alias("id"), F.struct(F.lit(None).cast("long").alias("total"), F.concat(F.lit("https://x/"), "o_orderkey").alias("URL")).alias("attributes")))
    rows = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", reference.alias("r"), included.alias("i"), asset.alias("a")))).alias("all"))
    data = F.array(F.struct(F.lit("player").alias("type"), F.col("o_custkey").cast("string").alias("id"), F.struct(F.struct(F.transform("all", lambda x: x["r"]).alias("data")).alias("matches")).alias("relationships")))
    more = F.array_compact(F.concat(F.transform("all", lambda x: x["i"]), F.transform("all", lambda x: x["a"])))
    return rows.select("o_custkey", F.to_json(F.struct(data.alias("data"), more.alias("included"))).alias("payload"))


@query("""SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS match, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place,
CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS total FROM orders""")
def linked_documents(spark, d):
    """Matches that players' answers refer to, with what the answers include of them."""
    from .plans import documents

    found = documents.resolved(_answers(spark, d), "o_custkey")
    return found.select("o_custkey", F.col("id").alias("match"), F.col("place").cast("long").alias("place"), F.get_json_object("attributes", "$.total").cast("long").alias("total"))


@query("""SELECT o_custkey, count(*) AS matches, 'https://x/' || min(o_orderkey) FILTER (o_orderkey % 3 = 0) AS url FROM orders GROUP BY 1""")
def telemetry_links(spark, d):
    from .plans import documents

    answers = _answers(spark, d)
    matches = documents.matches_of(answers, "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("matches"))
    return matches.join(documents.telemetry_of(answers, "o_custkey"), "o_custkey", "left")


@query("""WITH p AS (SELECT o_custkey AS steamid, epoch(min(o_orderdate))::BIGINT AS first_seen FROM orders GROUP BY 1),
c AS (SELECT o_custkey, epoch(o_orderdate)::BIGINT AS sec FROM orders), n AS (SELECT epoch(TIMESTAMP '2001-08-15')::BIGINT AS now),
w AS (SELECT steamid, first_seen, row_number() OVER (ORDER BY first_seen, steamid) AS r FROM p, n WHERE first_seen <= now - 30 * 86400 AND NOT EXISTS (SELECT 1 FROM c WHERE o_custkey = steamid AND sec >= now - 300 * 86400))
SELECT steamid, first_seen, CAST((r - 1) // 10 AS BIGINT) AS request FROM w WHERE r <= 500""")
def recheck_due(spark, d):
    """Players to look up, in requests of ten."""
    at = lambda c: F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("steamid"), at(F.col("o_orderdate")).alias("at"))
    players = orders.groupBy("steamid").agg(F.min("at").alias("first_seen"))
    found = h.due(players, "steamid", "first_seen", orders, "steamid", F.col("at"), at(F.lit("2001-08-15")), 30, 300, 500, 10)
    return found.select("steamid", "first_seen", "request")


@query("""WITH one AS (SELECT l_orderkey, l_suppkey, min(l_returnflag) AS team, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2), m AS (SELECT l_suppkey, avg(score) AS mean FROM one GROUP BY 1),
p AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS together FROM one x JOIN one y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT a, b, together, round((q.mean + r.mean) / 2, 4) AS pair_mean FROM p JOIN m q ON q.l_suppkey = a JOIN m r ON r.l_suppkey = b WHERE least(round(q.mean, 4), round(r.mean, 4)) >= 20 ORDER BY pair_mean DESC, together DESC, a, b LIMIT 50""")
def pairs_ranked(spark, d):
    """Suppliers often seen in one order, by the mean of both."""
    pairs = h.co_occurrence(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_returnflag", "l_quantity", least=3)
    return h.pairs_report(pairs, 20.0).select("a", "b", "together", "pair_mean")


@query("""WITH v AS (SELECT event_type AS name, value / 100 AS value FROM events UNION ALL SELECT 'score', o_totalprice FROM orders),
s AS (SELECT name, count(value) AS n, round(count_if(value > 0.01) / count(value), 4) AS nonzero, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.99), 4) AS p99, round(max(value), 4) AS max, quantile_cont(value, 0.99) AS q FROM v GROUP BY 1)
SELECT name, n, nonzero, p50, p90, p99, max, name <> 'score' AND p50 > 0.345 AS high, CASE WHEN name = 'score' THEN round(q, 4) END AS threshold,
  CASE WHEN name = 'score' THEN (SELECT CAST(count_if(o_totalprice >= q) AS BIGINT) FROM orders) END AS above FROM s""")
def calibrated(spark, d):
    """Distributions of signals and score, signals that are high for most, and the threshold to review from."""
    return h.calibrate(table(spark, d, "events").withColumn("value", F.col("value") / 100), "event_type", "value", table(spark, d, "orders"), "o_totalprice", high=0.345)
