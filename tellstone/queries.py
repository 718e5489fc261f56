"""Every operator over the driver's tables, and the SQL that gives the same rows.

Events stand for a match: a user is a player, a day a round, the second of the
event its tick, a purchase a kill, a click a shot.  Orders stand for
observations of customers, line items for rosters, labelled documents for
players with a ban.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions import scalar as s
from .operators import timeline as t
from .plans import history as h
from .plans import score as sc
from .schema import OPEN_END

DAY = 86400
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

E = """e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS INTEGER) AS tick, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(ts AS DATE) AS day FROM events)"""
HINTS = [("steel", "metal"), ("small", "size"), ("brass", "metal"), ("red", "colour"), ("green", "colour"), ("part", "plain")]


def shown(value: str) -> str:
    """SQL of geometry.shown()."""
    return f"round(round_even(({value}) * 1e9::DOUBLE, 0) / 1e3::DOUBLE, 0) / 1e6::DOUBLE"


def scored(raised: str) -> str:
    """SQL of how score.score() rounds."""
    return f"round_even(round_even(({raised}) * 1e7::DOUBLE, 0) / 1e6::DOUBLE, 0) / 10"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", epoch.cast("int").alias("tick"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_date(F.col("ts").cast("timestamp_ntz")).alias("day"))


@query(f"""WITH {E}, r AS (SELECT user_id, tick, event_id, row_number() OVER (PARTITION BY user_id ORDER BY tick, event_id) AS rn FROM e WHERE event_type = 'purchase'),
w AS (SELECT user_id, tick, rn - min(rn) OVER x + 1 AS size, min(tick) OVER x AS start, lead(tick) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS nxt FROM r WINDOW x AS (PARTITION BY user_id ORDER BY tick RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW))
SELECT user_id, start, tick AS "end", CAST(size AS BIGINT) AS size FROM w WHERE size >= 3 AND (nxt IS NULL OR nxt - start > {2 * DAY})""")
def burst_windows(spark, d):
    return t.bursts(events(spark, d).filter("event_type = 'purchase'"), ["user_id"], "tick", ["event_id"], 2 * DAY, 3)


@query(f"""WITH {E}, n AS (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick, event_id) <= 21600 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) AS session FROM n)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(tick) AS start_tick, max(tick) AS end_tick FROM s GROUP BY ALL""")
def sessionize_gap(spark, d):
    numbered = t.sessions(events(spark, d), ["user_id"], ["tick", "event_id"], "tick", 21600)
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("tick").alias("start_tick"), F.max("tick").alias("end_tick"))


@query(f"""WITH {E}, b AS (SELECT user_id, max(tick) AS stop FROM e GROUP BY 1), x AS (SELECT DISTINCT user_id, tick FROM e),
g AS (SELECT user_id, tick, CASE WHEN lead(tick) OVER (PARTITION BY user_id ORDER BY tick) - tick > {DAY} THEN 1 ELSE 0 END AS far FROM x),
c AS (SELECT user_id, tick, sum(far) OVER (PARTITION BY user_id ORDER BY tick DESC ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, min(tick) AS exposure FROM c WHERE island = 0 GROUP BY user_id""")
def islands_tolerant(spark, d):
    times = events(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_set("tick"), asc=False).alias("times"))
    return times.select("user_id", t.last_island(F.col("times"), F.col("times")[0], DAY).alias("exposure"))


@query(f"""WITH {E}, x AS (SELECT user_id, tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS gap FROM e)
SELECT user_id, count(gap) AS gaps, round(coalesce(median(gap), 0), 4) AS median_gap, round(coalesce(stddev_samp(gap), 0), 4) AS sd_gap,
round(CASE WHEN median(gap) <> 0 THEN greatest(0.0, least(1.0, (coalesce(stddev_samp(gap), 0) / median(gap) - 3.0) / (0.5 - 3.0))) ELSE 0.0 END, 6) AS regularity FROM x GROUP BY user_id""")
def gap_regularity(spark, d):
    gap = F.col("tick") - F.lag("tick").over(W.partitionBy("user_id").orderBy("tick", "event_id"))
    out = events(spark, d).withColumn("gap", gap).groupBy("user_id").agg(F.count("gap").alias("gaps"), g.median("gap").alias("m"), g.stdev("gap").alias("sd"))
    return out.select("user_id", "gaps", F.round("m", 4).alias("median_gap"), F.round("sd", 4).alias("sd_gap"), F.round(F.when(F.col("m") != 0, g.ramp(F.col("sd") / F.col("m"), 3.0, 0.5)).otherwise(0.0), 6).alias("regularity"))


@query(f"""WITH {E}, x AS (SELECT *, lag(value) OVER w AS v0, lead(value, 1) OVER w AS v1, lead(value, 2) OVER w AS v2, lead(value, 3) OVER w AS v3 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id))
SELECT user_id, count_if(abs(value - v0) >= 100) AS jumps, count_if(abs(value - v0) >= 100 AND (abs(v1 - v0) <= 20 OR abs(v2 - v0) <= 20 OR abs(v3 - v0) <= 20)) AS returns FROM x GROUP BY user_id""")
def movement_return(spark, d):
    w = W.partitionBy("user_id").orderBy("tick", "event_id")
    rows = events(spark, d).withColumns({"v0": F.lag("value").over(w), **{f"v{k}": F.lead("value", k).over(w) for k in (1, 2, 3)}})
    jump = F.abs(F.col("value") - F.col("v0")) >= 100
    back = F.coalesce(F.least(*[F.abs(F.col(f"v{k}") - F.col("v0")) for k in (1, 2, 3)]) <= 20, F.lit(False))
    return rows.groupBy("user_id").agg(F.count_if(jump).alias("jumps"), F.count_if(jump & back).alias("returns"))


@query(f"""WITH {E}, x AS (SELECT user_id, abs(value - 3 * lag(value, 1) OVER w + 3 * lag(value, 2) OVER w - lag(value, 3) OVER w) AS jerk, abs(value - lag(value) OVER w) AS speed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id))
SELECT user_id, count(jerk) AS n, round(median(jerk / speed), 4) AS median_jerk FROM x WHERE speed >= 0.5 AND jerk IS NOT NULL GROUP BY user_id""")
def third_difference_jerk(spark, d):
    w = W.partitionBy("user_id").orderBy("tick", "event_id")
    back = lambda k: F.lag("value", k).over(w)
    rows = events(spark, d).withColumns({"jerk": F.abs(F.col("value") - 3 * back(1) + 3 * back(2) - back(3)), "speed": F.abs(F.col("value") - back(1))})
    rows = rows.filter((F.col("speed") >= 0.5) & F.col("jerk").isNotNull())
    return rows.groupBy("user_id").agg(F.count("jerk").alias("n"), F.round(F.median(F.col("jerk") / F.col("speed")), 4).alias("median_jerk"))


@query(f"""WITH {E}, x AS (SELECT *, abs(value - lag(value) OVER w) AS speed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tick, event_id)),
y AS (SELECT *, lead(speed) OVER (PARTITION BY user_id ORDER BY tick, event_id) AS nxt FROM x)
SELECT user_id, count(speed) AS samples, count_if(speed >= 100) AS jumps, count_if(speed >= 100 AND nxt < 10) AS stops FROM y GROUP BY user_id""")
def jump_then_stop(spark, d):
    w = W.partitionBy("user_id").orderBy("tick", "event_id")
    rows = events(spark, d).withColumn("speed", F.abs(F.col("value") - F.lag("value").over(w))).withColumn("nxt", F.lead("speed").over(w))
    return rows.groupBy("user_id").agg(F.count("speed").alias("samples"), F.count_if(F.col("speed") >= 100).alias("jumps"), F.count_if((F.col("speed") >= 100) & (F.col("nxt") < 10)).alias("stops"))


@query(f"""WITH {E}, k AS (SELECT e.*, bit, (k & bit) <> 0 AS down FROM e, (VALUES (1), (2), (4), (8)) b(bit)),
u AS (SELECT *, coalesce(lag(down) OVER (PARTITION BY user_id, bit ORDER BY tick, event_id), false) AS was FROM k),
c AS (SELECT *, lead(tick) OVER (PARTITION BY user_id, bit ORDER BY tick, event_id) AS stop FROM u WHERE down <> was)
SELECT user_id, bit, count(stop) AS presses, round(avg(stop - tick), 4) AS mean_held FROM c WHERE down GROUP BY user_id, bit""")
def press_release(spark, d):
    w = W.partitionBy("user_id", "bit").orderBy("tick", "event_id")
    each = events(spark, d).withColumn("bit", F.explode(F.array(*map(F.lit, (1, 2, 4, 8))))).withColumn("down", F.col("k").bitwiseAND(F.col("bit")) != 0)
    turns = each.withColumn("was", F.lag("down", 1, False).over(w)).filter("down <> was").withColumn("stop", F.lead("tick").over(w))
    return turns.filter("down").groupBy("user_id", "bit").agg(F.count("stop").alias("presses"), F.round(F.avg(F.col("stop") - F.col("tick")), 4).alias("mean_held"))


def _days(spark, d):
    return events(spark, d).groupBy("user_id", "day").agg(F.min("tick").alias("start_tick"))


DAYS = "r AS (SELECT user_id, day, min(tick) AS start_tick FROM e GROUP BY 1, 2), n AS (SELECT user_id, day, start_tick, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_tick) AS INTEGER) AS number FROM r)"


@query(f"""WITH {E}, {DAYS} SELECT user_id, number, start_tick, CAST(coalesce(lead(start_tick) OVER (PARTITION BY user_id ORDER BY start_tick) - 1, {OPEN_END}) AS INTEGER) AS end_tick FROM n""")
def round_bounds_lead(spark, d):
    return t.bounds(_days(spark, d), ["user_id"], "start_tick", OPEN_END).select("user_id", "number", "start_tick", "end_tick")


@query(f"""WITH {E}, {DAYS} SELECT event_id, e.user_id, tick, CAST(coalesce((SELECT max(number) FROM n WHERE n.user_id = e.user_id AND n.start_tick <= e.tick), 0) AS INTEGER) AS number FROM e WHERE event_type = 'error'""")
def asof_round(spark, d):
    rounds = t.bounds(_days(spark, d), ["user_id"], "start_tick", OPEN_END)
    rows = events(spark, d).filter("event_type = 'error'").select("event_id", "user_id", "tick")
    return t.as_of(rows, rounds, ["user_id"], "tick", "start_tick", "number")


@query(f"""WITH {E} SELECT p.event_id, p.user_id, min(c.tick) AS first_after FROM e p JOIN e c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.tick BETWEEN p.tick AND p.tick + {3 * DAY} WHERE p.event_type = 'purchase' GROUP BY ALL""")
def first_after(spark, d):
    rows = events(spark, d)
    kills = rows.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("tick").alias("low"), (F.col("tick") + 3 * DAY).alias("high"))
    shots = rows.filter("event_type = 'click'").select("user_id", F.col("tick").alias("shot"))
    return t.within(kills, shots, ["user_id"], "low", "high", "shot", DAY).groupBy("event_id", "user_id").agg(F.min("shot").alias("first_after"))


@query(f"""WITH {E} SELECT event_id, user_id, tick FROM e p WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM e c WHERE c.user_id = p.user_id AND c.event_type = 'error' AND abs(c.tick - p.tick) <= {DAY})""")
def proximity_semi(spark, d):
    rows = events(spark, d)
    kills = rows.filter("event_type = 'purchase'").select("event_id", "user_id", "tick")
    near = t.within(kills.select("event_id", "user_id", (F.col("tick") - DAY).alias("low"), (F.col("tick") + DAY).alias("high")), rows.filter("event_type = 'error'").select("user_id", F.col("tick").alias("at")), ["user_id"], "low", "high", "at", DAY)
    return kills.join(near.select("event_id"), "event_id", "left_semi")


@query(f"""WITH {E}, n AS (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick, event_id) <= {DAY} THEN 0 ELSE 1 END AS new FROM e WHERE event_type = 'click'),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM n),
b AS (SELECT user_id, burst, min(tick) AS low, max(tick) + {DAY} AS high FROM s GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT b.user_id, b.low, arg_min(p.event_id, (p.tick, p.event_id)) AS first_event FROM b JOIN e p ON p.user_id = b.user_id AND p.event_type = 'purchase' AND p.tick BETWEEN b.low AND b.high GROUP BY 1, 2""")
def interval_first_match(spark, d):
    rows = events(spark, d)
    shots = t.sessions(rows.filter("event_type = 'click'"), ["user_id"], ["tick", "event_id"], "tick", DAY, "burst")
    groups = shots.groupBy("user_id", "burst").agg(F.min("tick").alias("low"), (F.max("tick") + DAY).alias("high"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    kills = rows.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("tick").alias("at"))
    return t.within(groups, kills, ["user_id"], "low", "high", "at", DAY).groupBy("user_id", "low").agg(F.min_by("event_id", F.struct("at", "event_id")).alias("first_event"))


@query(f"""WITH {E}, b AS (SELECT DISTINCT user_id, tick // 3600 AS hour FROM e), k AS (SELECT event_id, user_id, tick // 3600 AS hour FROM e WHERE event_type = 'purchase')
SELECT event_id, user_id, count(*) AS found FROM k JOIN b USING (user_id) WHERE b.hour IN (k.hour - 6, k.hour - 12, k.hour - 18) GROUP BY ALL""")
def offset_lookup(spark, d):
    rows = events(spark, d).withColumn("hour", F.floor(F.col("tick") / 3600))
    at = rows.filter("event_type = 'purchase'").select("event_id", "user_id", F.explode(F.array(*[F.col("hour") - o for o in (6, 12, 18)])).alias("hour"))
    return at.join(rows.select("user_id", "hour").distinct(), ["user_id", "hour"]).groupBy("event_id", "user_id").agg(F.count(F.lit(1)).alias("found"))


@query(f"""WITH {E}, c AS (SELECT user_id, count(*) AS n, count_if(k & 1 <> 0) / count(*) AS a, count_if(k & 2 <> 0) / count(*) AS b, count_if(k & 4 <> 0) / count(*) AS c FROM e WHERE event_type = 'purchase' GROUP BY 1),
p AS (SELECT user_id, n, list_reverse_sort([greatest(0.0, least(1.0, (a - .2) / .6)), greatest(0.0, least(1.0, (b - .3) / .6)), greatest(0.0, least(1.0, (c - .1) / .8))]) AS p FROM c WHERE n >= 8)
SELECT user_id, n, round(least(1.0, p[1] * 0.7 + p[2] * 0.3), 8) AS value FROM p""")
def context_rates(spark, d):
    rows = events(spark, d).filter("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("k").bitwiseAND(b) != 0).alias(f"b{b}") for b in (1, 2, 4)]).filter("n >= 8")
    rate = lambda b: F.col(f"b{b}") / F.col("n")
    parts = F.sort_array(F.array(g.clamp01((rate(1) - 0.2) / 0.6), g.clamp01((rate(2) - 0.3) / 0.6), g.clamp01((rate(4) - 0.1) / 0.8)), asc=False)
    return rows.select("user_id", "n", F.round(F.least(F.lit(1.0), parts[0] * 0.7 + parts[1] * 0.3), 8).alias("value"))


@query(f"""WITH {E} SELECT user_id, count_if(event_type = 'purchase') AS kills, count_if(event_type = 'error') AS deaths, count_if(event_type = 'click') AS shots, count_if(event_type = 'purchase' AND k % 2 = 1) AS headshots,
round(coalesce(count_if(event_type = 'purchase' AND k % 2 = 1) / nullif(count_if(event_type = 'purchase'), 0), 0), 6) AS hs_rate FROM e GROUP BY user_id""")
def conditional_counts(spark, d):
    kind = lambda x: F.col("event_type") == x
    out = events(spark, d).groupBy("user_id").agg(F.count_if(kind("purchase")).alias("kills"), F.count_if(kind("error")).alias("deaths"), F.count_if(kind("click")).alias("shots"), F.count_if(kind("purchase") & (F.col("k") % 2 == 1)).alias("headshots"))
    return out.withColumn("hs_rate", F.round(g.ratio("headshots", "kills"), 6))


@query("""SELECT event_type AS name, count(value) AS n, round(count_if(value > 0.01) / count(value), 4) AS nonzero, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.99), 4) AS p99, round(max(value), 4) AS max FROM events GROUP BY 1 HAVING count(value) >= 30""")
def signal_distribution(spark, d):
    return h.distribution(table(spark, d, "events"), "event_type", "value")


@query("""WITH c AS (SELECT quantile_cont(o_totalprice, 0.99) AS q, count(o_totalprice) AS n FROM orders)
SELECT round(q, 4) AS threshold, n, count_if(o_totalprice >= q) AS above, round(count_if(o_totalprice >= q) / n, 6) AS share FROM orders, c WHERE n >= 200 GROUP BY q, n""")
def suggest_threshold(spark, d):
    return h.suggest_threshold(table(spark, d, "orders"), "o_totalprice")


@query("""SELECT o_custkey, count(*) AS matches, round(avg(o_totalprice), 8) AS mean_score, max(o_totalprice) AS max_score FROM orders GROUP BY 1 HAVING count(*) >= 3 AND round(avg(o_totalprice), 8) >= 1000 ORDER BY mean_score DESC, o_custkey LIMIT 20""")
def top_suspects(spark, d):
    return h.top_suspects(table(spark, d, "orders"), "o_custkey", "o_totalprice", 3, 1000)


@query("""SELECT o_custkey, count(*) AS matches, round(avg(o_totalprice), 8) AS mean_score, round(max(o_totalprice), 4) AS max_score, round(greatest(0.0, 1 - (max(o_totalprice) - min(o_totalprice)) / greatest(max(o_totalprice), 1.0)), 6) AS consistency FROM orders GROUP BY 1 HAVING count(*) >= 5 AND avg(o_totalprice) >= 200000""")
def recurring(spark, d):
    return h.recurring(table(spark, d, "orders"), "o_custkey", "o_totalprice", 5, 200000)


@query("""SELECT o_custkey, count(*) AS matches, round(avg(o_totalprice), 8) AS mean_score, max(o_totalprice) AS max_score, round(median(o_totalprice), 8) AS median_score FROM orders GROUP BY 1""")
def player_history(spark, d):
    return h.player_history(table(spark, d, "orders"), "o_custkey", "o_totalprice")


@query("""WITH a AS (SELECT o_custkey, count(*) - 1 AS others FROM orders GROUP BY 1),
w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE contains(lower(o_orderpriority), 'high'))
SELECT o_custkey, o_orderkey, o_totalprice, others FROM w JOIN a USING (o_custkey) WHERE n = 1""")
def explain_best(spark, d):
    rows = table(spark, d, "orders").withColumn("when", F.struct("o_orderdate", "o_orderkey"))
    return h.explain(rows, "o_custkey", "o_totalprice", "when", "o_orderpriority", "HIGH").select("o_custkey", "o_orderkey", "o_totalprice", "others")


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(o_totalprice, 0) DESC, o_orderdate DESC, o_orderkey DESC) AS n, count(*) OVER (PARTITION BY o_custkey) - 1 AS others FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice, others FROM w WHERE n = 1""")
def explain_highest(spark, d):
    rows = table(spark, d, "orders").withColumn("when", F.struct("o_orderdate", "o_orderkey"))
    return h.explain(rows, "o_custkey", "o_totalprice", "when").select("o_custkey", "o_orderkey", "o_totalprice", "others")


@query("""WITH m AS (SELECT l_orderkey, l_suppkey, min(l_returnflag) AS team FROM lineitem GROUP BY 1, 2)
SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS together, count_if(x.team = y.team) AS same_team FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 12""")
def co_occurrence(spark, d):
    return h.co_occurrence(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_returnflag", least=12)


@query("""SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '1997-01-01')""")
def pending_recheck(spark, d):
    checked = F.col("o_orderdate").cast("timestamp_ntz")
    return h.pending(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", table(spark, d, "orders"), "o_custkey", checked, F.lit("1997-01-01").cast("timestamp_ntz"))


@query("""SELECT doc_id, n_chars, coalesce((SELECT max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) FROM labels l WHERE l.doc_id = d.doc_id), 0)::INTEGER AS label FROM documents d""")
def labeled_dataset(spark, d):
    return h.labeled(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", table(spark, d, "labels"), "doc_id", F.col("toxic") == 1)


@query("""SELECT c_custkey, c_name, coalesce(matches, 0) AS matches, mean_score, max_score FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS matches, round(avg(o_totalprice), 8) AS mean_score, max(o_totalprice) AS max_score FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY max_score DESC NULLS LAST, c_custkey""")
def watchlist_enriched(spark, d):
    watched = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return h.watch_entries(watched, "c_custkey", table(spark, d, "orders"), "o_custkey", "o_totalprice").select("c_custkey", "c_name", "matches", "mean_score", "max_score")


LABELLED = "SELECT d.doc_id % 100 AS player, n_chars / 100.0 AS score, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS label FROM documents d JOIN labels USING (doc_id)"


def _labelled(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select((F.col("doc_id") % 100).alias("player"), (F.col("n_chars") / 100.0).alias("score"), (F.col("quality") == 0).cast("int").alias("label"))


@query(f"""WITH p AS (SELECT player, max(score) AS score, max(label) AS label FROM ({LABELLED}) GROUP BY 1), x AS (SELECT *, score >= threshold AS hit, label = 1 AS bad FROM p, (VALUES (30.0::DOUBLE), (40), (50), (55), (60), (70), (80)) v(threshold)),
c AS (SELECT threshold, count_if(hit AND bad) AS tp, count_if(hit AND NOT bad) AS fp, count_if(NOT hit AND bad) AS fn, count_if(NOT hit AND NOT bad) AS tn FROM x GROUP BY 1)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce((tp + fn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS prevalence FROM c""")
def threshold_sweep(spark, d):
    return h.sweep(_labelled(spark, d), "player", "score", "label", [30.0, 40.0, 50.0, 55.0, 60.0, 70.0, 80.0])


@query(f"""WITH x AS ({LABELLED}), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rank FROM x)
SELECT count_if(label = 1) AS pos, count_if(label <> 1) AS neg, round(coalesce((sum(CASE WHEN label = 1 THEN rank END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0) / nullif(count_if(label = 1) * count_if(label <> 1), 0), 0.5), 6) AS auc FROM r""")
def auc_rank(spark, d):
    return h.auc(_labelled(spark, d), "score", "label")


@query("""SELECT (SELECT count(*) FROM orders) AS matches, (SELECT count(*) FROM lineitem) AS observations, (SELECT count(DISTINCT o_custkey) FROM orders) AS players, (SELECT count(DISTINCT doc_id) FROM labels WHERE toxic = 1) AS banned""")
def store_stats(spark, d):
    one = [table(spark, d, "orders").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("o_custkey").alias("players")), table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("observations")), table(spark, d, "labels").filter("toxic = 1").agg(F.countDistinct("doc_id").alias("banned"))]
    return one[0].crossJoin(one[1]).crossJoin(one[2]).select("matches", "observations", "players", "banned")  # one row each


@query("""WITH k AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500) SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM k) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def prune_keep_n(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    kept = h.prune(table(spark, d, "orders"), "o_orderkey", "o_orderdate", 500, items, "s_suppkey", table(spark, d, "supplier").filter("s_acctbal < 0"))
    return kept.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", F.col("s_suppkey").alias("l_suppkey"))


@query("""WITH r AS (SELECT p_partkey, p_brand, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS kind, p_retailprice, row_number() OVER (PARTITION BY p_brand, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) SELECT p_partkey, p_brand, kind, p_retailprice FROM r WHERE n = 1""")
def dedupe_richest(spark, d):
    rows = table(spark, d, "part").withColumn("kind", s.plain_name("p_type"))
    return h.richest(rows, [F.col("p_brand"), F.col("kind")], F.col("p_retailprice"), ["p_partkey"]).select("p_partkey", "p_brand", "kind", "p_retailprice")


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_name || ' ' || p_type), '{a}') THEN '{b}'" for a, b in HINTS) + " END AS hint FROM part")
def hint_match(spark, d):
    rows = table(spark, d, "part").withColumn("text", F.concat("p_name", F.lit(" "), "p_type"))
    return h.first_hint(rows, "text", HINTS, "hint").select("p_partkey", "hint")


@query(f"""WITH {E}, b AS (SELECT *, event_id % 2 AS new FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY tick DESC, new DESC, event_id DESC) AS n FROM b) SELECT user_id, event_type, tick, event_id FROM r WHERE n = 1""")
def upsert_latest(spark, d):
    rows = events(spark, d).withColumn("at", F.struct("tick", (F.col("event_id") % 2).alias("new"), "event_id"))
    old, new = rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")
    return h.upsert(old, new, ["user_id", "event_type"], "at").select("user_id", "event_type", "tick", "event_id")


SIGNALS = [("purchase", "burst"), ("click", "snap"), ("error", "recoil"), ("view", "tracking"), ("signup", "context")]


def _event_signals(spark, d):
    name = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in SIGNALS], F.lit("plugin"))
    # Sums of millionths have no order; the mean's hundredth goes to four places by whole numbers, halves up.
    millionths = F.rint(F.col("value") * 1e6).cast("long")
    got = events(spark, d).groupBy("user_id", name.alias("name")).agg(F.sum(millionths).alias("v"), F.count("value").alias("known"), F.count(F.lit(1)).alias("n"))
    parts = F.when(F.col("known") > 0, F.expr("(2 * greatest(v, 0) + known * 10000) div (known * 20000)"))
    return got.select("user_id", "name", (F.least(F.lit(10_000), parts) / 10_000).alias("value"), (F.col("n") >= 10).alias("confident"))


@query(f"""WITH {E}, s AS (SELECT user_id, CASE {" ".join(f"WHEN event_type = '{a}' THEN '{b}'" for a, b in SIGNALS)} ELSE 'plugin' END AS name, least(10000, (2 * greatest(CAST(sum(CAST(round_even(value * 1e6::DOUBLE, 0) AS BIGINT)) AS BIGINT), 0) + count(value) * 10000) // (nullif(count(value), 0) * 20000)) / 10000::DOUBLE AS value, count(*) >= 10 AS confident FROM e GROUP BY 1, 2),
w AS (SELECT *, (CASE name WHEN 'burst' THEN 0.12 WHEN 'snap' THEN 0.28 WHEN 'recoil' THEN 0.18 WHEN 'tracking' THEN 0.25 WHEN 'context' THEN 0.14 END)::DOUBLE * (CASE WHEN confident THEN 1.0 ELSE 0.35 END)::DOUBLE AS w FROM s),
a AS (SELECT user_id, coalesce(sum(w * value) / nullif(sum(w), 0), 0) AS base, sum(w) AS w, count_if(confident AND value >= 0.55) AS strong, bool_and(name = 'burst') AS weak FROM w GROUP BY 1),
r AS (SELECT *, 100 * CASE WHEN strong >= 2 THEN least(1.0, base * (1 + 0.08::DOUBLE * (strong - 1))) ELSE base END AS raised FROM a)
SELECT user_id, {scored('CASE WHEN w > 0 AND weak THEN least(raised, 60.0) ELSE raised END')} AS score FROM r""")
def score_combine(spark, d):
    return sc.score(_event_signals(spark, d), keys=("user_id",))


_NEEDS = ", ".join(f"('{sig}', {sorted(x.needs)!r})" for x in sc.DETECTORS for sig in x.gives)


@query(f"""WITH m AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN ['kills'] WHEN 1 THEN ['angles', 'kills', 'positions'] WHEN 2 THEN ['angles', 'kills', 'positions', 'shots', 'teams'] ELSE ['cursor', 'keys', 'positions'] END AS caps FROM nation),
x AS (SELECT n_nationkey, signal, list_sort(list_filter(needs, lambda n: NOT list_contains(caps, n))) AS missing FROM m, (VALUES {_NEEDS}) v(signal, needs)) SELECT n_nationkey, signal, array_to_string(missing, ',') AS missing FROM x WHERE len(missing) > 0""")
def capability_gate(spark, d):
    sets = (("kills",), ("angles", "kills", "positions"), ("angles", "kills", "positions", "shots", "teams"), ("cursor", "keys", "positions"))
    caps = F.coalesce(*[F.when(F.col("n_nationkey") % 4 == k, F.array(*map(F.lit, c))) for k, c in enumerate(sets)])
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("match_id"), caps.alias("capabilities"))
    return sc.skipped(rows).select(F.col("match_id").alias("n_nationkey"), "signal", F.array_join("missing", ",").alias("missing"))


@query("""WITH e AS (SELECT doc_id % 50 AS k, list_transform(embedding, lambda x: x::DOUBLE) AS v, doc_id FROM (SELECT vec_id AS doc_id, embedding FROM embeddings)),
a AS (SELECT doc_id, v[1] * 100 AS p1, v[2] * 500 AS y1, v[3] AS x, v[4] AS y, v[5] AS z FROM e),
b AS (SELECT *, degrees(atan2(y, x)) AS yaw, CASE WHEN x = 0 AND y = 0 AND z = 0 THEN 0.0 ELSE -degrees(atan2(z, sqrt(x * x + y * y))) END AS pitch FROM a)
SELECT doc_id AS vec_id, round(pitch, 4) AS pitch, round(yaw, 4) AS yaw, round(degrees(acos(greatest(-1.0, least(1.0, cos(radians(p1)) * cos(radians(y1)) * cos(radians(pitch)) * cos(radians(yaw)) + cos(radians(p1)) * sin(radians(y1)) * cos(radians(pitch)) * sin(radians(yaw)) + sin(radians(p1)) * sin(radians(pitch)))))), 4) AS error,
round(CASE WHEN (y1 - yaw + 180) - 360 * floor((y1 - yaw + 180) / 360) - 180 <= -180 THEN 180.0 ELSE (y1 - yaw + 180) - 360 * floor((y1 - yaw + 180) / 360) - 180 END, 4) AS turn FROM b""")
def angle_math(spark, d):
    v = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, d, "embeddings").select("vec_id", (v(0) * 100).alias("p1"), (v(1) * 500).alias("y1"), v(2).alias("x"), v(3).alias("y"), v(4).alias("z"))
    pitch, yaw = g.desired("x", "y", "z")
    return rows.withColumns({"pitch": pitch, "yaw": yaw}).select("vec_id", F.round("pitch", 4).alias("pitch"), F.round("yaw", 4).alias("yaw"), F.round(g.spherical("p1", "y1", "pitch", "yaw"), 4).alias("error"), F.round(g.angle_diff("y1", "yaw"), 4).alias("turn"))


@query("""SELECT c_custkey, CAST(('0x' || substr(sha1(c_name), 1, 14)) AS BIGINT) | (1::BIGINT << 55) AS stable_id FROM customer""")
def stable_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", s.stable_id("c_name").alias("stable_id"))


SALT = b"a salt of the export"
_pads = [bytes(k ^ b for k in SALT.ljust(64, b"\0")).hex() for b in (0x36, 0x5C)]


@query(f"""SELECT c_custkey, substr(sha256(unhex('{_pads[1]}') || unhex(sha256(unhex('{_pads[0]}') || encode(c_custkey::VARCHAR)))), 1, 20) AS pseudonym FROM customer""")
def hmac_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", s.pseudonym("c_custkey", SALT).alias("pseudonym"))


@query(f"""WITH x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'STEAM_1:' || (c_custkey % 2) || ':' || c_custkey WHEN 1 THEN '[U:1:' || c_custkey || ']' WHEN 2 THEN (c_custkey + {s.STEAM_BASE})::VARCHAR WHEN 3 THEN c_custkey::VARCHAR ELSE 'none' END AS t FROM customer)
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 2 * c_custkey + c_custkey % 2 + {s.STEAM_BASE} WHEN 4 THEN 0 ELSE c_custkey + {s.STEAM_BASE} END::BIGINT AS steamid FROM x""")
def parse_ids(spark, d):
    key = F.col("c_custkey")
    text = F.when(key % 5 == 0, F.concat(F.lit("STEAM_1:"), key % 2, F.lit(":"), key)).when(key % 5 == 1, F.concat(F.lit("[U:1:"), key, F.lit("]"))).when(key % 5 == 2, (key + s.STEAM_BASE).cast("string")).when(key % 5 == 3, key.cast("string")).otherwise("none")
    return table(spark, d, "customer").select("c_custkey", F.coalesce(s.steam64(text), F.lit(0)).alias("steamid"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", s.exact_int(s.dig("props", "k")).alias("k"))


@query(f"""WITH {E} SELECT event_id, user_id + {s.STEAM_BASE} AS attacker, 2 * event_id + 1 + {s.STEAM_BASE} AS victim, 'w' || k AS weapon, k % 2 = 1 AS headshot, 3 AS team, tick AS at, value AS x FROM e WHERE event_type = 'purchase'""")
def log_parse(spark, d):
    from .sources.server_log import LINE_TIME, kills_of

    rows = events(spark, d).filter("event_type = 'purchase'")
    stamp = F.date_format(F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("tick").cast("decimal(18,6)")), "MM/dd/yyyy - HH:mm:ss")
    line = F.concat(F.lit("L "), stamp, F.lit(': "A<1><[U:1:'), "user_id", F.lit(']><CT>" ['), "value", F.lit(' 0 0] killed "B<2><STEAM_1:1:'), "event_id", F.lit('><TERRORIST>" [500 0 0] with "w'), "k", F.lit('"'), F.when(F.col("k") % 2 == 1, " (headshot)").otherwise(""))
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.to_timestamp_ntz(F.regexp_replace(LINE_TIME("value"), " - ", " "), F.lit("MM/dd/yyyy HH:mm:ss"))).cast("int")
    return kills_of(rows.select("event_id", line.alias("value"))).withColumn("at", seconds).select("event_id", "attacker", "victim", "weapon", "headshot", F.col("attacker_team").alias("team"), "at", F.col("attacker_pos.x").alias("x"))


@query("""SELECT 'local:' || doc_id AS player, n_chars AS x FROM documents UNION ALL SELECT 'ext0:' || doc_id, quality::BIGINT FROM labels""")
def merge_union_namespaced(spark, d):
    return h.merge_sources(table(spark, d, "documents").select(F.col("doc_id").alias("player"), F.col("n_chars").alias("x")), [table(spark, d, "labels").select(F.col("doc_id").alias("player"), F.col("quality").cast("long").alias("x"))], "player")


@query("""SELECT o_orderkey, o_custkey, ('0x' || substr(md5(o_custkey || '7'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < 0.3::DOUBLE AS test FROM orders""")
def split_by_player(spark, d):
    return h.split_by(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query(f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY day, tick, event_id) AS n FROM e) SELECT user_id, event_type, tick, event_id FROM r WHERE n <= 6""")
def evidence_top_n(spark, d):
    return t.top_n(events(spark, d), ["user_id", "event_type"], [F.col(c) for c in ("day", "tick", "event_id")], 6).select("user_id", "event_type", "tick", "event_id")


@query("""WITH x AS (SELECT c_custkey, c_acctbal, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)
SELECT c_custkey, least(100, CASE WHEN c_acctbal < 0 THEN 45 ELSE 0 END + CASE WHEN c_acctbal < 1000 THEN 35 ELSE 0 END + CASE WHEN n < 5 THEN 25 WHEN n < 10 THEN 10 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 15 ELSE 0 END) AS risk FROM x""")
def risk_rules(spark, d):
    from .plans.risk import capped

    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "customer").join(n, "c_custkey", "left").fillna(0, ["n"])
    rules = [(F.col("c_acctbal") < 0, 45, "banned"), (F.col("c_acctbal") < 1000, 35, "game bans"), (F.col("n") < 5, 25, "new"), ((F.col("n") >= 5) & (F.col("n") < 10), 10, "young"), (F.col("c_custkey") % 3 == 0, 15, "private")]
    return capped(rows, rules).select("c_custkey", "risk")


@query()
def match_scores(spark, d):
    """The whole way from events to scores: detectors that the match supports, weighted, flagged, first to review first."""
    from .params import Burst, Params
    from .plans.event_stream import as_match

    p = Params(burst=Burst(window_ms=2.0 * DAY * 1000, fast_gap_ms=3.0 * DAY * 1000), tickrate=1.0)
    found = sc.analyze(as_match(events(spark, d)), p)
    return found.select("steamid", "name", "kills", "deaths", "headshots", "shots", "score", F.array_join("flags", ",").alias("flags"), F.size("evidence").alias("evidence")).orderBy(F.desc("score"), "steamid")


@query(f"""WITH {E} SELECT tick, user_id + 1 AS steamid, value AS x, k::DOUBLE AS yaw, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END AS team, event_type <> 'error' AS is_alive FROM e""")
def ingest_records(spark, d):
    """Events as JSON lines under other field names, read back by the ingest source."""
    from .sources import ingest

    rows = events(spark, d)
    body = F.struct(F.lit("tick").alias("type"), F.col("tick").alias("frame"), (F.col("user_id") + 1).cast("string").alias("player_id"), F.col("value").alias("pos_x"), F.col("k").alias("view_yaw"), F.when(F.col("k") % 2 == 0, "CT").otherwise("red").alias("side"), F.when(F.col("event_type") == "error", "0").otherwise("yes").alias("alive"))
    lines = rows.select(F.lit("m").alias("match_id"), F.col("event_id").alias("seq"), F.to_json(body).alias("value"))
    return ingest.build(ingest.json_lines(lines)).ticks.select("tick", "steamid", "x", "yaw", "team", "is_alive")


@query(f"""WITH {E} SELECT tick, user_id + 1 AS steamid, value AS x FROM e""")
def mapped_records(spark, d):
    """Events nested by user in one JSON text each, read through a mapping."""
    from .sources import ingest

    rows = events(spark, d).groupBy("user_id").agg(F.collect_list(F.struct("tick", "value")).alias("rows"))
    text = F.to_json(F.struct(F.array(F.struct((F.col("user_id") + 1).alias("who"), "rows")).alias("people")))
    spec = {"ticks": {"path": "people[].rows[]", "fields": {"tick": "tick", "x": "value", "steamid": "$parent.who"}}}
    return ingest.mapped(rows.select(F.col("user_id").cast("string").alias("match_id"), text.alias("value")), spec).ticks.select("tick", "steamid", "x")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'seven' WHEN contains(lower(p_name), 'steel') THEN 'metal' WHEN contains(lower(p_name), 'red') THEN 'colour' WHEN contains(lower(p_name), 'part') THEN 'plain' END AS key FROM part""")
def identify_names(spark, d):
    from .plans import catalog

    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 7 == 0, "7").otherwise("0").alias("app_id"))
    games = spark.range(1).select(F.lit("seven").alias("key"), F.lit(7).alias("steam_appid"))
    hints = spark.createDataFrame([(3, "part", "plain"), (1, "steel", "metal"), (2, "red", "colour")], "ordinal int, hint string, key string")
    return catalog.identify(rows, games, hints).select("p_partkey", "key")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 90 WHEN 1 THEN CASE WHEN c_custkey % 100 >= 40 THEN 35 ELSE 0 END WHEN 2 THEN 40 ELSE 0 END AS risk FROM customer""")
def platform_risk(spark, d):
    from .plans import risk

    key = F.col("c_custkey")
    kind = F.coalesce(*[F.when(key % 4 == k, n) for k, n in enumerate(("lichess", "gametools", "osu"))], F.lit("opendota"))
    body = F.when(key % 4 == 0, '{"username": "a", "tosViolation": true}').when(key % 4 == 1, F.concat(F.lit('{"headShots": "'), key % 100, F.lit('%"}'))).when(key % 4 == 2, "[]").otherwise("{}")
    return risk.platform_profiles(table(spark, d, "customer").select(kind.alias("platform"), key.alias("c_custkey"), body.alias("payload"))).select("c_custkey", "risk")


@query("""SELECT o_custkey, count(*) AS matches, count(*) FILTER (WHERE o_totalprice >= 300000) AS high FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1""")
def watch_hits(spark, d):
    watched = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), F.lit("l").alias("label"), F.lit("r").alias("reason"))
    hits = h.watch_hits(table(spark, d, "orders"), watched, "o_custkey")
    return hits.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("o_totalprice") >= 300000).alias("high"))


@query("""SELECT 'total' AS support, count(*) AS n FROM part UNION ALL SELECT CASE p_size % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'account' WHEN 2 THEN 'events' WHEN 3 THEN 'positional' ELSE 'full' END, count(*) FROM part GROUP BY 1""")
def support_counts(spark, d):
    from .plans import catalog
    from .schema import SUPPORT

    level = F.coalesce(*[F.when(F.col("p_size") % 5 == k, n) for k, n in enumerate(SUPPORT)])
    return catalog.counts(table(spark, d, "part").select(level.alias("support")))


def _live(spark, d):
    """Events as a stream over the files of the table."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("at", F.col("ts").cast("timestamp"))


def _shared(spark, name):
    """A new path in the folder that driver and executors share."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tellstone-")
    return f"{base.rstrip('/')}/{name}_{uuid.uuid4().hex}"


def _drained(stream, mode="append"):
    from .streaming import live

    return live.drain(stream, _shared(stream.sparkSession, "live"), mode)


@query("SELECT DISTINCT user_id AS steamid FROM events")
def stream_roster(spark, d):
    from .streaming import live

    return _drained(live.first_seen(_live(spark, d).select(F.col("user_id").alias("steamid"), "at"), "at", "400 days").select("steamid"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS high FROM events GROUP BY 1")
def stream_counts(spark, d):
    return _drained(_live(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 50).alias("high")), "complete")


@query()
def stream_bursts(spark, d):
    """Alerts of the stateful operator over the stream of purchases."""
    from .streaming import live

    kills = _live(spark, d).filter("event_type = 'purchase'").select(F.lit("m").alias("match_id"), F.col("user_id").alias("attacker"), F.col("at").alias("event_time"))
    return _drained(live.burst_alerts(kills, 2.0 * DAY, 3, "60 days"))


@query()
def simulated_match(spark, d):
    """All three-dimensional detectors over a synthetic match, long enough for each to be confident."""
    from .plans import simulation

    found = sc.analyze(simulation.to_matches(spark, simulation.match(7, 16, length=1920)))
    return found.select("steamid", "name", "kills", "score", F.array_join("flags", ",").alias("flags"))


@query()
def simulated_cursor(spark, d):
    from .plans import simulation

    m = simulation.cursor_match(spark, {k: simulation.frames(k, n=900) for k in ("human", "relax", "aim_assist", "replay_bot")})
    return sc.analyze(m).select("match_id", "score")


@query()
def trained_weights(spark, d):
    """Weights of two signals learned from labelled documents."""
    from .plans import learn

    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("player"), (F.col("quality") == 0).cast("int").alias("label"), g.clamp01(F.log1p("n_chars") / 12).alias("length"), g.clamp01(F.regexp_count("text", F.lit("[!*$#&%]")) / F.greatest(F.col("n_chars") * 0.1, F.lit(1.0))).alias("marks"))
    try:
        model = learn.train(rows, ["length", "marks"])
    except ValueError:  # too few labels in the smallest tables
        return spark.createDataFrame([], "name string, weight double")
    return spark.createDataFrame(sorted(model.weights.items()), "name string, weight double")


#: Columns that are counts; the SQL gives them as long integers.
COUNTS = {
    "movement_return": ("jumps", "returns"), "jump_then_stop": ("jumps", "stops"), "conditional_counts": ("kills", "deaths", "shots", "headshots"),
    "suggest_threshold": ("above",), "co_occurrence": ("same_team",), "threshold_sweep": ("tp", "fp", "fn", "tn"), "auc_rank": ("pos", "neg"),
}
for _name, _columns in COUNTS.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _columns)}) FROM ({SQL[_name]})"


from . import detector_queries, live_queries, store_queries  # noqa: E402, F401  register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
