"""Questions over many matches: distributions, suspects, recurrence, labels, pruning.

Observations have a player, a match, a score and a time; columns are named by
arguments, so that the operators serve any table of that form.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import ratio
from ..operators.hints import first_hint as hint_of
from ..store import Store
from .ledger import newest


def distribution(values: DataFrame, name: str, value: str, least: int = 30, floor: float = 0.01) -> DataFrame:
    """n, share above floor, percentiles and maximum of each name with at least least values."""
    out = values.groupBy(F.col(name).alias("name")).agg(F.count(value).alias("n"), (F.count_if(F.col(value) > floor) / F.count(value)).alias("nonzero"), F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("p"), F.max(value).alias("max"))
    return out.filter(F.col("n") >= least).select("name", "n", F.round("nonzero", 4).alias("nonzero"), *[F.round(F.col("p")[i], 4).alias(k) for i, k in enumerate(("p50", "p90", "p99"))], F.round("max", 4).alias("max"))


def signal_distribution(observations: DataFrame, least: int = 30) -> DataFrame:
    """distribution() of every signal in the map column signals."""
    return distribution(observations.select(F.explode("signals").alias("name", "s")).select("name", F.col("s.value").alias("value")), "name", "value", least)


def suggest_threshold(observations: DataFrame, score: str, percentile: float = 0.99, least: int = 200) -> DataFrame:
    """The percentile of the score and how many observations reach it; nothing below least of them."""
    cut = observations.agg(F.percentile(score, F.lit(percentile)).alias("threshold"), F.count(score).alias("n")).filter(F.col("n") >= least)
    both = observations.crossJoin(F.broadcast(cut))  # one row
    return both.groupBy("threshold", "n").agg(F.count_if(F.col(score) >= F.col("threshold")).alias("above")).select(F.round("threshold", 4).alias("threshold"), "n", "above", F.round(F.col("above") / F.col("n"), 6).alias("share"))


def top_suspects(observations: DataFrame, player: str, score: str, least_matches: int = 1, least_mean: float = 0.0, limit: int = 20) -> DataFrame:
    """Players by mean score, then by id."""
    out = observations.groupBy(player).agg(F.count(F.lit(1)).alias("matches"), F.round(F.avg(score), 8).alias("mean_score"), F.max(score).alias("max_score"))
    return out.filter((F.col("matches") >= least_matches) & (F.col("mean_score") >= least_mean)).orderBy(F.desc("mean_score"), player).limit(limit)  # a top-k report


def recurring(observations: DataFrame, player: str, score: str, least_matches: int = 3, least_mean: float = 35.0) -> DataFrame:
    """Players seen often with a high mean, and how steady their scores are."""
    out = observations.groupBy(player).agg(F.count(F.lit(1)).alias("matches"), F.avg(score).alias("_mean"), F.max(score).alias("_max"), F.min(score).alias("_min"))
    steady = F.greatest(F.lit(0.0), 1 - (F.col("_max") - F.col("_min")) / F.greatest(F.col("_max"), F.lit(1.0)))
    return out.filter((F.col("matches") >= least_matches) & (F.col("_mean") >= least_mean)).select(player, "matches", F.round("_mean", 8).alias("mean_score"), F.round("_max", 4).alias("max_score"), F.round(steady, 6).alias("consistency"))


def player_history(observations: DataFrame, player: str, score: str) -> DataFrame:
    """Number, mean, maximum and median of the scores of each player."""
    return observations.groupBy(player).agg(F.count(F.lit(1)).alias("matches"), F.round(F.avg(score), 8).alias("mean_score"), F.max(score).alias("max_score"), F.round(F.median(score), 8).alias("median_score"))


def ban_rollup(checks: DataFrame) -> DataFrame:
    """The worst each player was found with."""
    return checks.groupBy("steamid").agg(F.max("vac_banned").alias("vac_banned"), F.max("game_bans").alias("game_bans"), F.min("days_since_ban").alias("days_since_ban"))


def co_occurrence(members: DataFrame, match: str, player: str, team: str, score: str | None = None, least: int = 3, salts: int = 8) -> DataFrame:
    """Pairs of players seen together in at least least matches, and how often on one team.

    Each match's roster is joined with itself, a pair once.  Rosters are small
    by nature; the join is salted by the first player, so that a match with
    many rows is spread over tasks.
    """
    one = members.groupBy(match, player).agg(F.min(team).alias("team"), *([F.max(score).alias("score")] if score else []))
    mean = one.groupBy(player).agg(F.avg("score").alias("mean")) if score else None
    a = one.select(match, F.col(player).alias("a"), F.col("team").alias("team_a"), F.pmod(F.xxhash64(player), F.lit(salts)).alias("_salt"))
    b = one.select(match, F.col(player).alias("b"), F.col("team").alias("team_b")).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    pairs = a.join(b, [match, "_salt"]).filter("a < b")
    same = (F.col("team_a") == F.col("team_b")) & ~F.col("team_a").cast("string").isin("0", "")
    out = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"), F.count_if(same).alias("same_team")).filter(F.col("together") >= least)
    if score:
        for side in ("a", "b"):
            out = out.join(mean.select(F.col(player).alias(side), F.col("mean").alias(f"mean_{side}")), side)
        out = out.withColumn("pair_mean", F.round((F.col("mean_a") + F.col("mean_b")) / 2, 4)).withColumns({f"mean_{k}": F.round(f"mean_{k}", 4) for k in ("a", "b")})
    return out


def explain(observations: DataFrame, player: str, score: str, time: str, source: str | None = None, contains: str = "") -> DataFrame:
    """One observation of each player, and the number of all the player's others.

    It is the one with the highest score, the latest of equal ones; or, with
    contains, the latest whose source contains that in lower case.  Players
    without such an observation have no row.
    """
    best = F.struct(F.coalesce(score, F.lit(0)), time)
    if source and contains:
        best = F.when(F.lower(source).contains(contains.lower()), F.struct(time))
    row = F.struct(*[F.col(f"`{c}`") for c in observations.columns if c != player])
    found = observations.groupBy(player).agg(F.max_by(row, best).alias("_row"), (F.count(F.lit(1)) - 1).alias("others"), F.max(best.isNotNull()).alias("_any"))
    return found.filter("_any").select(*[F.col(player) if c == player else F.col(f"_row.`{c}`").alias(c) for c in observations.columns], "others")


def pending(players: DataFrame, key: str, checks: DataFrame, check_key: str, checked_at: Column, since: Column) -> DataFrame:
    """Players without a check since then."""
    return players.join(checks.filter(checked_at >= since).select(F.col(check_key).alias(key)), key, "left_anti")


def due(players: DataFrame, key: str, first_seen: str, checks: DataFrame, check_key: str, checked_at: Column, now: Column, min_age: int = 30, cooldown: int = 7, limit: int = 500, chunk: int = 100) -> DataFrame:
    """The players to look up next, the longest known first, and the number of the request that each goes into.

    They were first seen min_age days ago or earlier and not checked in the
    last cooldown days; times are in seconds.  A request takes chunk players.
    """
    old = players.filter(F.col(first_seen) <= now - min_age * 86400)
    waiting = pending(old, key, checks, check_key, checked_at, now - cooldown * 86400).orderBy(first_seen, key).limit(limit)  # a list for one run
    place = F.row_number().over(W.orderBy(first_seen, key)) - 1
    return waiting.withColumn("request", F.floor(place / chunk))


def pairs_report(pairs: DataFrame, least_mean: float = 0.0, limit: int = 50) -> DataFrame:
    """Pairs of co_occurrence() whose players both have at least that mean, the highest mean of the pair first, then the most matches."""
    high = pairs.filter(F.least("mean_a", "mean_b") >= least_mean)
    return high.orderBy(F.desc("pair_mean"), F.desc("together"), "a", "b").limit(limit)  # a top-k report


def calibrate(values: DataFrame, name: str, value: str, observations: DataFrame, score: str, percentile: float = 0.99, least: int = 30, high: float = 0.25) -> DataFrame:
    """distribution() of each signal and of the score (named score), with what to see to.

    high tells signals whose median is over that: what fires for most players
    says more of the data than of them.  The score's row has the threshold
    that suggest_threshold() finds and how many observations reach it.
    """
    signals = distribution(values, name, value, least).withColumn("high", F.col("p50") > high)
    scored = distribution(observations.select(F.lit("score").alias("name"), F.col(score).alias("value")), "name", "value", 1).withColumn("high", F.lit(False))
    cut = suggest_threshold(observations, score, percentile).select("threshold", "above")
    both = signals.withColumns({"threshold": F.lit(None).cast("double"), "above": F.lit(None).cast("long")})
    return both.unionByName(scored.join(F.broadcast(cut), how="left"))  # one row each


def watch_entries(watched: DataFrame, key: str, observations: DataFrame, player: str, score: str) -> DataFrame:
    """The watched with what was seen of them, those never seen last."""
    seen = observations.groupBy(F.col(player).alias(key)).agg(F.count(F.lit(1)).alias("matches"), F.round(F.avg(score), 8).alias("mean_score"), F.max(score).alias("max_score"))
    out = watched.join(seen, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.orderBy(F.desc_nulls_last("max_score"), key)


def watch_hits(report: DataFrame, watched: DataFrame, key: str = "steamid") -> DataFrame:
    """Rows of a report whose player is watched."""
    return report.join(watched.select(key, "label", "reason"), key)


def auto_watch(report: DataFrame, watched: DataFrame, threshold: float, key: str = "steamid") -> DataFrame:
    """Players to be watched from now on: high scores, not from small samples, not watched yet."""
    high = report.filter((F.col("score") >= threshold) & ~F.array_contains("flags", "small_sample"))
    return high.join(watched.select(key), key, "left_anti")


def by_player(observations: DataFrame, player: str, score: str, label: str) -> DataFrame:
    return observations.groupBy(player).agg(F.max(score).alias("score"), F.max(label).alias("label"), F.count(F.lit(1)).alias("matches"))


def sweep(observations: DataFrame, player: str, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """For each threshold the confusion matrix, precision, recall and prevalence, counted by player, in one pass."""
    each = by_player(observations, player, score, label).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit, bad = F.col("score") >= F.col("threshold"), F.col("label") == 1
    out = each.groupBy("threshold").agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.select("*", F.round(ratio("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(ratio("tp", F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(ratio(F.col("tp") + F.col("fn"), total), 6).alias("prevalence"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Share of concordant pairs, ties counting half, from sums by score.

    Rows are first summed by distinct score, in parts of a thousandth of the
    range, so that no window holds all rows.
    """
    sums = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    spread = sums.agg(F.min("s").alias("low"), F.max("s").alias("high"))
    part = F.coalesce(F.floor(F.try_divide(1000.0 * (F.col("s") - F.col("low")), F.col("high") - F.col("low"))), F.lit(0))
    sums = sums.crossJoin(F.broadcast(spread)).withColumn("part", part)  # one row
    parts = sums.groupBy("part").agg(F.sum("neg").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = W.partitionBy("part").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    ranked = sums.withColumn("inside", F.coalesce(F.sum("neg").over(inner), F.lit(0))).join(F.broadcast(parts.select("part", "before")), "part")  # 1001 rows at most
    out = ranked.agg(F.sum(F.col("pos") * (F.col("before") + F.col("inside") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return out.select("pos", "neg", F.round(F.coalesce(F.try_divide("u", F.col("pos") * F.col("neg")), F.lit(0.5)), 6).alias("auc"))


def prune(matches: DataFrame, match: str, time: str, keep: int, observations: DataFrame, player: str, protected: DataFrame) -> DataFrame:
    """Observations that stay when matches beyond the keep newest go, but for protected players."""
    newest = matches.orderBy(F.desc(time), F.desc(match)).limit(keep).select(match)  # the size of the store
    kept = observations.join(newest, match, "left_semi")
    saved = observations.join(newest, match, "left_anti").join(protected.select(player), player, "left_semi")
    return kept.unionByName(saved)


def prune_plan(observations: DataFrame, matches: DataFrame, watched: DataFrame, keep: int) -> dict[str, DataFrame]:
    """observations and matches that stay, and one row of counts, when matches beyond the keep newest go.

    Observations of watched players (steamid) stay, and so do matches that
    still have observations.  matches has match_id and analyzed_at.  The
    history of bans isn't touched.
    """
    gone = matches.join(newest(matches, "analyzed_at", "match_id", keep).select("match_id"), "match_id", "left_anti").select("match_id")
    lost = observations.join(gone, "match_id", "left_semi").join(watched.select("steamid"), "steamid", "left_anti").select("match_id", "steamid")
    left = observations.join(gone, "match_id", "left_anti").unionByName(observations.join(gone, "match_id", "left_semi").join(watched.select("steamid"), "steamid", "left_semi"))
    matches_left = matches.join(gone.join(left.select("match_id"), "match_id", "left_anti"), "match_id", "left_anti")
    one = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))  # noqa: E731  one row each
    counts = one(matches, "matches").crossJoin(one(matches_left, "matches_left")).crossJoin(one(lost, "observations_removed")).crossJoin(watched.agg(F.countDistinct("steamid").alias("protected")))
    counts = counts.select("matches", (F.col("matches") - F.col("matches_left")).alias("matches_removed"), "observations_removed", "protected")
    return {"observations": left, "matches": matches_left, "counts": counts}


def prune_store(store: Store, keep: int = 500, dry_run: bool = True) -> DataFrame:
    """What a store of observations, matches, checks and watched loses, in one row; without dry_run it loses it, in a new version."""
    version = store.versions()[-1]
    tables = {n: store.read(n, version) for n in ("observations", "matches", "checks", "watched")}
    plan = prune_plan(tables["observations"], tables["matches"], tables["watched"], keep)
    if not dry_run:
        store.write(tables | {n: plan[n] for n in ("observations", "matches")}, after=version)
    return plan["counts"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The latest row of each key of both, rows of new before equal ones of old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(time), F.desc("_new")))).filter("_n = 1").drop("_n", "_new")


def save_observations(new: DataFrame, path: str, parts: int = 256) -> None:
    """Write observations; matches that are there already are replaced.

    Rows are kept in parts by a hash of the match, however many matches there
    are.  Parts that have none of the new matches aren't touched; the others
    are written anew, first beside the table, so that a job that dies before
    has changed nothing.
    """
    spark, part = new.sparkSession, F.pmod(F.xxhash64("match_id"), F.lit(parts)).cast("int")
    new = new.withColumn("part", part)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        new.write.partitionBy("part").parquet(path)
        return
    touched = [r[0] for r in new.select("part").distinct().collect()]  # 256 numbers
    old = spark.read.parquet(path).filter(F.col("part").isin(touched))
    beside = f"{path.rstrip('/')}_new"
    old.join(new.select("match_id").distinct(), "match_id", "left_anti").unionByName(new, allowMissingColumns=True).write.mode("overwrite").parquet(beside)
    spark.read.parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def save_checks(found: DataFrame, path: str) -> None:
    """Add checks of players (as in schema.BAN_CHECKS) to those that are there; a player has as many as were made."""
    found.write.mode("append").parquet(path)


def players_of(observations: DataFrame, time: str = "analyzed_at") -> DataFrame:
    """The player dimension, counted anew from the observations."""
    return observations.groupBy("steamid").agg(F.max_by("name", time).alias("last_name"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.countDistinct("match_id").alias("matches_seen"))


def labeled(observations: DataFrame, player: str, checks: DataFrame, check_key: str, banned: Column) -> DataFrame:
    """observations with label 1 if any check of the player found a ban, at any time, else 0."""
    found = checks.groupBy(F.col(check_key).alias("_k")).agg(F.max(banned.cast("int")).alias("_l"))
    return observations.join(found, observations[player] == found["_k"], "left").withColumn("label", F.coalesce("_l", F.lit(0))).drop("_k", "_l")


def recheck(known: DataFrame, found: DataFrame, key: str = "steamid") -> DataFrame:
    """Players banned in found: new is true for those that known has no ban of."""
    bans = lambda d: d.filter("vac_banned > 0 or game_bans > 0 or community_ban > 0").select(key).distinct()
    return bans(found).join(bans(known).withColumn("_old", F.lit(True)), key, "left").select(key, F.col("_old").isNull().alias("new"))


def split_by(rows: DataFrame, player: str, share: float = 0.3, seed: str = "7") -> DataFrame:
    """rows with test: all rows of a player on one side, by a hash of the player."""
    place = F.conv(F.substring(F.md5(F.concat(F.col(player).cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("test", place < share)


def merge_sources(local: DataFrame, others: list[DataFrame], player: str) -> DataFrame:
    """Union of rows from here and elsewhere; players get the name of where they come from."""
    out = local.withColumn(player, F.concat(F.lit("local:"), F.col(player).cast("string")))
    for k, other in enumerate(others):
        out = out.unionByName(other.withColumn(player, F.concat(F.lit(f"ext{k}:"), F.col(player).cast("string"))))
    return out


def richest(rows: DataFrame, keys: list[Column], richness: Column, order: list) -> DataFrame:
    """One row for each key: the richest, the first of equal ones."""
    named = rows.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    w = W.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(richness.desc(), *order)
    return named.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", *[f"_k{i}" for i in range(len(keys))])


def first_hint(rows: DataFrame, text: str, hints: list[tuple[str, str]], key: str) -> DataFrame:
    """rows with the key of the first hint in the list that its text contains, in lower case."""
    table = rows.sparkSession.createDataFrame([(i, h, k) for i, (h, k) in enumerate(hints)], "ordinal int, hint string, key string")
    return hint_of(rows, text, table, key)
