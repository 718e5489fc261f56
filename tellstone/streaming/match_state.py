"""Live matches: one stateful pass over a stream of log lines keeps the roster, the rounds and the kills of each match."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from statistics import median, stdev

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.scalar import steam64
from ..params import Params
from ..schema import OPEN_END, Matches
from ..sources.server_log import LINE_TIME, ROUND, kill_parts
from .live import STATUS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINES = "match_id string, seq long, tag string, at long, attacker long, attacker_name string, attacker_team int, victim long, victim_name string, victim_team int, weapon string, headshot boolean"
#: joined: a new player. named: a name of one that had none. round: a round with its end. burst: an alert.
RECORDS = "match_id string, seq long, kind string, steamid long, name string, number int, tick int, end_tick int, size int, value double"
CLOCK, ENDED = "base long, rounds int, start int", "number int, start_tick int, end_tick int"
GROUPS = "match_id string, number int, steamids array<long>, names array<string>"


def tagged(lines: DataFrame) -> DataFrame:
    """lines (match_id, seq, value) with the tag of each and what it says: round, kill or status; others have no tag.

    One pass for all sinks.  Kills whose players have no id, and status lines
    of such, have no tag either.  at is in seconds, from the line's own stamp.
    """
    at = F.unix_timestamp(F.try_to_timestamp(F.nullif(LINE_TIME("value"), F.lit("")), F.lit("MM/dd/yyyy - HH:mm:ss")))
    kill = kill_parts("value")
    who = steam64(F.regexp_extract("value", STATUS, 2))
    is_round, is_kill = F.col("value").rlike(ROUND) & at.isNotNull(), kill["attacker"].isNotNull() & kill["victim"].isNotNull() & at.isNotNull()
    tag = F.when(is_round, "round").when(is_kill, "kill").when(F.col("value").rlike(STATUS) & who.isNotNull(), "status")
    out = lines.select("match_id", "seq", tag.alias("tag"), at.alias("at"), who.alias("_who"), F.regexp_extract("value", STATUS, 1).alias("_name"), *[v.alias(k) for k, v in kill.items()])
    status = F.col("tag") == "status"
    return out.withColumns({"attacker": F.when(status, F.col("_who")).otherwise(F.col("attacker")), "attacker_name": F.trim(F.when(status, F.col("_name")).otherwise(F.col("attacker_name"))), "victim_name": F.trim("victim_name")}).select(*[f.split(" ")[0] for f in LINES.split(", ")])


def thinned(lines: DataFrame, whole: tuple[str, ...]) -> DataFrame:
    """Tagged lines: all with a tag of whole, and of others the first of each match and tag in each batch of a task's rows.

    Of lines that say nothing a state needs to know only that there are some,
    and of kills a clock needs the first; so these don't all meet in the task
    of their match.
    """

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = pc.sort_indices(batch, sort_keys=[("seq", "ascending")])
            rows = pa.table({"match_id": batch.column("match_id").take(order), "tag": batch.column("tag").take(order), "row": order})
            first = rows.group_by(["match_id", "tag"], use_threads=False).aggregate([("row", "first")])["row_first"]
            keep = np.zeros(len(batch), bool)
            keep[first.to_numpy()] = True
            yield batch.filter(pc.or_(pc.is_in(batch.column("tag"), value_set=pa.array(whole)), pa.array(keep)))

    return lines.mapInArrow(thin, lines.schema)


def roster_rows(found: DataFrame) -> DataFrame:
    """Rows (match_id, seq, steamid, name) of another feed, such as game states, in the form of tagged()."""
    null = F.lit(None)
    return found.select("match_id", "seq", F.lit("status").alias("tag"), null.cast("long").alias("at"), F.col("steamid").alias("attacker"), F.col("name").alias("attacker_name"), null.cast("int").alias("attacker_team"), null.cast("long").alias("victim"), null.cast("string").alias("victim_name"), null.cast("int").alias("victim_team"), null.cast("string").alias("weapon"), null.cast("boolean").alias("headshot"))


def _ramp(x: float, low: float, high: float) -> float:
    return min(1.0, max(0.0, (x - low) / (high - low)))


def pace(kills: list[tuple[int, int]], p: Params) -> tuple[float, list[tuple[int, int, int]]]:
    """The burst signal of a player's kills (round, tick), and all its groups as round, first tick and size.

    As plans.signals.burst computes it for whole matches.
    """
    c, window = p.burst, p.ticks(p.burst.window_ms)
    if len(kills) < c.min_kills:
        return 0.0, []
    groups, gaps, rounds = [], [], 0
    for number, mine in groupby(sorted(kills), key=lambda k: k[0]):
        ticks, first = [t for _, t in mine], 0
        rounds += 1
        gaps += [(b - a) / p.tickrate * 1000 for a, b in zip(ticks, ticks[1:], strict=False)]
        for i, t in enumerate(ticks):
            while t - ticks[first] > window:
                first += 1
            if i - first + 1 >= c.min_burst_kills and (i + 1 == len(ticks) or ticks[i + 1] - ticks[first] > window):
                groups.append((number, ticks[first], i - first + 1))
    even = 0.0
    if len(gaps) >= c.min_gap_samples and (middle := median(gaps)) <= c.fast_gap_ms:
        even = _ramp(stdev(gaps) / middle if middle and len(gaps) > 1 else 0.0 if middle else 1.0, 0.55, 0.15)
    return max(_ramp(len(groups) / rounds, 0.08, 0.45), 0.7 * even), groups


def _record(match_id: str, **values) -> Row:
    return Row(**({c.split(" ")[0]: None for c in RECORDS.split(", ")} | {"match_id": match_id} | values))


class LiveRounds(StatefulProcessor):
    """The rounds of a match, as LiveMatch keeps them, without its kills and players."""

    def __init__(self, tickrate: float, idle: int):
        self.tickrate, self.idle = tickrate, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK)
        self.rounds = handle.getListState("rounds", ENDED)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle)
        base, number, start = self.clock.get() if self.clock.exists() else (None, 0, None)
        ended = []
        for line in sorted((r for r in rows if r.tag in ("round", "kill")), key=lambda r: r.seq):
            base = line.at if base is None else base
            if line.tag == "round":
                tick = int((line.at - base) * self.tickrate)
                if start is not None:
                    ended.append((number, start, tick - 1))
                    yield _record(key[0], seq=line.seq, kind="round", number=number, tick=start, end_tick=tick - 1)
                number, start = number + 1, tick
        if ended:
            self.rounds.appendList(ended)
        if base is not None:
            self.clock.update((base, number, start))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        _, number, start = self.clock.get() if self.clock.exists() else (None, 0, None)
        self.clock.clear()
        self.rounds.clear()
        if start is not None:
            yield _record(key[0], kind="round", number=number, tick=start, end_tick=OPEN_END)

    def close(self) -> None:
        pass


class LiveMatch(StatefulProcessor):
    """The state of a match, and what a batch of its lines adds to it.

    Lines are taken in their order of arrival, seq.  A tick counts from the
    first kill or round that was seen, whatever its time; a round ends one
    tick before the next begins, and a kill is of the round that had begun when
    it came.  After each second of the log, the signal of
    those who killed in it is computed from all their kills so far; a player
    whose latest group of kills wasn't reported yet gives an alert if the
    signal is at least least.  A match without lines for idle seconds gives
    its open round and is forgotten.
    """

    def __init__(self, p: Params, least: float, idle: int):
        self.p, self.least, self.idle = p, least, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK)
        self.rounds = handle.getListState("rounds", ENDED)
        self.kills = handle.getListState("kills", "seq long, tick int, attacker long, victim long, weapon string, headshot boolean, round_num int")
        self.players = handle.getMapState("players", "steamid long", "name string, team int")
        self.roster = handle.getMapState("roster", "steamid long", "name string")
        self.reported = handle.getMapState("reported", "steamid long, tick int", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle)
        lines = sorted((r for r in rows if r.tag), key=lambda r: r.seq)
        base, number, start = self.clock.get() if self.clock.exists() else (None, 0, None)
        by_attacker: dict[int, list[tuple[int, int]]] = {}
        for _, tick, attacker, victim, _, _, in_round in self.kills.get() if self.kills.exists() else ():
            if attacker != victim:
                by_attacker.setdefault(attacker, []).append((in_round, tick))
        new_kills, ended, hot, out = [], [], {}, []

        def record(line: Row, kind: str, **values) -> None:
            out.append(_record(key[0], seq=line.seq, kind=kind, **values))

        # Each player is looked up once a batch and written once, however many lines name it.
        roster: dict[int, tuple[str] | None] = {}
        players: dict[int, tuple[str, int]] = {}
        fresh, told = set(), set()

        def seen(line: Row, steamid: int, name: str) -> None:
            if steamid not in roster:
                roster[steamid] = self.roster.getValue((steamid,))
            known = roster[steamid]
            if known is None or (name and not known[0]):
                roster[steamid] = (name or "",)
                fresh.add(steamid)
                record(line, "joined" if known is None else "named", steamid=steamid, name=name or "")

        def check() -> None:
            for steamid, line in hot.items():
                value, groups = pace(by_attacker[steamid], self.p)
                if value < self.least or not groups or (place := (steamid, groups[-1][1])) in told:
                    continue
                told.add(place)
                if not self.reported.containsKey(place):
                    self.reported.updateValue(place, (line.seq,))
                    record(line, "burst", steamid=steamid, name=roster[steamid][0], number=groups[-1][0], tick=groups[-1][1], size=groups[-1][2], value=value)
            hot.clear()

        second = None
        for line in lines:
            if line.tag == "status":
                seen(line, line.attacker, line.attacker_name)
                continue
            if line.at != second:
                check()
            second = line.at
            base = second if base is None else base
            tick = int((second - base) * self.p.tickrate)
            if line.tag == "round":
                if start is not None:
                    ended.append((number, start, tick - 1))
                    record(line, "round", number=number, tick=start, end_tick=tick - 1)
                number, start = number + 1, tick
                continue
            for steamid, name, team in ((line.attacker, line.attacker_name, line.attacker_team), (line.victim, line.victim_name, line.victim_team)):
                had = players.get(steamid) or self.players.getValue((steamid,))
                players[steamid] = (name or "", team or (had[1] if had else 0))
                seen(line, steamid, name)
            new_kills.append((line.seq, tick, line.attacker, line.victim, line.weapon, line.headshot, number))
            if line.attacker != line.victim:
                by_attacker.setdefault(line.attacker, []).append((number, tick))
                hot[line.attacker] = line
        check()
        for steamid in sorted(fresh):
            self.roster.updateValue((steamid,), roster[steamid])
        for steamid, player in sorted(players.items()):
            self.players.updateValue((steamid,), player)
        if new_kills:
            self.kills.appendList(new_kills)
        if ended:
            self.rounds.appendList(ended)
        if base is not None:
            self.clock.update((base, number, start))
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        base, number, start = self.clock.get() if self.clock.exists() else (None, 0, None)
        for state in (self.clock, self.rounds, self.kills, self.players, self.roster, self.reported):
            state.clear()
        if start is not None:
            yield _record(key[0], kind="round", number=number, tick=start, end_tick=OPEN_END)

    def close(self) -> None:
        pass


def _provider(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def live_matches(lines: DataFrame, p: Params | None = None, least: float = 0.6, idle: int = 6 * 3600) -> DataFrame:
    """RECORDS of a stream of tagged() lines, for one foreachBatch to deal to its sinks.

    A match is kept in one state, as its lines are written by one server; what
    is kept grows with its kills and players only.  Sets the session's state
    store to the one that this needs, before the stream is started.
    """
    _provider(lines.sparkSession)
    return thinned(lines, ("round", "kill", "status")).groupBy("match_id").transformWithState(LiveMatch(p or Params(), least, idle), RECORDS, "append", "ProcessingTime")


def live_rounds(lines: DataFrame, p: Params | None = None, idle: int = 6 * 3600) -> DataFrame:
    """Those RECORDS of live_matches() that are rounds, for who wants no more: kills and players take no part in them.

    A match's task gets its rounds and the first of its kills, from which ticks count.
    """
    _provider(lines.sparkSession)
    few = thinned(lines.select("match_id", "seq", "tag", "at"), ("round",))
    return few.groupBy("match_id").transformWithState(LiveRounds((p or Params()).tickrate, idle), RECORDS, "append", "ProcessingTime")


class NewPlayers(StatefulProcessor):
    """Players of a match that weren't seen before, in groups of size, or what there is after wait seconds."""

    def __init__(self, size: int, wait: float):
        self.size, self.wait = size, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "steamid long", "name string")
        self.waiting = handle.getListState("waiting", "steamid long, name string")
        self.count = handle.getValueState("count", "number int")

    def _flush(self, key: tuple, rows: list[tuple]) -> Row:
        number = self.count.get()[0] + 1 if self.count.exists() else 1
        self.count.update((number,))
        return Row(match_id=key[0], number=number, steamids=[r[0] for r in rows], names=[r[1] for r in rows])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        began = bool(waiting)
        for r in sorted(rows, key=lambda r: r.seq):
            if not self.seen.containsKey((r.steamid,)):
                self.seen.updateValue((r.steamid,), (r.name,))
                waiting.append((r.steamid, r.name))
                if len(waiting) == self.size:
                    yield self._flush(key, waiting)
                    waiting, began = [], False
        self.waiting.clear()
        if not waiting or not began:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if waiting:
            self.waiting.put(waiting)
            if not began:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.wait))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.waiting.exists():
            rows = [tuple(r) for r in self.waiting.get()]
            self.waiting.clear()
            yield self._flush(key, rows)

    def close(self) -> None:
        pass


def new_players(found: DataFrame, size: int = 10, wait: float = 2.0) -> DataFrame:
    """GROUPS of players of a stream (match_id, seq, steamid, name): each player of a match once.

    A group is given when it has size players, or wait seconds after its first.
    """
    _provider(found.sparkSession)
    return found.select("match_id", "seq", "steamid", "name").groupBy("match_id").transformWithState(NewPlayers(size, wait), GROUPS, "append", "ProcessingTime")


def risk_alerts(records: DataFrame, risks: DataFrame, least: float = 40.0) -> DataFrame:
    """match_id, seq, kind, steamid, name and detail: one alert for each joined player whose risk is high or couldn't be found.

    records are those of live_matches(), as a stream or a batch; risks has
    steamid, name, risk, reasons array<string> and error, one row a player.  A
    player joins a match once, so it is looked up once.  A player without a
    row has no alert.  A risk is shown as a whole number, a half as the even one.
    """
    joined = records.filter("kind = 'joined'").select("match_id", "seq", "steamid", F.col("name").alias("_name"))
    found = joined.join(risks.select("steamid", F.col("name").alias("_own"), "risk", "reasons", "error"), "steamid")
    kind = F.when(F.col("error").isNotNull(), "risk_error").when(F.col("risk") >= least, "risk")
    detail = F.when(F.col("error").isNotNull(), F.concat(F.lit("lookup failed: "), F.col("error"))).otherwise(F.concat(F.lit("risk "), F.rint("risk").cast("long"), F.lit(" - "), F.array_join("reasons", ", ")))
    return found.withColumn("kind", kind).filter("kind is not null").select("match_id", "seq", "kind", "steamid", F.coalesce(F.nullif("_own", F.lit("")), "_name").alias("name"), detail.alias("detail"))


def alert_lines(alerts: DataFrame, at: Column) -> DataFrame:
    """alerts (kind, steamid, name, detail) as lines: the time of day, the kind, who it is about, and the detail."""
    who = F.coalesce(F.nullif("name", F.lit("")), F.col("steamid").cast("string"))
    return alerts.select(F.concat(F.lit("["), F.date_format(at, "HH:mm:ss"), F.lit("] "), F.rpad("kind", F.greatest(F.lit(12), F.length("kind")), F.lit(" ")), F.lit(" "), who, F.lit(": "), "detail").alias("value"))


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def rounds_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rounds, with the open one, that a stream of live_matches() or live_rounds() knows."""
    match = F.col("key.match_id").alias("match_id")
    clock = _state(spark, checkpoint, "clock").select(match, "value.*").filter("start is not null")
    ended = _state(spark, checkpoint, "rounds").select(match, "list_element.*")
    return ended.unionByName(clock.select("match_id", F.col("rounds").alias("number"), F.col("start").alias("start_tick"), F.lit(OPEN_END).alias("end_tick")))


def snapshot(spark: SparkSession, checkpoint: str, p: Params | None = None, game: str = "") -> Matches:
    """The matches that a stream of live_matches() knows, read from its checkpoint while it runs or after it.

    Gives what was committed last: kills, rounds with the open one, and the
    players of kills.  plans.score.analyze() of it is the report so far.
    """
    p = p or Params()
    match = F.col("key.match_id").alias("match_id")
    kills = _state(spark, checkpoint, "kills").select(match, "list_element.*")
    kills = kills.select("match_id", "seq", "tick", "attacker", "victim", "weapon", "headshot", "round_num", F.lit(False).alias("noscope"), F.lit(False).alias("through_smoke"), F.lit(0).alias("penetrated"))
    clock, rounds = _state(spark, checkpoint, "clock").select(match, "value.*"), rounds_of(spark, checkpoint)
    players = _state(spark, checkpoint, "players").select(match, F.col("user_map_key.steamid").alias("steamid"), F.col("user_map_value.name").alias("name"), F.col("user_map_value.team").alias("team"))
    matches = clock.select("match_id", F.lit("live").alias("source"), F.lit("").alias("map_name"), F.lit(game).alias("game"), F.lit(float(p.tickrate)).alias("tickrate"), F.array(F.lit("kills"), F.lit("teams")).alias("capabilities"))
    empty = Matches.empty(spark)
    return Matches(empty.ticks, kills, empty.shots, rounds, players, matches)


def summary(m: Matches) -> DataFrame:
    """match_id and how many players, kills and rounds a snapshot has of it."""
    out = m.matches.select("match_id")
    for name, rows in (("players", m.players), ("kills", m.kills), ("rounds", m.rounds)):
        out = out.join(rows.groupBy("match_id").agg(F.count(F.lit(1)).alias(name)), "match_id", "left")
    return out.fillna(0)


def to_sinks(sinks: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that gives each sink the batch's records of its kind, computed once for all.

    A sink is called with the number of the batch, by which it can tell a batch that comes again.
    """

    def deal(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for kind, sink in sinks.items():
                sink(batch.filter(F.col("kind") == kind), number)
        finally:
            batch.unpersist()

    return deal
