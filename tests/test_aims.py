import math
import random
from collections import defaultdict

import pytest

from tellstone.params import Params, Tracking
from tellstone.plans import aims, signals
from tellstone.schema import Matches

P = Params(tracking=Tracking(lock_deg=70, min_distance=200, min_lock_ticks=2, ignore_window_ticks=1, min_target_travel_deg=25), tickrate=4.0)


def random_match(seed, players=12, ticks=80):
    """Ticks with gaps, repeats, a player without a team, dead players and unknown places, in and out of order."""
    rng, rows, acts = random.Random(seed), [], []
    teams = {s: (2, 3, 4, 2, 3, 0)[s % 6] for s in range(1, players + 1)}
    for s in teams:
        x, y, yaw, seq, read = rng.uniform(0, 2000), rng.uniform(0, 2000), rng.uniform(-180, 180), 0, []
        for t in range(1, ticks + 1):
            x, y, yaw = x + rng.uniform(-300, 300), y + rng.uniform(-300, 300), yaw + rng.uniform(-40, 40)
            for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 1, 1, 1, 2])):
                read.append((t, None if rng.random() < 0.02 else x, y, rng.uniform(0, 50), rng.uniform(-30, 30), yaw, rng.random() < 0.95))
        if s % 4 == 0:
            read[10], read[11] = read[11], read[10]
        for r in read:
            seq += 1
            rows.append((s, seq, *r, r[0] // 20 + 1))
        acts += [(s, t) for t in rng.sample(range(1, ticks + 1), 4)]
    return teams, rows, acts


def brute(teams, rows, acts, c):
    """Episodes, locked ticks and the first eight (rn, name, start) of each player, pair by pair."""
    last = {}
    for s, seq, t, x, y, z, _, _, alive, _ in rows:
        last[s, t] = (x, y, z, alive)
    turn = lambda p, y: (math.cos(math.radians(p)) * math.cos(math.radians(y)), math.cos(math.radians(p)) * math.sin(math.radians(y)), -math.sin(math.radians(p)))
    angle = lambda a, b: math.degrees(math.acos(max(-1.0, min(1.0, sum(i * j for i, j in zip(a, b, strict=True))))))
    got = defaultdict(lambda: [0, 0, []])
    for s, own in teams.items():
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        for e, other in teams.items():
            if other in (0, own):
                continue
            before = None
            for rn, (_, _, t, x, y, z, pitch, yaw, alive, number) in enumerate(mine, 1):
                there = last.get((e, t))
                if not alive or x is None or there is None or not there[3] or there[0] is None:
                    continue
                d = [there[k] - (x, y, z)[k] for k in range(3)]
                flat = math.hypot(d[0], d[1])
                to = turn(-math.degrees(math.atan2(d[2], flat)), math.degrees(math.atan2(d[1], d[0])))
                if math.dist(d, (0, 0, 0)) < c.min_distance or angle(turn(pitch, yaw), to) > c.lock_deg:
                    continue
                if before is None or rn - before[0] != 1 or t - before[1] > 2:
                    on, counted = False, False
                if not on:
                    on, start, travel, ripe = True, t, 0.0, False
                else:
                    travel += angle(before[2], to)
                    ripe = not counted and t - start + 1 >= c.min_lock_ticks and travel >= c.min_target_travel_deg
                    got[s][1] += counted
                if ripe and any(a == s and abs(k - start) <= c.ignore_window_ticks for a, k in acts):
                    on = False
                elif ripe:
                    counted = True
                    got[s][0] += 1
                    got[s][1] += t - start + 1
                    got[s][2].append((rn, f"p{e}", start, number))
                before = (rn, t, to)
    return {s: (n, locked, [(at, name, number) for _, name, at, number in sorted(items)[:8]]) for s, (n, locked, items) in got.items()}


def tables(spark, teams, rows, acts):
    m = Matches.empty(spark)
    ticks = [("m", seq, t, s, x, y, z, pitch, yaw, alive, teams[s], 100, number, 0) for s, seq, t, x, y, z, pitch, yaw, alive, number in rows]
    m.ticks = spark.createDataFrame(ticks, m.ticks.schema)
    m.shots = spark.createDataFrame([("m", k, t, s, "", 1) for k, (s, t) in enumerate(acts)], m.shots.schema)
    m.players = spark.createDataFrame([("m", s, f"p{s}", team) for s, team in teams.items()], m.players.schema)
    return m


@pytest.mark.parametrize("side, held, block, few", [(1 << 19, 1 << 22, 1 << 16, 1 << 8), (1 << 19, 1 << 22, 16, 0), (90, 1, 1 << 16, 0), (2, 400, 8, 4)])
def test_tracking_pair_by_pair(spark, monkeypatch, side, held, block, few):
    for name, value in (("HELD", held), ("BLOCK", block), ("FEW", few)):
        monkeypatch.setattr(aims, name, value)
    monkeypatch.setattr(signals, "SIDE", side)
    teams, rows, acts = random_match(side + few)
    want = brute(teams, rows, acts, P.tracking)
    found = signals.tracking(tables(spark, teams, rows, acts), P).filter("name = 'tracking'").collect()
    got = {r.steamid: (r.raw["episodes"], r.raw["locked_ticks"], [(e["tick"], e["target"], e["round"]) for e in r.evidence]) for r in found}
    assert got == {s: want.get(s, (0, 0, [])) for s in teams} and sum(w[0] for w in want.values()) > 60


def test_pairs_are_not_shuffled(spark):
    """No pair of an aim and an enemy leaves the task that finds it: no window, join or aggregate is over pairs."""
    plan = signals.tracking(Matches.empty(spark), P).filter("name = 'tracking'")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [x for x in plan if "CoGroup" in x] and not [x for x in plan if "steamid" in x and "enemy#" in x and any(k in x for k in ("Window", "Join", "Aggregate"))]
