"""How long the aims of some players follow some enemies: one tile of signals.tracking, in numpy.

It is pickled by value, so executors need no installed copy.
"""
from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from .. import params
from ..params import Tracking

for _module in (sys.modules[__name__], params):
    cloudpickle.register_pickle_by_value(_module)

FOUND = "match_id string, steamid long, episodes long, locked long, items array<struct<rn:int,round:int,start:int,travel:double,span:int,d:double,target:string>>"
ITEM = pa.struct([("rn", pa.int32()), ("round", pa.int32()), ("start", pa.int32()), ("travel", pa.float64()), ("span", pa.int32()), ("d", pa.float64()), ("target", pa.string())])
SCHEMA = pa.schema([("match_id", pa.string()), ("steamid", pa.int64()), ("episodes", pa.int64()), ("locked", pa.int64()), ("items", pa.list_(ITEM))])
#: Pairs of an aim and an enemy that are held at once, that are computed at once, and below which ticks are taken together.
HELD, BLOCK, FEW = 1 << 23, 1 << 16, 1 << 8


def vector(pitch: np.ndarray, yaw: np.ndarray) -> tuple[np.ndarray, ...]:
    """As geometry.vector()."""
    p, y = np.radians(pitch), np.radians(yaw)
    return np.cos(p) * np.cos(y), np.cos(p) * np.sin(y), -np.sin(p)


def towards(dx: np.ndarray, dy: np.ndarray, dz: np.ndarray) -> tuple[np.ndarray, ...]:
    """The vector of geometry.desired()."""
    flat = np.hypot(dx, dy)
    return vector(np.where((flat == 0) & (dz == 0), 0.0, -np.degrees(np.arctan2(dz, flat))), np.degrees(np.arctan2(dy, dx)))


def between(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """As geometry.spherical(), of vectors; no number counts as the greatest, as in Spark."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return np.rint(np.degrees(np.arccos(np.where(np.isnan(dot), 1.0, np.clip(dot, -1.0, 1.0)))) * 1e9) / 1e9


def distance(dx: np.ndarray, dy: np.ndarray, dz: np.ndarray) -> np.ndarray:
    return np.sqrt(dx * dx + dy * dy + dz * dz)


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


class _Tile:
    """Players with their aims in the order they were read, and enemies with their places by tick."""

    def __init__(self, mine: pa.Table, his: pa.Table, c: Tracking):
        self.c = c
        self.ids, self.names = mine.column("steamid").to_numpy(), his.column("enemy_name").to_pylist()
        self.enemies, n = his.column("enemy").to_numpy(), len(his)
        length = mine.column("tick").combine_chunks().value_lengths().to_numpy()
        self.bounds = np.concatenate([[0], np.cumsum(length)])
        self.who = np.repeat(np.arange(len(mine)), length)
        self.rn, self.tick, self.rounds = _flat(mine, "rn"), _flat(mine, "tick"), mine.column("round").combine_chunks().flatten()
        self.at = np.stack([_flat(mine, k) for k in ("x", "y", "z")])
        self.look = np.stack(vector(_flat(mine, "pitch"), _flat(mine, "yaw")))
        new = (np.diff(self.rn, prepend=0) != 1) | (np.diff(self.tick.astype(np.int64), prepend=0) > 2)
        new[self.bounds[:-1][length > 0]] = True
        self.linked = ~new
        self.near = np.zeros(len(self.who), bool)
        for k, acts in enumerate(mine.column("acts").to_pylist()):
            if acts:
                t, acts = self.tick[self.bounds[k] : self.bounds[k + 1]].astype(np.int64), np.sort(np.array(acts, np.int64))
                self.near[self.bounds[k] : self.bounds[k + 1]] = np.searchsorted(acts, t - c.ignore_window_ticks, "left") < np.searchsorted(acts, t + c.ignore_window_ticks, "right")
        # Enemies' places by tick, then enemy.
        tick = _flat(his, "tick")
        enemy = np.repeat(np.arange(n), his.column("tick").combine_chunks().value_lengths().to_numpy())
        order = np.lexsort((enemy, tick))
        self.enemy, self.place = enemy[order], np.stack([_flat(his, k)[order] for k in ("x", "y", "z")])
        self.ticks, first = np.unique(tick[order], return_index=True)
        self.first = np.append(first, len(order))
        self.when = np.searchsorted(self.ticks, self.tick)
        self.when[self.when == len(self.ticks)] = 0
        self.when[self.ticks[self.when] != self.tick] = -1
        self.keys = np.repeat(np.arange(len(self.ticks)), np.diff(self.first)) * n + self.enemy
        self.scale = max(np.abs(x[np.isfinite(x)]).max(initial=1.0) for x in (self.at, self.place))
        self.odd = ~np.isfinite(np.vstack([self.at, self.look])).all(0)
        self.odd_places = np.add.reduceat(~np.isfinite(self.place).all(0), first, dtype=np.int64)
        # Products of these are how far an enemy is ahead, and the square of its distance.
        one = lambda x: np.ones((1, x.shape[1]))
        self.ahead = np.vstack([self.look, -(self.look * self.at).sum(0)]).T.copy(), np.vstack([self.place, one(self.place)])
        self.square = np.vstack([-2 * self.at, (self.at**2).sum(0), one(self.at)]).T.copy(), np.vstack([self.place, one(self.place), (self.place**2).sum(0)])

    def offset(self, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(self.place[k, place] - self.at[k, row] for k in range(3))

    def locks(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which aims are on enemies that are far enough, as the columns' formulas say."""
        off = self.offset(row, place)
        look = tuple(x[row] for x in self.look)
        return ~(distance(*off) < self.c.min_distance) & (between(look, towards(*off)) <= self.c.lock_deg)

    def aimed(self, low: int, high: int) -> np.ndarray:
        """For each row from low to high and each enemy, whether the aim is on it."""
        out = np.zeros((high - low, len(self.enemies)), bool)
        rows = low + np.flatnonzero(self.when[low:high] >= 0)
        rows = rows[np.argsort(self.when[rows], kind="stable")]
        here, begin = np.unique(self.when[rows], return_index=True)
        end = np.append(begin[1:], len(rows))
        there = self.first[here + 1] - self.first[here]
        # Ticks with few pairs are taken together, and so are those where a place or an aim is no number.
        odd = np.add.reduceat(self.odd[rows], begin) > 0 if len(rows) else np.zeros(0, bool)
        few = ((end - begin) * there < FEW) | odd | (self.odd_places[here] > 0)
        some = np.repeat(few, end - begin)
        row, count = rows[some], np.repeat(there, end - begin)[some]
        for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(np.cumsum(count) // BLOCK)) + 1):
            many = count[part]
            place = np.repeat(self.first[self.when[row[part]]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            each = np.repeat(row[part], many)
            out[each - low, self.enemy[place]] = self.locks(each, place)
        for k in np.flatnonzero(~few):
            self._tick(out, low, rows[begin[k] : end[k]], self.first[here[k]], self.first[here[k] + 1])
        same = np.isin(self.enemies, self.ids)
        for e in np.flatnonzero(same):
            out[self.ids[self.who[low:high]] == self.enemies[e], e] = False
        return out

    def _tick(self, out: np.ndarray, low: int, rows: np.ndarray, first: int, last: int) -> None:
        """aimed() at a tick: products of matrices tell nearly all pairs; what is close to a limit goes by the formulas."""
        enemy = self.enemy[first:last]
        cos, least = np.cos(np.radians(min(180.0, max(0.0, self.c.lock_deg)))), max(0.0, self.c.min_distance) ** 2
        slack, close = 1e-9 * self.scale, 1e-12 * self.scale**2
        sure = max(least + close, 1e-6 * self.scale**2)
        size = max(1, BLOCK // (last - first))
        for i in range(0, len(rows), size):
            mine = rows[i : i + size]
            ahead = self.ahead[0][mine] @ self.ahead[1][:, first:last]
            square = self.square[0][mine] @ self.square[1][:, first:last]
            yes, on = square >= sure, square >= least - close
            if least <= close:
                np.maximum(square, 0.0, out=square)
            np.sqrt(square, out=square)
            square *= cos
            ahead -= square
            yes &= ahead >= slack
            on &= ahead >= -slack
            on ^= yes
            if on.any():
                x, y = np.nonzero(on)
                yes[x, y] = self.locks(mine[x], first + y)
            if len(enemy) == out.shape[1]:
                out[mine - low] = yes
            else:
                out[(mine - low)[:, None], enemy] = yes

    def runs(self, low: int, high: int) -> tuple[np.ndarray, ...]:
        """Rows and enemies of locks that follow another or are followed, run by run, and where runs begin."""
        on, linked = self.aimed(low, high), self.linked[low:high]
        after = on[:-1] & on[1:] & linked[1:, None]
        on[:] = False
        on[1:] = after
        on[:-1] |= after
        at, n = np.flatnonzero(on), on.shape[1]
        row = at // n
        enemy = at - row * n
        pair = self.who[low + row] * n + enemy
        order = np.argsort(pair, kind="stable")
        row, enemy, pair = low + row[order], enemy[order], pair[order]
        new = np.ones(len(row), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1] + 1) | ~self.linked[row[1:]]
        return row, enemy, new

    def followed(self, low: int, high: int) -> tuple[np.ndarray, ...]:
        """Rows, enemies, starts, ways and spans of the episodes, and the locked ticks by player."""
        c = self.c
        row, enemy, new = self.runs(low, high)
        # An episode begins at a row that has no act near and isn't its run's last; other runs need no angles.
        able = ~self.near[row]
        able[:-1] &= ~new[1:]
        able[-1:] = False
        keep = np.zeros(0, bool)
        if len(row):
            at = np.flatnonzero(new)
            keep = np.repeat(np.logical_or.reduceat(able, at), np.diff(np.append(at, len(row))))
        row, enemy, new = row[keep], enemy[keep], new[keep]
        place = np.searchsorted(self.keys, self.when[row] * len(self.enemies) + enemy)
        to = towards(*self.offset(row, place))
        way = np.zeros(len(row))
        way[1:] = between(tuple(x[:-1] for x in to), tuple(x[1:] for x in to))
        way[new] = 0.0
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(row)))
        if len(at):  # a run whose target doesn't move enough on the whole has no episode
            moved = ~(np.add.reduceat(way, at) < c.min_target_travel_deg - 1e-6)
            at, length = at[moved], length[moved]
        tick = self.tick.astype(np.int64)
        start, near, travel, on = tick[row[at]], self.near[row[at]], np.zeros(len(at)), np.ones(len(at), bool)
        found, locked = [], np.zeros(len(self.ids), np.int64)
        k = 0
        while len(at):
            k += 1
            left = length > k
            at, length, start, near, travel, on = (x[left] for x in (at, length, start, near, travel, on))
            i = at + k
            travel = np.where(on, travel + way[i], 0.0)
            start, near = np.where(on, start, tick[row[i]]), np.where(on, near, self.near[row[i]])
            span = tick[row[i]] - start + 1
            ripe = on & (span >= c.min_lock_ticks) & (travel >= c.min_target_travel_deg)
            on = ~(ripe & near)
            done = ripe & ~near
            if done.any():  # counted once; each later row of the run is one more
                np.add.at(locked, self.who[row[i[done]]], span[done] + length[done] - k - 1)
                found.append((i[done], start[done], travel[done], span[done]))
                at, length, start, near, travel, on = (x[~done] for x in (at, length, start, near, travel, on))
        i, start, travel, span = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        return row[i], enemy[i], place[i], start, travel, span, locked

    def found(self, match_id: str, shown: int) -> pa.Table:
        names = np.array(self.names, object)
        rank = np.unique(names, return_inverse=True)[1]
        tables, k = [], 0
        while k < len(self.ids):
            # Players whose aims and enemies are held at once, one at least.
            end = max(k + 1, int(np.searchsorted(self.bounds, self.bounds[k] + HELD // max(1, len(names)), "right")) - 1)
            row, enemy, place, start, travel, span, locked = self.followed(self.bounds[k], self.bounds[end])
            k = end
            who = self.who[row]
            episodes = np.bincount(who, minlength=len(self.ids))
            order = np.lexsort((start, rank[enemy], self.rn[row], who))
            row, enemy, place, start, travel, span, who = (x[order] for x in (row, enemy, place, start, travel, span, who))
            players, begin = np.unique(who, return_index=True)
            # The first of each player, and those that are equal to the last of these.
            last = np.minimum(begin + shown, np.append(begin[1:], len(who))) - 1
            last = np.repeat(last, np.diff(np.append(begin, len(who))))
            keep = (np.arange(len(who)) <= last) | ((self.rn[row] == self.rn[row[last]]) & (rank[enemy] == rank[enemy[last]]) & (start == start[last]))
            row, enemy, place, start, travel, span = (x[keep] for x in (row, enemy, place, start, travel, span))
            items = pa.StructArray.from_arrays([
                pa.array(self.rn[row], pa.int32()), self.rounds.take(pa.array(row)), pa.array(start, pa.int32()), pa.array(travel, pa.float64()),
                pa.array(span, pa.int32()), pa.array(distance(*self.offset(row, place)), pa.float64()), pa.array(names[enemy], pa.string()),
            ], fields=list(ITEM))
            offsets = np.append(0, np.cumsum(np.bincount(who[keep], minlength=len(self.ids))[players]))
            tables.append(pa.table([pa.array([match_id] * len(players), pa.string()), pa.array(self.ids[players]), pa.array(episodes[players], pa.int64()), pa.array(locked[players]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)], schema=SCHEMA))
        return pa.concat_tables(tables) if tables else SCHEMA.empty_table()


def follow(c: Tracking, shown: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of two sides of a tile that gives FOUND: for each player with episodes their number, the locked ticks and the first items.

    mine has a row a player: steamid, and arrays of its aims in the order they
    were read (rn, tick, round, x, y, z, pitch, yaw) and of the ticks of its
    acts.  his has a row an enemy: enemy, enemy_name, and arrays of its places
    (tick, x, y, z).  Nothing is null but rounds and acts.
    """

    def tile(mine: pa.Table, his: pa.Table) -> pa.Table:
        if not len(mine) or not len(his):
            return SCHEMA.empty_table()
        with np.errstate(all="ignore"):
            return _Tile(mine, his, c).found(mine.column("match_id")[0].as_py(), shown)

    return tile
