"""Detectors written by users, run for each player of each match."""
from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params
from ..schema import SIGNALS, Matches
from .score import Detector

PLAIN = "match_id string, steamid long, name string, value double, samples long, confident boolean, error string"
FOUND = pa.schema([("match_id", pa.string()), ("steamid", pa.int64()), ("name", pa.string()), ("value", pa.float64()), ("samples", pa.int64()), ("confident", pa.bool_()), ("error", pa.string())])
#: Whole numbers stay whole beside nulls: ids have more digits than a float.
WHOLE = {pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}
#: What a plugin can ask for.
TABLES = ("ticks", "kills", "shots", "rounds")


def _beside(m: Matches, tables: tuple[str, ...]) -> DataFrame:
    """match_id, steamid, table and a column with the row, named like its table, for all rows that concern a player.

    Ticks and shots are the player's own, kills those that a player of the
    roster made or suffered, rounds all of the match.
    """
    roster = m.players.select("match_id", "steamid").distinct()
    sides = F.explode(F.filter(F.array_distinct(F.array("attacker", "victim")), lambda x: x.isNotNull())).alias("steamid")
    rows = {
        "ticks": lambda: m.ticks.select("match_id", "steamid", F.struct("*").alias("ticks")),
        "shots": lambda: m.shots.select("match_id", "steamid", F.struct("*").alias("shots")),
        "kills": lambda: m.kills.select("match_id", sides, F.struct("*").alias("kills")).join(roster, ["match_id", "steamid"], "left_semi"),
        "rounds": lambda: m.rounds.select("match_id", F.struct("*").alias("rounds")).join(roster, "match_id"),
    }
    each = [rows[t]().withColumn("table", F.lit(t)) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


def register(name: str, requires: set[str], produces: tuple[str, ...], analyze: Callable[..., dict], tables: tuple[str, ...] = ()) -> Detector:
    """A detector from a function of what concerns a player in one match.

    analyze gets the player's ticks, in order, or, if tables are named (of
    ticks, kills, shots and rounds), a frame for each by its name, and the
    parameters; whole numbers are nullable integers.  It returns for each signal (value, samples, confident).  If it
    fails or returns something else, the player gets a signal
    plugin_<name>_error of value 0 instead.
    """
    if not callable(analyze) or not produces:
        raise ValueError("a plugin needs analyze and what it produces")
    if unknown := set(tables) - set(TABLES):
        raise ValueError(f"there are no tables {sorted(unknown)}")
    wanted = tuple(tables) or ("ticks",)

    def plan(m: Matches, p: Params) -> DataFrame:
        def call(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            match_id, steamid = (k.as_py() for k in key)
            try:
                frames = {}
                for t in wanted:
                    mine = rows.filter(pc.equal(rows["table"], t)).column(t).combine_chunks()
                    frame = pa.Table.from_struct_array(mine).to_pandas(types_mapper=WHOLE.get)
                    frames[t] = frame.sort_values("number" if t == "rounds" else "seq", ignore_index=True)
                found = analyze(frames if tables else frames["ticks"], p)
                out = [(match_id, steamid, k, float(v[0]), int(v[1]), bool(v[2]), None) for k, v in found.items() if k in produces]
            except Exception as e:  # noqa: BLE001  whatever a user's code raises
                out = [(match_id, steamid, f"plugin_{name}_error", 0.0, 0, False, f"{type(e).__name__}: {e}")]
            return pa.Table.from_pylist([dict(zip(FOUND.names, r, strict=True)) for r in out], FOUND)

        found = _beside(m, wanted).groupBy("match_id", "steamid").applyInArrow(call, PLAIN)
        evidence = SIGNALS.split("evidence ")[1]
        note = F.struct(F.lit("error").alias("kind"), F.lit(0).alias("round"), F.lit(0).alias("tick"), F.col("error").alias("detail"), F.lit("").alias("target"))
        return found.select("match_id", "steamid", "name", "value", "samples", "confident", F.create_map().cast("map<string,double>").alias("raw"), F.when(F.col("error").isNotNull(), F.array(note)).otherwise(F.array()).cast(evidence).alias("evidence"))

    return Detector(name, tuple(sorted(requires)), (*produces, f"plugin_{name}_error"), plan)


def discover(folder: str) -> Iterator[tuple[str, Detector | str]]:
    """The plugins in a folder's *.py files, or why one can't be loaded; names that start with _ are passed over."""
    for path in sorted(Path(folder).glob("*.py")):
        if path.name.startswith("_"):
            continue
        try:
            spec = importlib.util.spec_from_file_location(f"plugin_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            yield path.stem, register(path.stem, set(module.REQUIRES), tuple(module.PRODUCES), module.analyze, tuple(getattr(module, "TABLES", ())))
        except Exception as e:  # noqa: BLE001
            yield path.stem, f"can't be loaded: {e}"
