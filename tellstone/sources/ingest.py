"""Event dumps in JSON, JSON lines and CSV, and any other JSON by a mapping."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import exact_int, number, team, truth
from ..schema import OPEN_END, Matches

#: The names that a field may have, the first that is there counts.
ALIASES = {
    "tick": ("tick", "frame", "t", "time_tick"),
    "steamid": ("steamid", "steam_id", "player_id", "playerid", "id", "uid"),
    "name": ("name", "player_name", "nick", "nickname"),
    "x": ("x", "X", "pos_x", "position_x"),
    "y": ("y", "Y", "pos_y", "position_y"),
    "z": ("z", "Z", "pos_z", "position_z"),
    "pitch": ("pitch", "view_pitch", "rot_pitch", "angle_pitch"),
    "yaw": ("yaw", "view_yaw", "rot_yaw", "angle_yaw"),
    "is_alive": ("is_alive", "alive", "living"),
    "team": ("team", "team_num", "team_number", "side"),
    "health": ("health", "hp"),
    "round": ("round", "round_num", "round_number", "total_rounds_played"),
    "attacker": ("attacker", "attacker_steamid", "killer", "attacker_id"),
    "victim": ("victim", "user_steamid", "victim_steamid", "killed", "victim_id"),
    "weapon": ("weapon", "weapon_name", "gun"),
    "headshot": ("headshot", "is_headshot", "hs"),
    "start_tick": ("start_tick", "start", "begin"),
    "end_tick": ("end_tick", "end", "finish"),
    "number": ("number", "round", "round_num", "n"),
}
#: What records call themselves.
KINDS = {"tick": "tick", "ticks": "tick", "kill": "kill", "kills": "kill", "death": "kill", "shot": "shot", "shots": "shot", "weapon_fire": "shot", "round": "round", "rounds": "round", "meta": "meta"}


#: The fields of each kind of record.
FIELDS = {
    "tick": ("tick", "steamid", "x", "y", "z", "pitch", "yaw", "is_alive", "team", "health", "round", "keys", "name"),
    "kill": ("tick", "attacker", "victim", "weapon", "headshot", "round", "noscope", "through_smoke", "penetrated"),
    "shot": ("tick", "steamid", "attacker", "weapon", "round"),
    "round": ("number", "start_tick", "end_tick"),
}


def fields(rows: DataFrame, names: tuple[str, ...], record: str = "record") -> DataFrame:
    """rows with fields of their JSON record, as text, by any of their names, in columns that begin with f_.

    A record is parsed once for all fields and names; a generator, so that no filter on a field parses it again.
    """
    keys = list(dict.fromkeys(a for name in names for a in ALIASES.get(name, (name,))))
    rows = rows.select("*", F.json_tuple(record, *keys).alias(*[f"_{i}" for i in range(len(keys))]))
    found = {f"f_{name}": F.coalesce(*[F.col(f"_{keys.index(a)}") for a in ALIASES.get(name, (name,))]) for name in names}
    return rows.withColumns(found).drop(*[f"_{i}" for i in range(len(keys))])


def build(records: DataFrame, tickrate: float = 64.0, game: str = "unknown") -> Matches:
    """Matches of records (match_id, seq, kind, record as JSON text).

    Players come from ticks and from meta records only; a later team that is
    not 0 replaces an earlier one, names stay.  What the match supports comes
    from the values that are there.  Records without the ids they need are
    passed over.  kills keep their flags and ticks their keys.
    """
    one = records.select("match_id", "seq", "kind", "record")
    of = lambda k: one.filter(F.col("kind") == k)
    parsed = lambda k: fields(of(k), FIELDS[k])
    field = lambda name: F.col(f"f_{name}")
    ticks = parsed("tick").select(
        "match_id", "seq", exact_int(field("tick")).cast("int").alias("tick"), exact_int(field("steamid")).alias("steamid"),
        *[number(field(k)).alias(k) for k in ("x", "y", "z", "pitch", "yaw")], F.coalesce(truth(field("is_alive")), F.lit(True)).alias("alive0"), field("is_alive").alias("alive_text"),
        F.coalesce(team(field("team")), F.lit(0)).alias("team"), exact_int(field("health"), 100).cast("int").alias("health"), exact_int(field("round")).cast("int").alias("round_num"), exact_int(field("keys")).cast("int").alias("keys"),
        field("name").alias("name"), (field("pitch").isNotNull() | field("yaw").isNotNull()).alias("angles"), field("x").isNotNull().alias("positions"), field("keys").isNotNull().alias("keyed"),
    ).filter("steamid <> 0").withColumn("is_alive", F.when(F.col("alive_text").isNull(), True).otherwise(F.col("alive0"))).drop("alive0", "alive_text")
    kills = parsed("kill").select(
        "match_id", "seq", exact_int(field("tick")).cast("int").alias("tick"), exact_int(field("attacker")).alias("attacker"), exact_int(field("victim")).alias("victim"), F.coalesce(field("weapon"), F.lit("")).alias("weapon"), truth(field("headshot")).alias("headshot"),
        exact_int(field("round")).cast("int").alias("round_num"), truth(field("noscope")).alias("noscope"), truth(field("through_smoke")).alias("through_smoke"), exact_int(field("penetrated")).cast("int").alias("penetrated"),
        (field("noscope").isNotNull() | field("through_smoke").isNotNull() | field("penetrated").isNotNull()).alias("flagged"),
    ).filter("attacker <> 0 and victim <> 0")
    shooter = F.coalesce(F.nullif(exact_int(field("steamid")), F.lit(0).cast("bigint")), exact_int(field("attacker")))
    shots = parsed("shot").select("match_id", "seq", exact_int(field("tick")).cast("int").alias("tick"), shooter.alias("steamid"), F.coalesce(field("weapon"), F.lit("")).alias("weapon"), exact_int(field("round")).cast("int").alias("round_num")).filter("steamid <> 0")
    place = F.row_number().over(W.partitionBy("match_id").orderBy("seq"))
    rounds = parsed("round").withColumn("_n", place).select("match_id", F.coalesce(exact_int(field("number"), 0), F.lit(0)).alias("n0"), "_n", exact_int(field("start_tick")).cast("int").alias("start_tick"), exact_int(field("end_tick"), OPEN_END).cast("int").alias("end_tick"), field("number").isNull().alias("unnumbered"))
    rounds = rounds.select("match_id", F.when(F.col("unnumbered"), F.col("_n")).otherwise(F.col("n0")).cast("int").alias("number"), "start_tick", "end_tick")
    flag = lambda k: F.get_json_object("record", f"$.{k}")
    meta = of("meta").select("match_id", "seq", F.coalesce(flag("map"), flag("map_name")).alias("map_name"), flag("game").alias("game"), flag("tickrate").try_cast("double").alias("tickrate"), F.from_json(flag("players"), "map<string,string>").alias("named"))
    named = meta.select("match_id", "seq", F.explode("named").alias("k", "name")).select("match_id", "seq", exact_int("k").alias("steamid"), "name", F.lit(0).alias("team")).filter("steamid <> 0")
    seen = named.unionByName(ticks.select("match_id", "seq", "steamid", F.coalesce("name", F.col("steamid").cast("string")).alias("name"), "team"))
    players = seen.groupBy("match_id", "steamid").agg(F.min_by("name", "seq").alias("name"), F.coalesce(F.max_by("team", F.when(F.col("team") != 0, F.col("seq"))), F.lit(0)).alias("team"))
    has = ticks.groupBy("match_id").agg(F.max("angles").alias("angles"), F.max("positions").alias("positions"), F.max("keyed").alias("keys"), (F.countDistinct(F.when(F.col("team") != 0, F.col("team"))) >= 2).alias("teams"))
    for side, name in ((kills.groupBy("match_id").agg(F.lit(True).alias("kills"), F.max("flagged").alias("kill_flags")), "kills"), (shots.groupBy("match_id").agg(F.lit(True).alias("shots")), "shots")):
        has = has.join(side, "match_id", "full")
    caps = F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("angles", "keys", "kill_flags", "kills", "positions", "shots", "teams")]))
    told = meta.groupBy("match_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("map_name", "game", "tickrate")])
    matches = one.select("match_id").distinct().join(has, "match_id", "left").join(told, "match_id", "left")
    matches = matches.select("match_id", F.col("match_id").alias("source"), F.coalesce("map_name", F.lit("unknown")).alias("map_name"), F.coalesce("game", F.lit(game)).alias("game"), F.coalesce(F.nullif("tickrate", F.lit(0.0)), F.lit(float(tickrate))).alias("tickrate"), caps.alias("capabilities"))
    kept = ["match_id", "seq", "tick", "steamid", "x", "y", "z", "pitch", "yaw", "is_alive", "team", "health", "round_num", "keys"]
    return Matches(ticks.select(*kept), kills.drop("flagged"), shots, rounds, players, matches)


def json_lines(lines: DataFrame) -> DataFrame:
    """Records of lines (match_id, seq, value); empty lines and those from # on are passed over, others must be JSON of a known kind."""
    # Out of a generator, so that a filter on what a record says doesn't compute its text again.
    rows = lines.select("*", F.explode(F.array(F.trim("value"))).alias("record")).filter((F.col("record") != "") & ~F.col("record").startswith("#"))
    known = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    said = F.lower(F.coalesce(F.get_json_object("record", "$.type"), F.get_json_object("record", "$.kind"), F.lit("tick")))
    bad = F.get_json_object("record", "$").isNull()
    kind = F.when(bad, F.raise_error(F.concat(F.lit("not JSON: "), F.substring("record", 1, 80)))).otherwise(F.coalesce(F.try_element_at(known, said), F.raise_error(F.concat(F.lit("unknown record type: "), said))))
    return rows.select("match_id", "seq", kind.cast("string").alias("kind"), "record")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("match_id"), "value")


def json_objects(files: DataFrame) -> DataFrame:
    """Records of files (match_id, value), each an object of lists."""
    rows = files.filter(F.coalesce(F.get_json_object("value", "$").startswith("{"), F.raise_error(F.lit("a file isn't a JSON object")).cast("boolean")))
    out = rows.filter(F.get_json_object("value", "$.meta").isNotNull()).select("match_id", F.lit(-1).cast("long").alias("seq"), F.lit("meta").alias("kind"), F.get_json_object("value", "$.meta").alias("record"))
    for k, name in enumerate(("ticks", "kills", "shots", "rounds")):
        each = rows.select("match_id", F.posexplode(F.from_json(F.get_json_object("value", f"$.{name}"), "array<string>")).alias("seq", "record"))
        out = out.unionByName(each.select("match_id", (F.col("seq") + k * (1 << 40)).alias("seq"), F.lit(KINDS[name]).alias("kind"), "record"))
    return out


def load(spark: SparkSession, path: str, tickrate: float = 64.0, game: str = "unknown") -> Matches:
    """Matches of .json, .jsonl, .ndjson or .csv files, by the extension of path."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    name = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("match_id")
    if suffix == "json":
        records = json_objects(_whole(spark, path))
    elif suffix in ("jsonl", "ndjson"):
        records = json_lines(spark.read.text(path).select(name, F.monotonically_increasing_id().alias("seq"), "value"))
    elif suffix == "csv":
        rows = spark.read.option("header", True).csv(path)
        records = rows.select(name, F.monotonically_increasing_id().alias("seq"), F.lit("tick").alias("kind"), F.to_json(F.struct(*rows.columns)).alias("record"))
    else:
        raise ValueError(f"unknown extension: {suffix}; use .json, .jsonl or .csv")
    return build(records, tickrate, game)


def mapped(files: DataFrame, spec: dict, tickrate: float = 64.0) -> Matches:
    """Matches of any JSON files (match_id, value) by a spec.

    For each kind of record the spec has a path (a.b goes down, a[] goes
    through a list) and fields: a path in the node, $parent.path in what held
    it, or $const:value.
    """
    meta = spec.get("meta") or {}
    out = files.select("match_id", F.lit(-1).cast("long").alias("seq"), F.lit("meta").alias("kind"), F.lit(json.dumps(meta)).alias("record"))
    for k, name in enumerate(("ticks", "kills", "shots", "rounds")):
        rule = spec.get(name)
        if not rule:
            continue
        fields = rule.get("fields") or {}
        if not fields:
            raise ValueError(f"the rule {name} has no fields")
        rows = files.select("match_id", F.col("value").alias("node"), F.lit(None).cast("string").alias("parent"), F.array().cast("array<int>").alias("at"))
        for part in [p for p in rule.get("path", "").split(".") if p]:
            key = part.removesuffix("[]")
            value = F.get_json_object("node", f"$.{key}") if key else F.col("node")
            if part.endswith("[]"):
                rows = rows.select("match_id", F.col("node").alias("parent"), "at", F.posexplode(F.from_json(value, "array<string>")).alias("i", "item"))
                rows = rows.select("match_id", F.col("item").alias("node"), "parent", F.concat("at", F.array("i")).alias("at"))
            else:
                rows = rows.select("match_id", value.alias("next"), F.col("node").alias("parent"), "at").filter("next is not null").select("match_id", F.col("next").alias("node"), "parent", "at")

        def resolve(source) -> Column:
            if not isinstance(source, str):
                return F.lit(json.dumps(source))
            if source.startswith("$const:"):
                return F.lit(source.removeprefix("$const:"))
            where, path = ("parent", source.removeprefix("$parent.")) if source.startswith("$parent.") else ("node", source)
            steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
            return F.get_json_object(where, f"${steps}")

        record = F.to_json(F.struct(*[resolve(v).alias(target) for target, v in fields.items()]))
        order = F.row_number().over(W.partitionBy("match_id").orderBy("at")).cast("long") + F.lit(k * (1 << 40))
        out = out.unionByName(rows.select("match_id", order.alias("seq"), F.lit(KINDS[name]).alias("kind"), record.alias("record")))
    return build(out, tickrate, str(meta.get("game", "unknown")))


def load_mapped(spark: SparkSession, path: str, spec: dict, tickrate: float = 64.0) -> Matches:
    return mapped(_whole(spark, path), spec, tickrate)


def write_lines(m: Matches, path: str) -> None:
    """All tables as JSON lines that load() reads back, in one folder for each match."""
    rows = m.matches.select("match_id", F.lit(0).alias("o"), F.lit(0).cast("long").alias("seq"), F.to_json(F.struct(F.lit("meta").alias("type"), "game", F.col("map_name").alias("map"), "tickrate")).alias("value"))
    names = m.players.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("steamid").cast("string"), "name"))).alias("players"))
    rows = rows.unionByName(names.select("match_id", F.lit(0).alias("o"), F.lit(1).cast("long").alias("seq"), F.to_json(F.struct(F.lit("meta").alias("type"), "players")).alias("value")))
    for k, (kind, df) in enumerate((("round", m.rounds.withColumn("seq", F.col("start_tick").cast("long"))), ("tick", m.ticks), ("shot", m.shots), ("kill", m.kills)), 1):
        body = [c for c in df.columns if c not in ("match_id", "seq")]
        rows = rows.unionByName(df.select("match_id", F.lit(k).alias("o"), "seq", F.to_json(F.struct(F.lit(kind).alias("type"), *body)).alias("value")))
    rows.repartition("match_id").sortWithinPartitions("match_id", "o", "seq").select("match_id", "value").write.partitionBy("match_id").text(path)
