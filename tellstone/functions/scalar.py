"""Lenient parsing, ids and hashes as Column expressions."""
from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 64-bit id of account number 0.
STEAM_BASE = 76561197960265728


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x, default: float = 0.0) -> Column:
    return F.coalesce(_c(x).try_cast("double"), F.lit(default))


def exact_int(x, default: int = 0) -> Column:
    """An integer that never passes through a double if it is written as one."""
    text = F.trim(_c(x).cast("string"))
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def truth(x) -> Column:
    """1, true, t, yes, y and sim, in any case."""
    return F.coalesce(F.lower(F.trim(_c(x).cast("string"))).isin("1", "true", "t", "yes", "sim"), F.lit(False))


def team(x) -> Column:
    """3 for the names of one side, 2 for those of the other, a number as it is, else 0."""
    name = F.upper(F.trim(_c(x).cast("string")))
    return F.when(name.isin("CT", "BLUE", "3", "ATTACK"), 3).when(name.isin("T", "TERRORIST", "RED", "2", "DEFENSE"), 2).otherwise(F.coalesce(name.try_cast("int"), F.lit(0)))


def stable_id(x, bit: int = 55, empty: str = "") -> Column:
    """The first seven bytes of the SHA-1, with one bit set above them."""
    text = F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(empty))
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 14), 16, 10).cast("bigint").bitwiseOR(F.lit(1 << bit))


def steam64(x) -> Column:
    """The 64-bit id written as itself, as STEAM_x:y:z, as [U:1:n] or as an account number."""
    text = F.trim(_c(x).cast("string"))
    pick = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit("")).try_cast("bigint")
    long = pick(r"(\d{17})", 1)
    steam2 = pick(r"STEAM_\d:(\d):(\d+)", 2) * 2 + pick(r"STEAM_\d:(\d):(\d+)", 1) + STEAM_BASE
    steam3 = pick(r"U:1:(\d+)", 1) + STEAM_BASE
    digits = pick(r"^(\d+)$", 1)
    return F.coalesce(long, steam2, steam3, F.when(digits > STEAM_BASE, digits).otherwise(digits + STEAM_BASE))


def steam3(x) -> Column:
    return F.concat(F.lit("[U:1:"), (_c(x) - STEAM_BASE).cast("string"), F.lit("]"))


def profile_url(x) -> Column:
    return F.concat(F.lit("https://steamcommunity.com/profiles/"), _c(x).cast("string"))


def pseudonym(x, salt: bytes, length: int = 20) -> Column:
    """The first hex digits of the HMAC-SHA256 of x under salt."""
    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    pad = lambda b: F.unhex(F.lit(bytes(k ^ b for k in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), _c(x).cast("string").cast("binary")), 256))
    return F.substring(F.sha2(F.concat(pad(0x5C), inner), 256), 1, length)


def new_salt() -> str:
    return secrets.token_hex(16)


def log_time(x) -> Column:
    return F.try_to_timestamp(_c(x), F.lit("MM/dd/yyyy HH:mm:ss"))


def iso_time(x) -> Column:
    return F.try_to_timestamp(_c(x))


def clock_seconds(x) -> Column:
    """Seconds of m:ss, or of a plain number."""
    parts = F.split(_c(x).cast("string"), ":")
    return F.when(F.size(parts) == 2, parts[0].try_cast("double") * 60 + parts[1].try_cast("double")).otherwise(parts[0].try_cast("double"))


def position(x) -> Column:
    """x, y and z of "x y z", null if they aren't three numbers."""
    parts = F.split(F.trim(_c(x)), r"\s+")
    xyz = [parts[i].try_cast("double") for i in range(3)]
    good = (F.size(parts) == 3) & xyz[0].isNotNull() & xyz[1].isNotNull() & xyz[2].isNotNull()
    return F.when(good, F.struct(*[v.alias(k) for v, k in zip(xyz, "xyz", strict=True)]))


def dotnet_seconds(x) -> Column:
    """Unix seconds of 100 ns ticks since the year 1."""
    return ((_c(x) - 621355968000000000) / 10_000_000).cast("bigint")


def pressed(mask) -> Column:
    return F.filter(F.array(*map(F.lit, (1, 2, 4, 8))), lambda k: _c(mask).bitwiseAND(k) != 0)


def plain_name(x) -> Column:
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


def sigmoid(z) -> Column:
    return 1 / (1 + F.exp(-_c(z)))


def dig(json, path: str) -> Column:
    """A value in JSON text by a path such as a[0].b, as text."""
    return F.get_json_object(_c(json), f"$.{path}")


def weapon(json, path: str) -> Column:
    """A weapon that is text or has an itemId."""
    return F.coalesce(dig(json, f"{path}.itemId"), dig(json, path))
