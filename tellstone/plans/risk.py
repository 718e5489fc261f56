"""Risk of accounts from what platforms say of them: rules that add points, and the merge of sources."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import STEAM_BASE


def capped(rows: DataFrame, rules: list[tuple[Column, int, str]], cap: int = 100) -> DataFrame:
    """rows with risk, the points of all rules that hold, up to cap, and the reasons."""
    points = sum((F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, p, _ in rules), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), r) for c, _, r in rules])) if rules else F.array().cast("array<string>")
    return rows.withColumn("risk", F.least(F.lit(cap), points).cast("int")).withColumn("reasons", reasons)


def steam_account(rows: DataFrame, now: Column) -> DataFrame:
    """Rows (vac_banned, game_bans, created_at, private, hours, friends, banned_friends) with risk and reasons."""
    age = (now - F.col("created_at")) / 86400
    share = F.try_divide(F.col("banned_friends").cast("double"), F.col("friends").cast("double"))
    return capped(rows, [
        (F.col("vac_banned") > 0, 45, "platform ban"), (F.col("game_bans") > 0, 35, "game ban"),
        (age < 60, 25, "account younger than 60 days"), ((age >= 60) & (age < 365), 10, "account younger than a year"),
        (F.col("private"), 15, "private profile"), (F.col("hours") < 50, 20, "few hours played"), (share > 0.15, 20, "banned friends"),
    ])


def _text(path: str) -> Column:
    return F.get_json_object("payload", path)


def _number(path: str) -> Column:
    return F.regexp_replace(_text(path), "%", "").try_cast("double")


def _xml(tag: str) -> Column:
    return F.nullif(F.regexp_extract("payload", rf"<{tag}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1), F.lit(""))


def _lifetime(stat: str) -> Column:
    """A number of the first overview segment that is named Lifetime."""
    kind = "array<struct<type:string,metadata:struct<name:string>,stats:map<string,struct<value:double>>>>"
    own = F.filter(F.from_json(_text("$.data.segments"), kind), lambda x: (x["type"] == "overview") & (x["metadata"]["name"] == "Lifetime"))
    return F.try_element_at(F.try_element_at(own, F.lit(1))["stats"], F.lit(stat))["value"]


#: For each platform, the name it shows and its rules over a captured payload: points, and what they are for.
PLATFORMS: dict[str, tuple] = {
    "faceit": (lambda: _text("$.nickname"), lambda: [(F.size(F.from_json(_text("$.bans"), "array<string>")) > 0, 60, "banned")]),
    "steamcommunity": (lambda: _xml("steamID"), lambda: [(_xml("vacBanned") == "1", 45, "banned"), (_xml("privacyState").isin("private", "friendsonly"), 15, "private profile"), (_xml("isLimitedAccount") == "1", 10, "limited account")]),
    "opendota": (lambda: _text("$.profile.personaname"), lambda: []),
    "riot": (lambda: _text("$.gameName"), lambda: []),
    "bungie": (lambda: _text("$.Response.profiles[0].displayName"), lambda: []),
    "wargaming": (lambda: _text("$.data[0].nickname"), lambda: []),
    "ballchasing": (lambda: _text("$.list[0].id"), lambda: []),
    "pubg": (lambda: _text("$.data[0].attributes.name"), lambda: []),
    "gametools": (lambda: _text("$.userName"), lambda: [(_number("$.headShots") >= 40, 35, "headshots of 40 % or more")]),
    "osu": (lambda: _text("$[0].username"), lambda: [(_text("$[0].user_id").isNull(), 40, "no such account")]),
    "openxbl": (lambda: _text("$.people[0].gamertag"), lambda: [(_text("$.people[0].xuid").isNull(), 30, "no such account")]),
    "lichess": (lambda: _text("$.username"), lambda: [(F.lower(_text("$.tosViolation")) == "true", 90, "violation of the terms")]),
    "chesscom": (lambda: _text("$.username"), lambda: [(F.lower(_text("$.status")).rlike("fair_play|abuse"), 90, "closed for fair play or abuse")]),
    "tracker": (lambda: _text("$.data.platformInfo.platformUserHandle"), lambda: [(_lifetime("headshots") >= 3000, 25, "many headshots")]),
    "runescape": (lambda: F.lit(None).cast("string"), lambda: [(F.trim("payload") == "", 0, "no profile in the lists"), ((F.trim("payload") != "") & (_level() <= 0), 20, "no level")]),
    "battlemetrics": (lambda: F.lit(None).cast("string"), lambda: [(_bans() >= 1, 25, "community bans"), (_bans() == 2, 25, None), (_bans() == 3, 50, None), (_bans() >= 4, 75, None)]),
}


def _bans() -> Column:
    return F.coalesce(F.size(F.from_json(_text("$.data"), "array<string>")), F.lit(0))


def _level() -> Column:
    """The second number of the first line that isn't blank; 0 if there is none, null if it is no number."""
    first = F.try_element_at(F.filter(F.split("payload", r"\r\n|\r|\n"), lambda x: F.trim(x) != ""), F.lit(1))
    parts = F.split(first, ",")
    return F.when(F.size(parts) < 2, 0).otherwise(F.trim(F.try_element_at(parts, F.lit(2))).try_cast("int"))


def platform_profiles(payloads: DataFrame) -> DataFrame:
    """payloads (platform, account, payload) with the name shown, risk, reasons and error, in one pass.

    An answer that failed has no risk, and error says so: a null payload, or
    one of runescape whose level is no number.  Platforms without rules here
    give risk 0.  battlemetrics gives 25 for each ban, up to 100.
    """
    none = F.array().cast("array<string>")
    shown, points, reasons = F.lit(None).cast("string"), F.lit(0), none
    for name, (own, rules) in PLATFORMS.items():
        mine = F.col("platform") == name
        held = [(F.coalesce(c, F.lit(False)), p, r) for c, p, r in rules()]
        shown = F.when(mine, own()).otherwise(shown)
        points = F.when(mine, sum((F.when(c, p).otherwise(0) for c, p, _ in held), F.lit(0))).otherwise(points)
        said = [F.when(c, r) for c, _, r in held if r]
        reasons = F.when(mine, F.array_compact(F.array(*said)) if said else none).otherwise(reasons)
    failed = F.col("payload").isNull() | F.coalesce((F.col("platform") == "runescape") & (F.trim("payload") != "") & _level().isNull(), F.lit(False))
    out = payloads.withColumns({"risk": F.when(failed, 0).otherwise(F.least(F.lit(100), points)).cast("int"), "reasons": F.when(failed, none).otherwise(reasons), "shown": F.when(~failed, shown), "error": failed})
    return out.drop("payload")


def dota_account(steamid) -> Column:
    """The account number that dota services use."""
    return (steamid if isinstance(steamid, Column) else F.col(steamid)) - STEAM_BASE


def merged(local: DataFrame, found: DataFrame, key: str = "account") -> DataFrame:
    """local (key, risk, reasons) raised to the largest risk of any source, never the sum; reasons name their source."""
    named = F.transform("reasons", lambda r: F.concat(F.col("platform"), F.lit(": "), r))
    other = found.withColumn("named", named).groupBy(key).agg(F.max("risk").alias("_risk"), F.flatten(F.sort_array(F.collect_list("named"))).alias("_reasons"))
    out = local.join(other, key, "left")
    return out.withColumn("risk", F.greatest("risk", F.coalesce("_risk", F.lit(0)))).withColumn("reasons", F.concat("reasons", F.coalesce("_reasons", F.array().cast("array<string>")))).drop("_risk", "_reasons")
