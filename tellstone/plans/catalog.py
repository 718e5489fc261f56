"""The catalogue of games, given as a table, and questions to it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hints import first_hint
from ..schema import SUPPORT

#: What each support level stands for.
CAPS = {"full": ["angles", "health", "kills", "positions", "shots", "teams"], "positional": ["angles", "positions"], "events": ["kills"], "account": [], "none": []}


def rank(level: str | Column = "support") -> Column:
    column = F.col(level) if isinstance(level, str) else level
    return F.array_position(F.array(*map(F.lit, SUPPORT)), column)


def at_least(games: DataFrame, level: str) -> DataFrame:
    return games.filter(rank() >= rank(F.lit(level)))


def counts(games: DataFrame) -> DataFrame:
    """Games of each support level, and of all."""
    return games.rollup("support").count().select(F.coalesce("support", F.lit("total")).alias("support"), F.col("count").alias("n"))


def capabilities(games: DataFrame) -> DataFrame:
    known = F.create_map(*[x for k, v in CAPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return games.withColumn("capabilities", F.try_element_at(known, F.col("support")))


def identify(rows: DataFrame, games: DataFrame, hints: DataFrame) -> DataFrame:
    """rows (name, app_id) with the key of their game: by the store's id, else by the first hint (ordinal, hint, key) in the name.

    Of games with the same id the first in the catalogue counts, by its ordinal if it has one.
    """
    order = "ordinal" if "ordinal" in games.columns else "key"
    by_id = games.filter("steam_appid is not null").groupBy(F.col("steam_appid").cast("string").alias("app_id")).agg(F.min_by("key", order).alias("_by_id"))
    out = first_hint(rows, "name", hints, "_hint").join(by_id, "app_id", "left")
    return out.withColumn("key", F.coalesce("_by_id", "_hint")).drop("_by_id", "_hint")


def launcher(rows: DataFrame, hints: DataFrame, name: str = "name", publisher: str = "publisher") -> DataFrame:
    """rows with the launcher of the first hint (ordinal, hint, key) in the name and publisher of an installed game."""
    both = F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(publisher, F.lit("")))
    return first_hint(rows, both, hints, "launcher")
