"""Ordered operators over event times: sessions, islands, windows and lookups, each by equi-joins or window functions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cols(names) -> list[Column]:
    return [n if isinstance(n, Column) else F.col(n) for n in names]


def sessions(df: DataFrame, keys: list[str], order: list, time: str, gap: float, name: str = "session") -> DataFrame:
    """Numbers from 1, anew where a row is more than gap after the one before it."""
    w = W.partitionBy(*keys).orderBy(*_cols(order))
    new = (F.col(time) - F.lag(time).over(w) > gap).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn(name, F.sum("_new").over(w)).drop("_new")


def last_island(times: Column, end: Column, gap: int) -> Column:
    """The first time of the run, read backwards from end, whose steps are at most gap; null if its last time is further from end.

    times is an array of integers in falling order, all at most end.
    """
    start = F.struct((end + 1).cast("int").alias("last"), F.lit(True).alias("open"), F.lit(None).cast("int").alias("found"))

    def step(a: Column, t: Column) -> Column:
        near = a["open"] & (a["last"] - t <= gap)
        return F.struct(F.when(near, t).otherwise(a["last"]).cast("int").alias("last"), near.alias("open"), F.when(near, t).otherwise(a["found"]).cast("int").alias("found"))

    return F.aggregate(times, start, step, lambda a: a["found"])


def trailing_size(keys: list[str], time: str, ties: list[str], span: float) -> tuple[Column, Column]:
    """How many rows, in order, lie within span up to each row, and the time of the first of them.

    Rows of equal time count one by one in their order.
    """
    ordered = W.partitionBy(*keys).orderBy(time, *ties)
    ranged = W.partitionBy(*keys).orderBy(time).rangeBetween(-int(span), 0)
    rank = F.row_number().over(ordered)
    return rank, F.min(time).over(ranged)


def bursts(df: DataFrame, keys: list[str], time: str, ties: list[str], span: float, least: int) -> DataFrame:
    """Each largest group of at least least rows within span: keys, start, end and size."""
    ordered = W.partitionBy(*keys).orderBy(time, *ties)
    ranked = df.withColumn("_rank", F.row_number().over(ordered))
    ranged = W.partitionBy(*keys).orderBy(time).rangeBetween(-int(span), 0)
    sized = ranked.withColumn("size", F.col("_rank") - F.min("_rank").over(ranged) + 1).withColumn("start", F.min(time).over(ranged)).withColumn("_next", F.lead(time).over(ordered))
    right = F.col("_next").isNull() | (F.col("_next") - F.col("start") > span)
    return sized.filter((F.col("size") >= least) & right).select(*keys, "start", F.col(time).alias("end"), F.col("size").cast("long").alias("size"))


def bounds(df: DataFrame, keys: list[str], start: str, open_end: int, order: list | None = None) -> DataFrame:
    """number from 1 and end_tick, one before the next start or open_end."""
    w = W.partitionBy(*keys).orderBy(*_cols(order or [start]))
    return df.withColumn("number", F.row_number().over(w)).withColumn("end_tick", F.coalesce(F.lead(start).over(w) - 1, F.lit(open_end)).cast("int"))


def as_of(events: DataFrame, starts: DataFrame, keys: list[str], time: str, start: str, value: str, default=0) -> DataFrame:
    """events with value of the last row of starts that is not after them, by one ordered pass over both."""
    left = events.select(*events.columns, F.col(time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(starts.schema[value].dataType).alias("_value"))
    right = starts.select(*[F.col(c) if c in keys else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns], F.col(start).alias("_time"), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    w = W.partitionBy(*keys).orderBy("_time", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_found", F.last("_value", ignorenulls=True).over(w))
    return both.filter("_side = 1").select(*events.columns, F.coalesce("_found", F.lit(default)).alias(value))


def within(left: DataFrame, right: DataFrame, keys: list[str], low: str, high: str, time: str, width: int) -> DataFrame:
    """All pairs whose time lies from low to high, by an equi-join on stretches of width."""
    spread = left.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    there = right.withColumn("_stretch", F.floor(F.col(time) / width))
    return spread.join(there, [*keys, "_stretch"]).filter(F.col(time).between(F.col(low), F.col(high))).drop("_stretch")


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key, the first in the order."""
    return top_n(df, keys, order, 1)
