"""Exchange of labelled observations without anything that names a player, a match or a file."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import pseudonym
from .learn import value_of

VERSION = 1
SCHEMA = "version int, made_at long, note string, features array<string>, observations long, players long, positives long, records array<struct<p:string,f:map<string,double>,y:int,s:double>>"


def exported(labelled: DataFrame, salt: bytes, names: list[str], note: str = "", made_at: int = 0) -> DataFrame:
    """One row in the form of SCHEMA: a keyed hash for each player, signal values, label and score, and no more."""
    entry = F.struct(pseudonym("steamid", salt).alias("p"), F.create_map(*[x for n in names for x in (F.lit(n), F.round(value_of("signals", n), 4))]).alias("f"), F.col("label").cast("int").alias("y"), F.col("score").cast("double").alias("s"))
    out = labelled.agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("steamid").alias("players"), F.countDistinct(F.when(F.col("label") == 1, F.col("steamid"))).alias("positives"), F.collect_list(entry).alias("records"))
    return out.select(F.lit(VERSION).alias("version"), F.lit(made_at).cast("long").alias("made_at"), F.lit(note).alias("note"), F.array(*map(F.lit, names)).alias("features"), "observations", "players", "positives", "records")


def records(labelled: DataFrame, salt: bytes, names: list[str]) -> DataFrame:
    """The same records as rows, for tables too large for one document."""
    return labelled.select(pseudonym("steamid", salt).alias("p"), *[F.round(value_of("signals", n), 4).alias(n) for n in names], F.col("label").cast("int").alias("y"), F.col("score").alias("s"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of exchange files (p, f, y, s); other versions are refused."""
    files = spark.read.schema(SCHEMA).json(path, multiLine=True)
    ok = F.when(F.col("version") == VERSION, F.col("records")).otherwise(F.raise_error(F.lit("unknown version of an exchange file")).cast(files.schema["records"].dataType))
    return files.select(F.explode(ok).alias("r")).select("r.*")


def summary(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.schema(SCHEMA).json(path, multiLine=True)
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("observations").alias("observations"), F.sum("players").alias("players"), F.sum("positives").alias("positives"))
