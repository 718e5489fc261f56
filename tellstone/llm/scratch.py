"""Intermediate tables in the folder that driver and executors share."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

#: A side of a join is broadcast up to this many bytes, which are measured.
BROADCAST_BYTES = 16 << 20
#: Rows of one key that a task of a shuffled join takes; keys with more are split.
PART = 1_000_000
#: Bytes of a task's share of the tables that operators deal to buckets.
BUCKET_BYTES = 32 << 20


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder.

    The folder is the one named in spark.checkpoint.dir.  A local one is made
    only for a local master; on a cluster its files would stay on the machines
    that write them, so an unset folder is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tellstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tellstone-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application has stored; results that weren't written elsewhere can't be read after it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark).rpartition("/")[0])
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage: what reads the result doesn't depend on executors that
    are lost later.  The owner of the session removes the tables with clear().
    """
    spark = df.sparkSession
    path = folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores after those that are taken already."""
    used, out = {n.lower() for n in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def _size(value: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StringType, BinaryType)):
        return F.coalesce(F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(0))
    if isinstance(kind, ArrayType):
        return 16 * F.coalesce(F.size(value), F.lit(0))
    return F.lit(16)


def measured(df: DataFrame) -> int:
    """Bytes that the rows of df take in a table of a broadcast join, with all their strings and arrays."""
    row = F.lit(64).cast("long")
    for f in df.schema:
        row = row + _size(F.col(f"`{f.name}`"), f.dataType)
    return df.agg(F.sum(row)).first()[0] or 0


def buckets(spark: SparkSession, size: int) -> int:
    """Into how many parts size bytes are dealt: as many as there are shuffle partitions, and more where those would grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread: Column | None = None, limit: int = BROADCAST_BYTES, part: int = PART) -> DataFrame:
    """left joined with a table that has one row a key, hot keys of left split.

    right is stored and measured: up to limit bytes it is broadcast.  Beyond
    that, keys with more than part rows of left (no more than one in part
    rows) are counted, their rows dealt by spread, and right has as many
    copies of their rows.  Without spread they are dealt by their places, for
    which left must be read from files.  how is inner, left, left_semi or
    left_anti.
    """
    right = stored(right)
    if measured(right) <= limit:
        return left.join(F.broadcast(right), keys, how)
    n, salt, place = fresh([*left.columns, *right.columns], "parts", "salt", "place")
    left = left.withColumn(place, F.monotonically_increasing_id() if spread is None else spread)
    hot = stored(left.groupBy(*keys).count().filter(F.col("count") > part).select(*keys, F.ceil(F.col("count") / part).cast("int").alias(n)))
    if not hot.limit(1).count():
        return left.join(right, keys, how).drop(place)
    # At most one key in part rows of left is hot: a table for a broadcast, if that is measured too.
    hot = F.broadcast(hot) if measured(hot) <= limit else hot
    dealt = left.join(hot, keys, "left").withColumn(salt, F.pmod(F.xxhash64(place), F.coalesce(n, F.lit(1))).cast("int")).drop(n, place)
    copies = right.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))).drop(n)
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """docs with all its columns in one, row, beside keys: no name that an operator uses can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(name) for name, k in keys.items()])


def identity(text: str = "text") -> dict[str, Column]:
    """What tells rows of documents apart: doc_id as a string, empty for null, and a hash of the text."""
    return {"id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_hash": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))}
