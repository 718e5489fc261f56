"""Which files were read already: a ledger by path and size."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Endings of files that can be read.
ENDINGS = (".dem", ".log", ".json", ".jsonl", ".ndjson", ".csv")
SEEN = "path string, size long, analyzed_at long, match_id string"


def listing(spark: SparkSession, folder: str, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """path, size and modified of the files in a folder with such an ending that aren't empty; their contents aren't read."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.filter(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"))


def latest(marks: DataFrame) -> DataFrame:
    """The last mark of each path, by analyzed_at, then by size and match."""
    last = F.max(F.struct("analyzed_at", "size", "match_id")).alias("_m")
    return marks.groupBy("path").agg(last).select("path", "_m.size", "_m.analyzed_at", "_m.match_id")


def pending(files: DataFrame, marks: DataFrame) -> DataFrame:
    """Files that aren't marked with the size that they have now: new ones and those that have grown since."""
    return files.join(latest(marks).select("path", "size"), ["path", "size"], "left_anti")


def stable(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files of two listings some time apart, the first of them stored, that have the same size in both and aren't empty."""
    return now.filter("size > 0").join(before.select("path", "size"), ["path", "size"], "left_semi")


def mark(found: DataFrame, path: str, batch: int, analyzed_at: Column, match_id: Column | None = None) -> None:
    """Mark files (path, size) as read by a batch.  The same batch again writes the same marks again, not more."""
    match_id = F.lit(None) if match_id is None else match_id
    rows = found.select("path", "size", analyzed_at.cast("long").alias("analyzed_at"), match_id.cast("string").alias("match_id"))
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def marks(spark: SparkSession, path: str) -> DataFrame:
    """All marks under path; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return spark.createDataFrame([], SEEN)
    return spark.read.schema(f"{SEEN}, batch long").parquet(path).drop("batch")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the last mark of each path to another folder, as its batch -1, with which the ledger goes on there."""
    latest(marks(spark, path)).write.mode("overwrite").parquet(f"{to}/batch=-1")


def newest(rows: DataFrame, time: str, key: str, keep: int, parts: int = 1000) -> DataFrame:
    """The keep rows with the largest time, then key; key is unique.

    Rows are counted in parts of the range of times, so that only those of the
    part in which the limit falls are put in order.
    """
    at = F.col(time).cast("double")
    spread = rows.agg(F.min(at).alias("_low"), F.max(at).alias("_high"))  # one row
    part = F.coalesce(F.floor(F.try_divide(float(parts) * (at - F.col("_low")), F.col("_high") - F.col("_low"))), F.lit(0))
    placed = rows.crossJoin(F.broadcast(spread)).withColumn("_part", part).drop("_low", "_high")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_newer", F.coalesce(F.sum("_n").over(W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # parts + 1 rows
    placed = placed.join(F.broadcast(before.filter(F.col("_newer") < keep)), "_part")
    whole = placed.filter(F.col("_newer") + F.col("_n") <= keep)
    cut = placed.filter(F.col("_newer") + F.col("_n") > keep).withColumn("_r", F.row_number().over(W.partitionBy("_part").orderBy(F.desc(time), F.desc(key))))
    return whole.unionByName(cut.filter(F.col("_r") <= keep - F.col("_newer")).drop("_r")).drop("_part", "_n", "_newer")
