"""How document filters interact: what each removes, repeats and loses, in every order of them."""
from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import joined, stored
from .transducer import measured_texts


def rules() -> dict[str, Column]:
    """Conditions over the columns of measured_texts() under which a text fails a filter."""
    return {
        "A": F.col("n_words") < 50,
        "B": 100 * F.col("n_distinct") < 65 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 5 * F.col("n_chars"),
        "D": F.col("n_symbols") > 0,
    }


def failures(docs: DataFrame, labels: DataFrame, part: Column, conditions: dict[str, Column]) -> DataFrame:
    """Counted classes of documents: part, fails, good, toxic and n; part is a string, empty for null.

    fails has a bit for each filter, the first of conditions lowest, and the
    highest for the filter of copies, which a document fails if its text is
    that of a row with a smaller doc_id.  A null doc_id is neither smaller nor
    larger.  good and toxic tell whether a row of labels (doc_id, quality,
    toxic) with that doc_id has a 1.  Rows with the same doc_id all count.
    """
    own = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(conditions.values())), F.lit(0))
    texts = measured_texts(docs.select("doc_id", "text", F.coalesce(part.cast("string"), F.lit("")).alias("part")))
    rows = texts.select("doc_id", "part", own.alias("fails"), "digest").groupBy("doc_id", "part", "fails", "digest").agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows)  # what follows counts its keys before it joins them
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Both sides grow with the documents, so that neither is broadcast.
    rows = stored(joined(rows, marks.filter("doc_id is not null"), ["doc_id"], "left", F.col("digest"), limit=0))
    rows = rows.withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    # The rows with the least doc_id of each text; the limit of the rank is taken in each task before rows move.
    rank = F.rank().over(Window.partitionBy("digest").orderBy("doc_id"))
    first = rows.filter("doc_id is not null").withColumn("rank", rank).filter("rank = 1").drop("rank").union(rows.filter("doc_id is null"))
    kind, high = ["part", "fails", "good", "toxic"], 1 << len(conditions)
    all_rows = rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("firsts"))
    firsts = first.groupBy(*kind).agg(F.lit(0).cast("long").alias("n"), F.sum("n").alias("firsts"))
    both = all_rows.union(firsts).groupBy(*kind).agg(F.sum("n").alias("n"), F.sum("firsts").alias("firsts"))
    classes = F.array(F.struct(F.col("fails"), F.col("firsts").alias("n")), F.struct((F.col("fails") + high).alias("fails"), (F.col("n") - F.col("firsts")).alias("n")))
    return both.select("part", "good", "toxic", F.explode(classes).alias("c")).select("part", "c.fails", "good", "toxic", "c.n").filter("n > 0")


def orders(letters: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """filter_order, step, and for each mask of failures whether a text is kept after the step, removed or failed again at it, or fails at it only."""
    out = []
    for order in permutations(letters):
        bits = [1 << letters.index(x) for x in order]
        for step, bit in enumerate(bits):
            before = sum(bits[:step])
            for mask in range(1 << len(letters)):
                fails, gone = bool(mask & bit), bool(mask & before)
                out.append(("".join(order), step + 1, mask, int(not fails and not gone), int(fails and not gone), int(fails and gone), int(mask == bit)))
    return out


def interactions(classes: DataFrame, letters: str) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    classes has part, fails, good, toxic and n, as failures() gives them.  A
    part has a row for each order and step, also where nothing is removed; a
    table without rows has no part.  shapley is the number of documents that
    the step's filter removes, summed over all orders.
    """
    spark = classes.sparkSession
    counts = classes.groupBy("part", "fails").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    # 120 orders of 5 filters, 5 steps and 32 masks: a table of a fixed size, whatever the documents are.
    table = spark.createDataFrame(orders(letters), "filter_order string, step int, fails int, is_kept long, is_removed long, is_redundant long, is_unique long")
    total = [F.sum(F.col(a) * F.col(b)).alias(name) for name, a, b in (
        ("kept", "is_kept", "n"), ("removed", "is_removed", "n"), ("redundant", "is_redundant", "n"), ("unique_fails", "is_unique", "n"), ("good_lost", "is_removed", "good"), ("toxic_lost", "is_removed", "toxic"))]
    steps = counts.join(F.broadcast(table), "fails").groupBy("part", "filter_order", "step").agg(*total)
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    over = Window.partitionBy("part", letter)
    return steps.withColumn("shapley", F.sum("removed").over(over))


def audit(docs: DataFrame, labels: DataFrame, part: Column, conditions: dict[str, Column] | None = None, again: str = "E") -> DataFrame:
    """interactions() of failures() of docs (doc_id, text), for each value of part."""
    conditions = rules() if conditions is None else conditions
    if factorial(len(conditions) + 1) > 720:
        raise ValueError("orders of more than six filters are too many")
    return interactions(failures(docs, labels, part, conditions), "".join(conditions) + again)
