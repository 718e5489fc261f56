"""The first of many ordered hints that a text contains."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of hints that are sent to all tasks; more are joined.
MOST_BYTES = 16 << 20
#: What a hint takes besides its letters and its key, in the automaton that a task makes: some nodes a letter.
EACH, LETTER = 200, 100


def first_hint(rows: DataFrame, text: str | Column, hints: DataFrame, name: str, limit: int = MOST_BYTES) -> DataFrame:
    """rows with the column name: the key of the first of hints (ordinal, hint, key) that text contains.

    Texts are trimmed and compared in lower case, hints as they are; the least
    ordinal counts, whatever its place in the text.  A null text and one
    without a hint have a null key; an empty hint is in every text; null
    hints are in none, and of hints with equal ordinals the one with the least
    key counts.
    Hints are measured: up to limit bytes they are broadcast and a task makes
    one automaton of them, so a text is read once for all; more of them are
    joined with the stretches of the texts that have a hint's length.
    """
    text = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    known = hints.filter("hint is not null").groupBy("hint").agg(F.min(F.struct("ordinal", "key")).alias("best"))
    # Up to the limit: what comes to the driver is measured before.
    size = known.agg(F.sum(EACH + LETTER * F.length("hint") + F.coalesce(F.octet_length("best.key"), F.lit(0)))).first()[0] or 0
    if size > limit:
        return _joined(rows, text, known, name)
    listed = [(r.hint, (r.best.ordinal, r.best.key)) for r in known.collect()]
    shared = rows.sparkSession.sparkContext.broadcast(listed)

    @F.pandas_udf("string")
    def find(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton, always = ahocorasick.Automaton(), None

        def place(best: tuple) -> tuple:
            return best[0], best[1] is not None, best[1] or ""

        for hint, best in shared.value:
            if hint:
                automaton.add_word(hint, best)
            else:
                always = best
        automaton.make_automaton()
        some = len(automaton) > 0

        def first(value: str | None) -> str | None:
            if value is None:
                return None
            best = min((b for _, b in automaton.iter(value)), key=place, default=None) if some else None
            if always is not None and (best is None or place(always) < place(best)):
                best = always
            return best[1] if best else None

        for column in columns:
            yield column.map(first, na_action="ignore").astype(object).where(column.notna(), None)

    return rows.withColumn(name, find(text))


def _joined(rows: DataFrame, text: Column, known: DataFrame, name: str) -> DataFrame:
    """By stretches: distinct texts are cut into all stretches of each length that a hint has, and these joined with hints, each of which is there once."""
    lengths = known.select(F.length("hint").alias("n")).groupBy("n").count().agg(F.sort_array(F.collect_list("n")).alias("_lengths"))  # one row of different lengths
    texts = rows.select(text.alias("_text")).filter("_text is not null").distinct().crossJoin(F.broadcast(lengths))
    cut = texts.withColumn("_n", F.explode("_lengths")).filter(F.col("_n") <= F.length("_text"))
    places = F.when(F.col("_n") == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.length("_text") - F.col("_n") + 1))
    cut = cut.select("_text", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("_text", i, F.col("_n"))))).alias("hint"))
    found = cut.join(known, "hint").groupBy("_text").agg(F.min("best").alias("_best"))
    return rows.withColumn("_text", text).join(found, "_text", "left").withColumn(name, F.col("_best.key")).drop("_text", "_best")
