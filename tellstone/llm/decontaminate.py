"""Benchmark passages in training documents, found by exact n-grams of words.

DataFrame operations only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import BROADCAST_BYTES, identity, joined, measured, packed, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z is lower case, and before that.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: Distinct values up to which constants() gives them.
CONSTANTS = 50_000
#: Slots of the filter of windows, at most: 8 MB in all, which tell two million windows from others at all but one place in 300.
SLOTS = 1 << 14


def lowered(text: Column) -> Column:
    """text with A-Z in lower case, and no other character changed."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BETWEEN), "")


def constants(column: DataFrame, most: int) -> list | None:
    """The distinct values of a one-column table, or None where there are more than most."""
    found = [r[0] for r in column.distinct().limit(most + 1).collect()]  # bounded by most
    return sorted(found) if len(found) <= most else None


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, and the length, the words and the hash of each window of each item."""
    items = benchmark.select(F.col("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    each = items.select("item_id", size.alias("size"), F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("g"))
    return each.select("item_id", "size", F.array_join("g", " ").alias("gram"), F.xxhash64("g", "size").alias("hash")).distinct()


def _places(hash_: Column) -> list[tuple[Column, Column]]:
    """The two places of a hash in a slot of the filter: of 64 numbers one, and of its bits one."""
    part = lambda k: F.shiftrightunsigned(hash_, k).bitwiseAND(63).cast("int")
    return [(part(20), part(26)), (part(40), part(46))]


def _filter(grams: DataFrame, slots: int) -> tuple[DataFrame, int]:
    """slot and its bits, 64 long integers, in which the places of all windows' hashes are set; and the number of slots.

    Slots grow with the windows, 64 bits for each, up to the given number of
    512 bytes each, whatever the benchmark is.
    """
    hashes = stored(grams.select("hash").distinct())
    n = max(1, min(slots, hashes.count() // 64 + 1))
    places = F.array(*[F.struct(a.alias("number"), b.alias("bit")) for a, b in _places(F.col("hash"))])
    each = hashes.select(F.pmod("hash", F.lit(n)).alias("slot"), F.explode(places).alias("p")).select("slot", "p.number", F.expr("shiftleft(1L, p.bit)").alias("bits"))
    numbers = each.groupBy("slot", "number").agg(F.bit_or("bits").alias("bits")).groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("number", "bits"))).alias("m"))
    return stored(numbers.select("slot", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("bits"))), n


def _scanned(docs: DataFrame, grams: DataFrame, slots: int) -> DataFrame:
    """One pass over the texts: id, text_hash, doc_id, n_words, and at, size and gram of windows that may be known.

    Each document has one row without a window (size 0).  Each window of a
    document is hashed, and only those become strings whose places are set in
    a filter of the hashes of all known windows.
    """
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # n values at most
    table, n = _filter(grams, slots)
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select("doc_id", *[c.alias(name) for name, c in identity().items()], words(whole).alias("w"))
    # The first place stands for the document; those of each size follow one another.
    hashes = ["array(CAST(NULL AS BIGINT))", *(f"if(size(w) >= {k}, transform(sequence(1, size(w) - {k - 1}), i -> xxhash64(slice(w, i, {k}), {k})), array())" for k in sizes)]
    # The hashes are made before they are exploded, so that generated code goes through them without a copy of w for each;
    # outer, as otherwise the optimizer makes a filter that computes them (and w, at each use) once more.
    each = split.withColumn("hashes", F.expr(f"concat({', '.join(hashes)})")).select("doc_id", "id", "text_hash", "w", F.posexplode_outer("hashes").alias("pos", "hash"))
    each = each.withColumn("slot", F.pmod("hash", F.lit(n))).join(F.broadcast(table), "slot", "left")
    number = lambda i: F.coalesce(F.get("bits", i), F.lit(0).cast("long"))
    hit = [F.getbit(number(a), b) == 1 for a, b in _places(F.col("hash"))]
    each = each.filter((F.col("pos") == 0) | (hit[0] & hit[1]))
    at, size, before = F.lit(-1), F.lit(0), F.lit(1)
    for k in sizes:
        mine = F.greatest(F.size("w") - (k - 1), F.lit(0))
        inside = (F.col("pos") >= before) & (F.col("pos") < before + mine)
        at, size = F.when(inside, F.col("pos") - before).otherwise(at), F.when(inside, k).otherwise(size)
        before = before + mine
    gram = F.when(F.col("size") > 0, F.array_join(F.slice("w", F.col("at") + 1, F.greatest("size", F.lit(1))), " "))
    found = each.select("doc_id", "id", "text_hash", "w", at.alias("at"), size.alias("size"))
    return stored(found.select("doc_id", "id", "text_hash", F.size("w").cast("long").alias("n_words"), "at", "size", gram.alias("gram")))


def _verified(found: DataFrame, grams: DataFrame, limit: int) -> DataFrame:
    """id, text_hash, at, size and gram of the windows found that are known."""
    hits = found.filter("size > 0").select("id", "text_hash", "at", "size", "gram")
    return joined(hits, grams.select("gram", "size").distinct(), ["gram", "size"], "left_semi", limit=limit)


def _spans(hits: DataFrame) -> DataFrame:
    """id, text_hash, and start and stop of each maximal run of hit words, from 0."""
    before = Window.partitionBy("id", "text_hash").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    far = hits.groupBy("id", "text_hash", "at").agg(F.max(F.col("at") + F.col("size")).alias("stop"))
    far = far.withColumn("new", F.coalesce(F.col("at") > F.max("stop").over(before), F.lit(True)).cast("int"))
    far = far.withColumn("run", F.sum("new").over(Window.partitionBy("id", "text_hash").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    return far.groupBy("id", "text_hash", "run").agg(F.min("at").alias("start"), F.max("stop").alias("stop")).drop("run")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, limit: int = BROADCAST_BYTES, slots: int = SLOTS) -> DataFrame:
    """What each row of docs (doc_id, text) holds of benchmark (item_id, text).

    Words are runs of ASCII letters, digits and other than ASCII characters,
    A-Z in lower case.  A window is n consecutive words of an item, or all of
    an item that has fewer, but not none.  Each word of a document inside any
    occurrence of a window is hit.  A filter of the windows' hashes, of slots
    times 512 bytes at most, is broadcast; what it lets pass is compared with
    the windows themselves, which are broadcast up to limit bytes, measured,
    and shuffled beyond it.  Returns
    doc_id, n_words, n_hit, n_items and items_sha256 (of the ids of items with
    occurring windows, sorted as strings, with commas) and contaminated.  A
    null text has no words; rows with equal doc_id are judged apart by their
    texts, and each row gives a row.  Other columns are not used.
    """
    grams = stored(windows(benchmark, n))
    found = _scanned(docs, grams, slots)
    hits = stored(_verified(found, grams, limit))
    n_hit = _spans(hits).groupBy("id", "text_hash").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"))
    owners = grams.groupBy("gram", "size").agg(F.collect_list("item_id").alias("items"))
    items = joined(hits.select("id", "text_hash", "gram", "size").distinct(), owners, ["gram", "size"], "inner", F.col("text_hash"), limit)
    items = items.select("id", "text_hash", F.explode("items").alias("item")).distinct()
    items = items.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items"))
    known = items.join(n_hit, ["id", "text_hash"]).select("id", "text_hash", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("sha"))
    out = joined(found.filter("size = 0"), known, ["id", "text_hash"], "left", limit=limit)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 10, limit: int = BROADCAST_BYTES, slots: int = SLOTS) -> DataFrame:
    """docs without what scan() finds, all columns kept, whatever their names are.

    remove: "documents" drops each row with a hit word; "spans" cuts the hit
    words and what stands after them up to the next word.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    grams = stored(windows(benchmark, n))
    hits = stored(_verified(_scanned(docs, grams, slots), grams, limit))
    rows = packed(docs, **identity())
    if remove == "documents":
        return joined(rows, hits.select("id", "text_hash").distinct(), ["id", "text_hash"], "left_anti", limit=limit).select("row.*")
    gone = _spans(hits).groupBy("id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("gone"))
    # What stays is before, between and after the runs that go.
    parts = F.regexp_extract_all(F.col("row.text"), F.lit(WORD + APART), 0)
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["stop"]))
    stops = F.concat(F.transform("gone", lambda g: g["start"]), F.array(F.lit(1 << 30)))
    edges = F.arrays_zip(starts.alias("a"), stops.alias("b"))
    # As an argument of a function over one element, parts is computed once and not for each run.
    stays = F.transform(F.array(parts), lambda p: F.flatten(F.transform(edges, lambda x: F.slice(p, x["a"] + 1, F.greatest(F.lit(0), x["b"] - x["a"])))))
    kept = F.concat(F.regexp_extract("row.text", "^" + APART, 0), F.array_join(F.element_at(stays, 1), ""))
    done = joined(rows, gone, ["id", "text_hash"], "left", limit=limit)
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    return done.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
