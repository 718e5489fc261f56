"""Queries of the operators in this subpackage, with production parameters, and their SQL."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, audit, decontaminate, forest, licenses, maxscore, periods, pieces, quality, recompression, simhash, suffixes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.repeats(_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_all(_table(spark, sf_dir, "documents"), licenses.templates(spark))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedding = F.col("embedding").cast("array<double>")
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = _table(spark, sf_dir, "embeddings").filter(finite).select("vec_id", maxscore.quantized(embedding).alias("vector"))
    return maxscore.top_k(rows, F.col("vec_id") % 20 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.col("source"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """docs, about one in ten of which repeats some of its words to its end; which, and what, its doc_id says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    docs = docs.withColumn("_g", F.when(h % 10 == 0, g)).withColumn("_words", F.when(F.col("_g").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n = F.size("_words")
    docs = docs.withColumn("_n", F.when(n > 0, n)).withColumn("_a", (F.col("_g") % F.col("_n")).cast("int"))
    docs = docs.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    again = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return docs.withColumn("text", F.when(F.col("_n").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text"))).drop("_g", "_words", "_n", "_a", "_p")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    found = periods.collapsed(docs).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_simhash": op2_simhash,
        "op3_token_counts": op3_token_counts,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_licenses": op5_licenses,
        "op6_decontamination": op6_decontamination,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_quality": op8_quality,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op11_top_k": op11_top_k,
        "op12_filter_audit": op12_filter_audit,
        "op13_periodic_runs": op13_periodic_runs,
    }


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
d AS (
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
        (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex) AS last_id
  FROM h)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = last_id OR last_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last_id OR last_id IS NULL THEN NULL ELSE last_id END AS refers_to,
  true AS intact
FROM d
"""


OP6_SQL = r"""
WITH low AS (
  SELECT doc_id, rowid AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid FROM documents)),
d AS (SELECT doc_id, r, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM low),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM g),
dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
h AS (SELECT r, dw.n, i, item_id FROM dw JOIN g ON dw.gram = g.gram AND dw.n = g.n),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents)),
g AS (SELECT doc_id, r, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY s) AS again FROM g),
c AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM m WHERE again),
k AS (SELECT r, list(p) AS gone FROM c GROUP BY r),
o AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN k USING (r))
SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM o
"""


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
m AS (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_id, min(i) OVER (PARTITION BY s, r) AS first_i FROM w),
c AS (SELECT r, i FROM m WHERE doc_id > first_id OR i > first_i),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM c),
k AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT r, k, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY r, k),
t AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
u AS (SELECT d.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS stop, sum(b - a) AS gone, count(*) AS spans FROM t JOIN d ON d.r = t.r GROUP BY d.r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN u ON u.r = d.r
"""

OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, row_number() OVER () AS r FROM embeddings),
e AS (SELECT * FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
c AS (SELECT r AS x, vec_id AS root FROM v UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.x),
m AS (SELECT x, min(root) AS component_id FROM c GROUP BY x),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN m ON m.x = v.r LEFT JOIN n ON n.a = v.r
"""


OP11_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""

OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 50)::INT
    + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * strlen(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(w.doc_id > first_id, false)::INT AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
p AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (
  SELECT filter_order, step, (2 ^ (ascii(substr(filter_order, step, 1)) - 65))::INT AS bit,
    list_sum(list_transform(range(1, step), lambda i: (2 ^ (ascii(substr(filter_order, i::INT, 1)) - 65))::INT))::INT AS earlier
  FROM p, (SELECT unnest(range(1, 6))::INT AS step) WHERE length(filter_order) = 5),
o AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (fails & (bit | coalesce(earlier, 0)) = 0) AS kept,
    sum(n) FILTER (fails & bit > 0 AND fails & coalesce(earlier, 0) = 0) AS removed,
    sum(n) FILTER (fails & bit > 0 AND fails & coalesce(earlier, 0) > 0) AS redundant,
    sum(n) FILTER (fails = bit) AS unique_fails,
    sum(good) FILTER (fails & bit > 0 AND fails & coalesce(earlier, 0) = 0) AS good_lost,
    sum(toxic) FILTER (fails & bit > 0 AND fails & coalesce(earlier, 0) = 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op6_decontamination": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op10_embedding_dedup": OP10_SQL, "op11_top_k": OP11_SQL, "op12_filter_audit": OP12_SQL}
