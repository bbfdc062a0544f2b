"""Benchmark decontamination: documents against the word windows of benchmark items.

Only DataFrame functions.  Document windows are exploded and their hashes looked up in a
broadcast hash set inside the scan's own code generation, so that only hits become rows of
a shuffle; hits are then verified word for word.  The set is broadcast only after it has
been counted and found within ``BROADCAST_WINDOWS``; a larger one is joined by shuffle.

Nulls, empty texts and texts without words have no windows and are never contaminated.
Repeated rows give repeated results.  Extra columns are carried by ``decontaminate`` and
ignored by ``contamination``.  Empty tables give empty results (no benchmark: no hit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm.common import ascii_lower, fresh, table

#: Words of text whose A-Z is still there, and of lower-cased text.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOW_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: About 50 bytes a window in the broadcast set.
BROADCAST_WINDOWS = 1_000_000


def _words(text, pattern):
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def _folded(text):
    """Unicode lower case, which is faster than A-Z alone.  Of its mappings only that of the
    capital sigma looks at the neighbours; both small sigmas become one, so that words that
    are equal with A-Z lowered are equal here."""
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def _loose(words, pos, n):
    """Hash of a window of folded words: equal for all windows that are equal."""
    return F.xxhash64(F.slice(words, pos, n))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, size, key, words)``: each item's windows; short items are one window."""
    items = benchmark.select("item_id", _words(ascii_lower(F.col("text")), LOW_WORD).alias("w"), _words(_folded("text"), LOW_WORD).alias("lw")).where(F.size("w") > 0)
    items = items.withColumn("size", F.least(F.size("w"), F.lit(window)))
    at = items.select("item_id", "size", "w", "lw", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("p"))
    return at.select("item_id", "size", _loose(F.col("lw"), F.col("p"), F.col("size")).alias("key"), F.array_join(F.slice("w", F.col("p"), F.col("size")), " ").alias("words")).distinct()


def hits(docs: DataFrame, windows: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document with a hit: ``(doc_id, text_hash, covered, items)``; covered are the
    0-based numbers of its hit words, items the distinct ids of the items that occur."""
    sizes = windows.agg(F.count("*"), F.collect_set("size")).first()  # sizes: at most WINDOW numbers
    small = F.broadcast if sizes[0] <= broadcast_windows else (lambda x: x)
    words = docs.select("doc_id", "text", _words(_folded("text"), LOW_WORD).alias("w"))
    sizes = sorted(sizes[1]) or [WINDOW]
    at = words.where(F.size("w") >= sizes[0]).select("doc_id", "text", "w", F.explode(F.sequence(F.lit(1), F.size("w") - sizes[0] + 1)).alias("p"))
    if len(sizes) == 1:
        at = at.withColumn("size", F.lit(sizes[0]))
    else:
        at = at.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("p") + F.col("size") - 1 <= F.size("w"))
    found = at.withColumn("key", _loose(F.col("w"), F.col("p"), F.col("size"))).join(small(windows.select("key", "size").distinct()), ["key", "size"])
    exact = ascii_lower(F.array_join(F.slice(_words(F.col("text"), ANY_WORD), F.col("p"), F.col("size")), " "))
    found = found.select("doc_id", F.xxhash64("text").alias("text_hash"), "p", "size", exact.alias("words")).distinct()
    found = found.join(small(windows.select("size", "words", "item_id")), ["size", "words"])
    span = F.transform(F.collect_set(F.struct("p", "size")), lambda x: F.sequence(x["p"] - 1, x["p"] + x["size"] - 2))
    return found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(span))).alias("covered"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``spans``) without their hit words."""
    if action not in ("documents", "spans"):
        raise ValueError("action is documents or spans")
    key, mine, theirs, covered = fresh(docs, "key", "mine", "theirs", "covered")
    found = hits(docs.select("doc_id", "text"), benchmark_windows(benchmark)).select(F.col("doc_id").alias(key), F.col("text_hash").alias(theirs), F.col("covered").alias(covered))
    both = docs.withColumn(mine, F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mine) == F.col(theirs)), "left")
    if action == "documents":
        return both.where(F.col(covered).isNull()).select(*docs.columns)
    words, gaps = _words(F.col("text"), ANY_WORD), F.split("text", ANY_WORD, -1)
    kept = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.concat(F.get(gaps, i), F.when(F.array_contains(covered, i), "").otherwise(F.get(words, i))))
    text = F.when(F.col(covered).isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), F.element_at(gaps, -1)))
    return both.withColumn("text", text).select(*docs.columns)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select("doc_id", "text")
    base = docs.select("doc_id", F.size(_words(_folded("text"), LOW_WORD)).cast("long").alias("n_words"), F.xxhash64("text").alias("text_hash"))
    found = hits(docs, benchmark_windows(benchmark)).withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return both.select(
        "doc_id", "n_words", F.when(F.col("covered").isNull(), F.lit(0)).otherwise(count("covered")).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), F.lit(0)).otherwise(count("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), F.col("covered").isNotNull().alias("contaminated"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op4_decontaminate": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LOW_WORD}'), []) w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LOW_WORD}'), []) w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') x
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) p FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') x
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) p FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT doc_id, p, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.x = bw.x),
c AS (SELECT doc_id, count(DISTINCT q) n FROM (SELECT doc_id, unnest(range(p, p + k)) q FROM (SELECT DISTINCT doc_id, p, k FROM h)) GROUP BY 1),
i AS (SELECT doc_id, count(*) n, string_agg(s, ',' ORDER BY s) s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(c.n, 0) AS BIGINT) n_hit, CAST(coalesce(i.n, 0) AS BIGINT) n_items,
       sha256(coalesce(i.s, '')) items_sha256, coalesce(c.n, 0) > 0 contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
}
