"""Benchmark decontamination, all in DataFrame operations: a broadcast hash set of benchmark n-grams meets the corpus.

Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased.  A window is n consecutive words of
an item; an item of fewer words is one window.  Each document's windows are hashed where they stand and probed against
the hashes of all benchmark windows (a broadcast hash set while its size is within a checked bound, a shuffled join
beyond it); a hit is verified on the words themselves.

Defined cases: null or empty texts have no words and no hits; items without words have no window; rows that repeat an
id and text get the same result each; equal windows of several items count for each item; other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

#: Benchmark windows up to which their hash set is broadcast (24 bytes each and their words).
BROADCAST_WINDOWS = 200_000


def words(text: str = "text") -> Column:
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def window_hash(words: Column, start: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, start + k) for k in range(n)])


def benchmark_windows(benchmark: DataFrame, n: int = 8) -> DataFrame:
    """item_id, size, window (the words): the distinct windows of each item."""
    w = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words().alias("w"), F.size(words()).alias("m")).where("m > 0")
    starts = w.select("item_id", "w", F.least("m", F.lit(n)).alias("size"), F.explode(F.sequence(F.lit(1), F.greatest(F.col("m") - (n - 1), F.lit(1)))).alias("at"))
    return starts.select("item_id", "size", F.slice("w", F.col("at"), F.col("size")).alias("window")).distinct()


def keyed(documents: DataFrame) -> DataFrame:
    """Documents by (doc_id, hash of the text): rows that agree in both share their result."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def hits(documents: DataFrame, benchmark: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, text_key, at (0-based word), size, item_id: every occurrence of a benchmark window in a document.

    One pass over the documents probes the hashes of windows of all sizes; words are cut out and compared after a hit only.
    """
    windows = benchmark_windows(benchmark, n)
    sizes = {r["size"]: r["k"] for r in windows.groupBy("size").agg(F.count(F.lit(1)).alias("k")).collect()}  # at most n rows
    small = sum(sizes.values()) <= BROADCAST_WINDOWS
    docs = keyed(documents).select("doc_id", "text_key", words().alias("w"))
    if not sizes:
        return docs.select("doc_id", "text_key", F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("item_id")).where("false")
    own = windows.select("item_id", "size", "window", of_size(sizes, lambda k: F.xxhash64(*[F.get("window", F.lit(j)) for j in range(k)])).alias("h"))
    keys = own.select("size", "h").distinct()
    at = docs.select("doc_id", "text_key", "w", F.posexplode("w").alias("at", "word")).drop("word")
    if len(sizes) > 1:
        at = at.withColumn("size", F.explode(F.lit(sorted(sizes))))
    else:
        at = at.withColumn("size", F.lit(next(iter(sizes))))
    # the last size-1 words of a text start no window
    at = at.where(F.col("at") <= F.size("w") - F.col("size")).withColumn("h", of_size(sizes, lambda k: window_hash(F.col("w"), F.col("at"), k)))
    if small:
        at, own = at.join(F.broadcast(keys), ["size", "h"], "left_semi"), F.broadcast(own)
        at = at.withColumn("window", F.slice("w", F.col("at") + 1, F.col("size")))
    else:  # only hashes travel to the keys; the words of a hit are cut out of its text afterwards, by the row's place
        at = at.select("doc_id", "text_key", "at", "size", "h").join(keys, ["size", "h"], "left_semi")
        texts = docs.dropDuplicates(["doc_id", "text_key"]).withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "t")
        at = at.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
        at = at.withColumn("window", F.slice("w", F.col("at") + 1, F.col("size")))
    return at.join(own, ["size", "h", "window"]).select("doc_id", "text_key", "at", "size", "item_id")


def of_size(sizes, value) -> Column:
    """value(k) of the rows whose size is k."""
    out = None
    for k in sorted(sizes):
        out = F.when(F.col("size") == k, value(k)) if out is None else out.when(F.col("size") == k, value(k))
    return out


def hit_words(found: DataFrame) -> DataFrame:
    """doc_id, text_key, pos: the distinct words inside hits."""
    return found.select("doc_id", "text_key", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("pos")).distinct()


def report(documents: DataFrame, benchmark: DataFrame, n: int = 8, items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of documents."""
    found = Scratch(documents.sparkSession, "decontaminate").save(hits(documents, benchmark, n).distinct(), "found")  # hits only; read twice
    n_hit = hit_words(found).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_hit"))
    by_item = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string"))).alias("items"))
    docs = keyed(documents).select("doc_id", "text_key", F.size(words()).cast("long").alias("n_words"))
    # null ids meet too: <=> keeps the row's own result
    same = lambda t: F.expr(f"d.doc_id <=> {t}.doc_id AND d.text_key = {t}.text_key")
    joined = docs.alias("d").join(by_item.alias("f"), same("f"), "left").join(n_hit.alias("h"), same("h"), "left")
    items_of = F.coalesce("f.items", F.array().cast("array<string>"))
    return joined.select(
        "d.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (F.size(items_of) >= items).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 8, items: int = 2) -> DataFrame:
    """The documents without those that hold windows of `items` or more benchmark items (1: any hit at all); all columns stay.

    Which documents go is written first, so that its size is known: few enough are broadcast, more meet the texts in a shuffle.
    """
    found = hits(documents, benchmark, n).select("doc_id", "text_key", "item_id").distinct()
    bad = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= items).select("doc_id", "text_key")
    bad = Scratch(documents.sparkSession, "decontaminate").save(bad, "bad")
    return documents.alias("d").join(bad.alias("b"), (F.col("d.doc_id").cast("long").eqNullSafe(F.col("b.doc_id"))) & (F.xxhash64("d.text") == F.col("b.text_key")), "left_anti")


ORACLE_SQL = r"""
WITH w0 AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b0 AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, least(len(w), 8) AS size, array_to_string(w[s:s + 7], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS s FROM b0 WHERE len(w) > 0)),
d AS (SELECT rid, s, k AS size, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM w0, (SELECT DISTINCT size AS k FROM b))),
h AS (SELECT d.rid, d.s, d.size, b.item_id FROM d JOIN b ON d.g = b.g AND d.size = b.size),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + size - 1)) AS pos FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT w0.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w0 LEFT JOIN p USING (rid) LEFT JOIN i USING (rid)
"""
