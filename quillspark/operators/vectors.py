"""Vector scoring and exact retrieval: top-k, two-stage, page scores, lexical scores, rank fusion."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import lexical, tiles


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def score(metric: str, v: Column, q: Column) -> Column:
    """'dot', 'normalised' (only the query is brought to length one; a zero query scores 0) or 'cosine'."""
    if metric == "dot":
        return dot(v, q)
    if metric == "normalised":
        return F.when(norm(q) > 0, dot(v, q) / norm(q)).otherwise(0.0)
    if metric == "cosine":
        return F.when((norm(q) > 0) & (norm(v) > 0), dot(v, q) / (norm(q) * norm(v))).otherwise(0.0)
    raise ValueError(f"unknown metric {metric}")


def _checked(k: int) -> int:
    if k < 1:
        raise ValueError("k has to be at least 1")
    return k


def best(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1.  Spark keeps k rows a group in each partition before it shuffles."""
    _checked(k)
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def scored(vectors: DataFrame, queries: DataFrame, metric: str = "dot", digits: int = 6, scope: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """query_id, id, score of all vectors (id, v) for the stated query set (query_id, q).

    scope: columns that both sides share and that have to be equal.  Vectors of another length than the query's are left out.
    """
    pairs = vectors.join(queries, scope) if scope else vectors.crossJoin(queries)
    return pairs.where(F.size("v") == F.size("q")).select("query_id", "id", *(keep or []), F.round(score(metric, F.col("v"), F.col("q")), digits).alias("score"))


def topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "dot", digits: int = 6, scope: list[str] | None = None, above: float | None = None) -> DataFrame:
    """query_id, id, score, rank of the k best vectors for each query; ties go to the smaller id; above: strict threshold after the cut."""
    of = [c for c in vectors.columns if c in ("id", "v", *(scope or []))]
    pairs = tiles.topk_pairs(vectors.select(*of), queries.select("query_id", "q", *(scope or [])), _checked(k), metric, digits, scope)
    out = best(pairs, ["query_id"], [F.desc("score"), F.asc("id")], k)
    return out if above is None else out.where(F.col("score") > above)


def two_stage(files: DataFrame, chunks: DataFrame, queries: DataFrame, files_k: int = 7, chunks_k: int = 3, above: float = 0.32) -> DataFrame:
    """Best files (id, v) first, then the best chunks (id, file_id, v) of each; the threshold holds after the cut within a file."""
    chosen = topk(files, queries, files_k).select("query_id", F.col("id").alias("file_id"))
    pairs = chunks.join(chosen.join(queries, "query_id"), "file_id")  # files_k rows a query
    ranked = best(pairs.select("query_id", "file_id", "id", F.round(dot("v", "q"), 6).alias("score")), ["query_id", "file_id"], [F.desc("score"), F.asc("id")], chunks_k, "file_rank")
    return ranked.where(F.col("score") > above)


def page_scores(chunk_scores: DataFrame, how: str = "max", digits: int = 6) -> DataFrame:
    """Chunk scores (query_id, page_id, score) to pages, by max, sum or mean."""
    agg = {"max": F.max, "sum": F.sum, "mean": F.avg}[how]
    return chunk_scores.groupBy("query_id", "page_id").agg(F.round(agg("score"), digits).alias("score"))


def tokens(text: str | Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(_col(text)), r"\s+"), lambda w: w != "")


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, digits: int = 6) -> DataFrame:
    """Okapi BM25 of documents (id, text) for queries (query_id, query): query_id, id, score.  Terms count once a query.

    idf = ln(1 + (N - n + 0.5) / (n + 0.5)), which is never negative.
    """
    return lexical.okapi(docs, queries, F.array_distinct(tokens("query")), k1, b, digits)


def tf_overlap(docs: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
    """Share of a document's words that are words of the query: query_id, id, score; empty documents score 0."""
    return lexical.overlap_shares(docs, queries, F.array_distinct(tokens("query")), digits)


def rrf(first: DataFrame, second: DataFrame, k: int = 60, weights: tuple[float, float] = (1.0, 1.0), digits: int = 6) -> DataFrame:
    """Weighted reciprocal rank fusion of two scored lists (query_id, id, score); one missing from a list ranks after its last."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))).alias(name))

    a, b = ranked(first, "ra"), ranked(second, "rb")
    last = a.groupBy("query_id").agg(F.max("ra").alias("na")).join(b.groupBy("query_id").agg(F.max("rb").alias("nb")), "query_id", "full")
    both = a.join(b, ["query_id", "id"], "full").join(last, "query_id")
    ra, rb = F.coalesce("ra", F.coalesce("na", F.lit(0)) + 1), F.coalesce("rb", F.coalesce("nb", F.lit(0)) + 1)
    return both.select("query_id", "id", F.round(weights[0] / (k + ra) + weights[1] / (k + rb), digits).alias("score"))


def full_ranks(scored: DataFrame, name: str, buckets: int = 64) -> DataFrame:
    """The rank of every id in each query's whole list (score first, then id), without one task for a whole list.

    Rows fall into buckets of the score's range, those of the least score into buckets of ids; a rank is the number of rows in the
    buckets before it and the place in its own.
    """
    ends = scored.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.min("id").alias("first"), F.max("id").alias("last"))
    rows = scored.join(ends, "query_id")
    part = lambda x, lo, hi: F.when(hi > lo, F.floor((x - lo) / (hi - lo) * (buckets - 1))).otherwise(0).cast("int")
    lowest = F.col("score") == F.col("lo")
    rows = rows.withColumn("__b", F.when(lowest, buckets + part(F.col("id"), F.col("first"), F.col("last"))).otherwise(buckets - 1 - part(F.col("score"), F.col("lo"), F.col("hi"))))
    counts = rows.groupBy("query_id", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__n", F.coalesce(F.sum("__n").over(Window.partitionBy("query_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 2 * buckets rows a query
    place = F.row_number().over(Window.partitionBy("query_id", "__b").orderBy(F.desc("score"), F.asc("id")))
    return rows.join(before, ["query_id", "__b"]).withColumn(name, (F.col("__n") + place).cast("long")).drop("lo", "hi", "first", "last", "__b", "__n")


def depth(k: int, weights: tuple[float, float], rank_k: int, digits: int) -> int | None:
    """How deep the k best of a fusion can lie in the better of their two lists; None: anywhere.

    The first k of a list alone score weight / (rank_k + k) at least; what lies behind place m in both scores the sum of weights over
    rank_k + m + 1 at most, and rounding moves either by half a unit.
    """
    least = max(weights) / (rank_k + k) - 2 * 10.0**-digits
    if min(weights) < 0 or least <= 0:
        return None
    return max(k, math.ceil(sum(weights) / least) - rank_k)


def hybrid(docs: DataFrame, queries: DataFrame, k: int, weights: tuple[float, float] = (1.0, 1.0), rank_k: int = 60, digits: int = 8) -> DataFrame:
    """Dense and BM25 ranks of docs (id, v, text) over one candidate list for each query (query_id, q, query), fused: the k best.

    Returns query_id, id, score, rank, dense_rank, bm25_rank.  A document without any word of the query has BM25 score 0.
    Only the `depth` first of either list can be among the k best.  Their ranks in the other list are exact: BM25 ranks are made once
    for each distinct text, dense ranks counted tile by tile.
    """
    m = depth(_checked(k), weights, rank_k, digits) or max(k, docs.count())
    texts = queries.select("query").distinct().withColumn("text_id", F.row_number().over(Window.orderBy("query")))  # texts that differ
    asked = queries.join(texts, queries["query"].eqNullSafe(texts["query"])).select("query_id", "q", "text_id", F.size("q").alias("dim"))
    found = None
    for (dim,) in asked.select("dim").where("dim IS NOT NULL").distinct().collect():  # a list has the documents of the query's length
        d, q = docs.where(F.size("v") == dim), asked.where(F.col("dim") == dim).select("query_id", "q", "text_id")
        some = texts.join(q.select("text_id").distinct(), "text_id", "left_semi").select(F.col("text_id").alias("query_id"), "query")
        words = lexical.okapi(d.select("id", "text"), some, F.array_distinct(tokens("query")), 1.5, 0.75, 6, docs, zeros=True).persist(StorageLevel.DISK_ONLY)
        lists = full_ranks(words, "bm25_rank").select(F.col("query_id").alias("text_id"), "id", "bm25_rank").persist(StorageLevel.DISK_ONLY)
        lists.count()  # read three times from here on
        words.unpersist()
        dense = best(tiles.topk_pairs(d.select("id", "v"), q, m), ["query_id"], [F.desc("score"), F.asc("id")], m, "dense_rank")
        first = dense.select("query_id", "text_id", "id", F.col("dense_rank").cast("long").alias("dense_rank")).join(lists, ["text_id", "id"]).select("query_id", "id", "dense_rank", "bm25_rank")
        tops = lists.where(F.col("bm25_rank") <= m)
        scores = q.join(tops.join(d.select("id", "v"), "id"), "text_id").select("query_id", "id", F.round(dot("v", "q"), 6).alias("score"))
        ranks = tiles.ranks_of(d.select("id", "v"), q.select("query_id", "q"), scores)
        second = q.select("query_id", "text_id").join(tops, "text_id").join(ranks, ["query_id", "id"]).select(*first.columns)
        both = first.unionByName(second).dropDuplicates(["query_id", "id"])  # found twice, ranked alike
        found = both if found is None else found.unionByName(both)
    if found is None:
        found = queries.select("query_id").join(docs.select("id"), F.lit(False)).withColumns({"dense_rank": F.lit(0).cast("long"), "bm25_rank": F.lit(0).cast("long")})
    fused = found.withColumn("score", F.round(weights[0] / (rank_k + F.col("dense_rank")) + weights[1] / (rank_k + F.col("bm25_rank")), digits))
    return best(fused, ["query_id"], [F.desc("score"), F.asc("id")], k).select("query_id", "id", "score", "rank", "dense_rank", "bm25_rank")


def overlap_score(query: str | Column, text: str | Column) -> Column:
    """Share of a query's distinct words that a text has: the scorer where no model is at hand."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def rerank(candidates: DataFrame, scorer: Column, k: int, pool: int = 30) -> DataFrame:
    """Keeps a pool by the first score, replaces the score by the scorer's, and takes the k best."""
    kept = best(candidates, ["query_id"], [F.desc("score"), F.asc("id")], max(k, pool), "first_rank")
    return best(kept.withColumn("score", scorer), ["query_id"], [F.desc("score"), F.asc("id")], k)
