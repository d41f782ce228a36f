"""Retrieval evaluation: hits, recall, reciprocal rank, answers, errors, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import vectors as V


def first_hits(ranked: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """by, first: the best rank among hits, null for none."""
    return ranked.groupBy(*by).agg(F.min(F.when(hit, F.col("rank"))).alias("first"))


def hits_at_k(pages: Column, gold: Column, k: int, page_base: int = 1) -> Column:
    """Whether any of the first k page numbers, brought to base 0, is in gold; empty lists: no."""
    return F.coalesce(F.exists(F.slice(pages, 1, k), lambda p: F.array_contains(gold, p - page_base)), F.lit(False))


def group_key(key: Column) -> Column:
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("_unknown_"))


def metrics(hits: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Recall and mean reciprocal rank at k of each group; 0 where there is nothing."""
    inside = F.col("first") <= k
    return hits.groupBy(*by).agg(
        F.round(F.coalesce(F.avg(F.when(inside, 1.0).otherwise(0.0)), F.lit(0.0)), 4).alias("recall"),
        F.round(F.coalesce(F.avg(F.when(inside, 1 / F.col("first")).otherwise(0.0)), F.lit(0.0)), 4).alias("mrr"),
        F.count(F.lit(1)).alias("n"),
    )


def metrics_by_k(hits: DataFrame, ks: list[int], by: list[str] | None = None) -> DataFrame:
    """One row for each k (and group), in one pass."""
    rows = hits.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    inside = F.col("first") <= F.col("k")
    return rows.groupBy(*(by or []), "k").agg(F.round(F.avg(F.when(inside, 1.0).otherwise(0.0)), 4).alias("recall"), F.round(F.avg(F.when(inside, 1 / F.col("first")).otherwise(0.0)), 4).alias("mrr"), F.count(F.lit(1)).alias("n"))


def contains_answer(said: Column, gold: Column) -> Column:
    """Case-blind and trimmed; an empty gold answer is always there."""
    return (F.trim(gold) == "") | F.lower(F.trim(said)).contains(F.lower(F.trim(gold)))


def classify_error(hit: Column, top_text: Column) -> Column:
    text = F.trim(top_text)
    return F.when(~hit, "retrieval_miss").when((text != "") & (F.length(text) < 80), "ocr_loss").when(text != "", "vlm_noise").otherwise("answer_miss")


def shares(rows: DataFrame, key: str) -> DataFrame:
    """key, n, percent of all.  The keys are few: the total is taken over their counts."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select(key, "n", F.round(100.0 * F.col("n") / F.col("__all"), 2).alias("percent"))


def attractors(top: DataFrame, by: list[str], k: int) -> DataFrame:
    """The most frequent first results, with their share; more than a tenth is flagged."""
    counts = top.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    share = F.col("n") / F.col("__all")
    return counts.crossJoin(F.broadcast(total)).select(*by, "n", F.round(share, 4).alias("share"), (share > 0.1).alias("flagged")).orderBy(F.desc("n"), by[0]).limit(k)


def stratified(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each stratum, in a fixed pseudo-random order."""
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def proportional(rows: DataFrame, by: str, key: str, n: int, least: int = 5, seed: int = 0) -> DataFrame:
    """About n rows in all, each group by its share and at least `least` (as far as it has them)."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    quota = counts.crossJoin(F.broadcast(counts.agg(F.sum("__n").alias("__all")))).select(by, F.greatest(F.lit(least), F.floor(F.lit(float(n)) * F.col("__n") / F.col("__all"))).alias("__q"))
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return rows.withColumn("__r", F.row_number().over(w)).join(quota, by).where("__r <= __q").drop("__r", "__q")


def near_misses(retrieved: DataFrame, gold_pages: Column, same_lecture: Column) -> DataFrame:
    """near, misses, near_miss_rate: queries without a gold page among their results (query_id, page), and those of them with a
    page of the right lecture next to a gold one."""
    hit = same_lecture & F.array_contains(gold_pages, F.col("page"))
    near = same_lecture & F.exists(gold_pages, lambda g: F.abs(F.col("page") - g) <= 1)
    missed = retrieved.select("query_id", hit.alias("hit"), near.alias("near")).groupBy("query_id").agg(F.bool_or("hit").alias("hit"), F.bool_or("near").alias("near")).where("NOT hit")
    out = missed.agg(F.count(F.when(F.col("near"), 1)).alias("near"), F.count(F.lit(1)).alias("misses"))
    return out.withColumn("near_miss_rate", F.round(F.coalesce(F.try_divide("near", "misses"), F.lit(0.0)), 4))


def abstained(cited: Column, retrieved: Column) -> Column:
    """An answer none of whose citations is a retrieved page abstains."""
    return F.size(F.array_intersect(cited, retrieved)) == 0


def diagnosis(retrieved: DataFrame, by: str, gold_page: Column, same_lecture: Column, k: int = 5, most: int = 5) -> DataFrame:
    """One row a variant: queries, top-1 and top-k lecture hits, misses and near misses, and the pages that come first most often."""
    rows = retrieved.withColumns({"__same": same_lecture, "__off": F.col("page") - gold_page})
    each = rows.groupBy(by, "query_id").agg(
        F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("__same"))), F.lit(False)).alias("top1"),
        F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("__same"))), F.lit(False)).alias("topk"),
        F.max(F.col("__same") & (F.col("__off") == 0)).alias("hit"),
        F.max(F.col("__same") & (F.abs("__off") <= 1)).alias("near"),
    )
    n = lambda c: F.count(F.when(c, 1))
    sums = each.groupBy(by).agg(F.count(F.lit(1)).alias("n"), n(F.col("top1")).alias("top1_lecture"), n(F.col("topk")).alias("topk_lecture"), n(~F.col("hit")).alias("misses"), n(~F.col("hit") & F.col("near")).alias("near_misses"))
    tops = retrieved.where("rank = 1").groupBy(by, "id").agg(F.count(F.lit(1)).alias("times"))
    tops = V.best(tops, [by], [F.desc("times"), F.asc("id")], most, "__place")
    tops = tops.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", "id", "times"))), lambda x: F.concat_ws(":", x["id"], x["times"])).alias("attractors"))
    return sums.join(tops, by, "left")
