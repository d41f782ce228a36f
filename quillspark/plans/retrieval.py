"""Retrieval and evaluation queries over embeddings, documents and benchmark."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import evaluate as E, tiles as T, vectors as V
from ..sources.tables import table
from .catalogue import query

DOT = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
PAIRS = f"s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, round({DOT}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.embedding IS NOT NULL)"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"
WORDS = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> '')"


def _vectors(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _queries(spark, d):
    """The stated query set: every vector whose id is divisible by 20."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _pages(spark, d, how, digits=6):
    """Pages scored by their chunks: four vectors of a label make a page."""
    v = _vectors(spark, d).withColumn("page_id", F.concat_ws("/", F.col("label").cast("string"), (F.col("id") / 4).cast("long").cast("string")))
    return T.page_pairs(v, _queries(spark, d), how, digits)


PAGES = f"{PAIRS}, p AS (SELECT query_id, CAST(label AS VARCHAR) || '/' || CAST(id // 4 AS VARCHAR) AS page_id, score FROM s)"


@query(f"WITH {PAIRS} SELECT query_id, id, score, CAST({RANK} AS INTEGER) AS rank FROM s QUALIFY {RANK} <= 5")
def vec_topk_dot(spark, d):
    return V.topk(_vectors(spark, d).select("id", "v"), _queries(spark, d), 5)


@query(f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({DOT} / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) SELECT query_id, id, score, CAST({RANK} AS INTEGER) AS rank FROM s QUALIFY {RANK} <= 10")
def vec_topk_normalised(spark, d):
    return V.topk(_vectors(spark, d).select("id", "v"), _queries(spark, d), 10, "normalised")


@query(f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) SELECT query_id, id, score, CAST({RANK} AS INTEGER) AS rank FROM s QUALIFY {RANK} <= 10")
def vec_topk_cosine(spark, d):
    return V.topk(_vectors(spark, d).select("id", "v"), _queries(spark, d), 10, "cosine")


@query(f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({DOT}, 6) AS score FROM embeddings e JOIN embeddings q ON e.label = q.label WHERE q.vec_id % 20 = 0) SELECT query_id, id, score, CAST({RANK} AS INTEGER) AS rank FROM s QUALIFY {RANK} <= 5")
def vec_topk_scoped(spark, d):
    q = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    return V.topk(_vectors(spark, d), q, 5, scope=["label"])


@query(f"WITH {PAIRS}, r AS (SELECT query_id, id, score, CAST({RANK} AS INTEGER) AS rank FROM s QUALIFY {RANK} <= 7) SELECT * FROM r WHERE score > 0.32")
def vec_topk_threshold(spark, d):
    return V.topk(_vectors(spark, d).select("id", "v"), _queries(spark, d), 7, above=0.32)


@query(f"""WITH {PAIRS}, f AS (SELECT query_id, id AS file_id FROM s WHERE id % 10 = 0 QUALIFY {RANK} <= 7),
c AS (SELECT s.query_id, f.file_id, s.id, s.score FROM s JOIN f ON s.query_id = f.query_id AND s.id // 10 * 10 = f.file_id)
SELECT query_id, file_id, id, score, CAST(row_number() OVER (PARTITION BY query_id, file_id ORDER BY score DESC, id) AS INTEGER) AS file_rank FROM c
QUALIFY row_number() OVER (PARTITION BY query_id, file_id ORDER BY score DESC, id) <= 3 AND score > 0.1""")
def vec_two_stage(spark, d):
    v = _vectors(spark, d)
    files = v.where("id % 10 = 0").select("id", "v")
    return V.two_stage(files, v.select("id", "v", (F.col("id") - F.col("id") % 10).alias("file_id")), _queries(spark, d), above=0.1)


@query(f"WITH {PAGES} SELECT query_id, page_id, round(max(score), 6) AS score FROM p GROUP BY ALL")
def vec_page_max(spark, d):
    return _pages(spark, d, "max")


@query(f"WITH {PAGES} SELECT query_id, page_id, round(sum(score), 6) AS score FROM p GROUP BY ALL")
def vec_page_sum(spark, d):
    return _pages(spark, d, "sum")


@query(f"WITH {PAGES} SELECT query_id, page_id, round(avg(score), 8) AS score FROM p GROUP BY ALL")
def vec_page_mean(spark, d):
    return _pages(spark, d, "mean", 8)


@query("SELECT len(embedding) AS dim, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY ALL ORDER BY n DESC, dim LIMIT 1")
def vec_modal_dim(spark, d):
    return table(spark, d, "embeddings").where("embedding IS NOT NULL").groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1)


def _bm25_inputs(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


BM25 = f"""w AS (SELECT doc_id AS id, {WORDS.format('text')} AS w FROM documents), t AS (SELECT item_id AS query_id, unnest(list_distinct({WORDS.format('text')})) AS term FROM benchmark),
z AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w), u AS (SELECT id, len(w) AS length, unnest(w) AS term FROM w), tf AS (SELECT id, length, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN t USING (term), z GROUP BY ALL)"""


@query(f"WITH {BM25} SELECT query_id, id, score FROM b")
def bm25_okapi(spark, d):
    return V.bm25(*_bm25_inputs(spark, d))


@query(f"""WITH w AS (SELECT doc_id AS id, {WORDS.format('text')} AS w FROM documents), q AS (SELECT item_id AS query_id, list_distinct({WORDS.format('text')}) AS t FROM benchmark)
SELECT query_id, id, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(t, x))) / len(w) ELSE 0.0 END, 6) AS score FROM w, q""")
def tf_overlap(spark, d):
    return V.tf_overlap(*_bm25_inputs(spark, d))


# queries with a vector and a text: a benchmark item for each vector whose id is divisible by 20
HYBRID = f"""n AS (SELECT count(*) AS n FROM benchmark), q AS (SELECT e.vec_id AS query_id, e.embedding AS q, b.text AS query FROM embeddings e, n JOIN benchmark b ON b.item_id = (e.vec_id // 20) % n.n WHERE e.vec_id % 20 = 0),
d AS (SELECT doc_id AS id, embedding AS v, text, {WORDS.format('text')} AS w FROM embeddings JOIN documents ON doc_id = vec_id),
t AS (SELECT query_id, unnest(list_distinct({WORDS.format('query')})) AS term FROM q), z AS (SELECT count(*) AS nd, avg(len(w)) AS mean FROM d), u AS (SELECT id, len(w) AS length, unnest(w) AS term FROM d),
tf AS (SELECT id, length, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
l AS (SELECT query_id, id, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN t USING (term), z GROUP BY ALL),
s AS (SELECT query_id, id, query, text, round(list_dot_product(CAST(v AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS dense, coalesce(l.score, 0) AS lexical FROM d CROSS JOIN q LEFT JOIN l USING (query_id, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, id) AS dense_rank, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, id) AS bm25_rank FROM s),
f AS (SELECT *, round(1.0 / (60 + dense_rank) + 1.0 / (60 + bm25_rank), 8) AS score FROM r)"""


def _hybrid_inputs(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("query"))
    n = items.agg(F.count(F.lit(1)).alias("n"))
    q = _queries(spark, d).crossJoin(F.broadcast(n))  # one row
    q = q.join(items, F.col("item") == F.expr("(query_id div 20) % n")).select("query_id", "q", "query")
    docs = _vectors(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").select("id", "v", "text")
    return docs, q


@query(f"WITH {HYBRID} SELECT query_id, id, score, CAST({RANK} AS INTEGER) AS rank, dense_rank, bm25_rank FROM f QUALIFY {RANK} <= 7")
def rrf_fusion(spark, d):
    return V.hybrid(*_hybrid_inputs(spark, d), 7)


@query(f"""WITH {HYBRID}, p AS (SELECT query_id, id, query, text, {RANK} AS first_rank FROM f QUALIFY {RANK} <= 30),
x AS (SELECT query_id, id, CAST(first_rank AS INTEGER) AS first_rank, round(len(list_intersect(list_distinct({WORDS.format('query')}), {WORDS.format('text')})) / len(list_distinct({WORDS.format('query')})), 6) AS score FROM p)
SELECT query_id, id, score, first_rank, CAST({RANK} AS INTEGER) AS rank FROM x QUALIFY {RANK} <= 5""")
def vec_rerank_pool(spark, d):
    docs, q = _hybrid_inputs(spark, d)
    pool = V.hybrid(docs, q, 30).select("query_id", "id", "score").join(docs.select("id", "text"), "id").join(q.select("query_id", "query"), "query_id")
    return V.rerank(pool, F.round(V.overlap_score("query", "text"), 6), 5).select("query_id", "id", "score", "first_rank", "rank")


# ---- evaluation: queries are the vectors with ids divisible by 20, gold is another vector of the query's label

RETRIEVED = f"""s AS (SELECT q.vec_id AS query_id, q.label AS gold, e.vec_id AS id, e.label, round({DOT}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT query_id, gold, id, label, score, {RANK} AS rank FROM s QUALIFY {RANK} <= 10), h AS (SELECT query_id, gold, min(CASE WHEN label = gold THEN rank END) AS first FROM r GROUP BY ALL)"""


def _retrieved(spark, d):
    v = _vectors(spark, d)
    q = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("gold"))
    pairs = T.topk_pairs(v, q, 10, other=True)
    return V.best(pairs, ["query_id"], [F.desc("score"), F.asc("id")], 10)


@query(f"WITH {RETRIEVED} SELECT k, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0 END), 4) AS recall, round(avg(CASE WHEN first <= k THEN 1.0 / first ELSE 0 END), 4) AS mrr, count(*) AS n FROM h, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k")
def recall_mrr_by_k(spark, d):
    return E.metrics_by_k(E.first_hits(_retrieved(spark, d), ["query_id", "gold"], F.col("label") == F.col("gold")), [1, 3, 5, 10])


@query(f"WITH {RETRIEVED} SELECT CASE WHEN gold = 0 THEN '_unknown_' ELSE CAST(gold AS VARCHAR) END AS grp, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 4) AS recall, round(avg(CASE WHEN first <= 5 THEN 1.0 / first ELSE 0 END), 4) AS mrr, count(*) AS n FROM h GROUP BY 1")
def recall_by_group(spark, d):
    hits = E.first_hits(_retrieved(spark, d), ["query_id", "gold"], F.col("label") == F.col("gold"))
    return E.metrics(hits.withColumn("grp", E.group_key(F.when(F.col("gold") != 0, F.col("gold").cast("string")))), 5, ["grp"])


@query(f"""WITH {RETRIEVED}, x AS (SELECT query_id, first, d.text AS top_text, CASE WHEN query_id % 2 = 0 THEN d.text ELSE 'no such answer' END AS said FROM h JOIN r USING (query_id, gold) JOIN documents d ON d.doc_id = r.id WHERE r.rank = 1),
c AS (SELECT CASE WHEN first IS NULL THEN 'retrieval_miss' WHEN trim(top_text) <> '' AND length(trim(top_text)) < 80 THEN 'ocr_loss' WHEN trim(top_text) <> '' THEN 'vlm_noise' ELSE 'answer_miss' END AS category FROM x WHERE NOT (first IS NOT NULL AND contains(lower(trim(said)), lower(trim(top_text)))))
SELECT category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM c GROUP BY category""")
def error_taxonomy(spark, d):
    got = _retrieved(spark, d)
    first = E.first_hits(got, ["query_id", "gold"], F.col("label") == F.col("gold"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("top_text"))
    x = first.join(got.where("rank = 1").select("query_id", "id"), "query_id").join(docs, "id")
    x = x.withColumn("said", F.when(F.col("query_id") % 2 == 0, F.col("top_text")).otherwise("no such answer"))
    wrong = x.where(~(F.col("first").isNotNull() & E.contains_answer(F.col("said"), F.col("top_text"))))
    return E.shares(wrong.select(E.classify_error(F.col("first").isNotNull(), F.col("top_text")).alias("category")), "category")


@query("SELECT round(avg(CASE WHEN trim(b.text) = '' OR contains(lower(trim(d.text)), lower(trim(b.text))) THEN 1.0 ELSE 0 END), 6) AS rate, count(*) AS n FROM documents d, (SELECT count(*) AS n FROM benchmark) z JOIN benchmark b ON b.item_id = d.doc_id % z.n")
def contains_answer_rate(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("gold"))
    docs = table(spark, d, "documents").crossJoin(F.broadcast(items.agg(F.count(F.lit(1)).alias("n_items"))))  # one row
    pairs = docs.withColumn("item_id", F.col("doc_id") % F.col("n_items")).join(items, "item_id")
    return pairs.agg(F.round(F.avg(E.contains_answer(F.col("text"), F.col("gold")).cast("double")), 6).alias("rate"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {RETRIEVED} SELECT round(avg(CASE WHEN rank = 1 AND label = gold THEN 1.0 WHEN rank = 1 THEN 0 END), 4) AS top1, (SELECT round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1.0 END), 4) FROM h) AS topk FROM r")
def lecture_accuracy(spark, d):
    r = _retrieved(spark, d)
    top = r.agg(F.round(F.avg(F.when(F.col("rank") == 1, (F.col("label") == F.col("gold")).cast("double"))), 4).alias("top1"))
    return top.crossJoin(E.first_hits(r, ["query_id"], F.col("label") == F.col("gold")).agg(F.round(F.avg(F.col("first").isNotNull().cast("double")), 4).alias("topk")))


@query(f"WITH {RETRIEVED}, c AS (SELECT id, label, count(*) AS n FROM r WHERE rank = 1 GROUP BY ALL) SELECT id, label, n, round(n / (SELECT sum(n) FROM c), 4) AS share, n / (SELECT sum(n) FROM c) > 0.1 AS flagged FROM c ORDER BY n DESC, id LIMIT 5")
def top_attractors(spark, d):
    return E.attractors(_retrieved(spark, d).where("rank = 1"), ["id", "label"], 5)


# pages: a lecture is a label, a page number the id modulo 50; gold is the page after the query's own
@query(f"""WITH {RETRIEVED}, g AS (SELECT query_id, label = gold AND id % 50 = (query_id + 1) % 50 AS hit, label = gold AND abs(id % 50 - (query_id + 1) % 50) <= 1 AS near FROM r),
m AS (SELECT query_id, bool_or(near) AS near FROM g GROUP BY query_id HAVING NOT bool_or(hit)) SELECT count(*) FILTER (near) AS near, count(*) AS misses, round(coalesce(count(*) FILTER (near) / nullif(count(*), 0), 0), 4) AS near_miss_rate FROM m""")
def near_miss_rate(spark, d):
    r = _retrieved(spark, d).withColumn("page", (F.col("id") % 50).cast("int"))
    return E.near_misses(r, F.array(((F.col("query_id") + 1) % 50).cast("int")), F.col("label") == F.col("gold"))


@query(f"WITH {RETRIEVED} SELECT query_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids, string_agg(CASE WHEN label = gold THEN '1' ELSE '0' END, '' ORDER BY rank) AS hits FROM r GROUP BY query_id")
def prediction_dump(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", (F.col("label") == F.col("gold")).alias("hit"))))
    return _retrieved(spark, d).groupBy("query_id").agg(rows.alias("r")).select("query_id", F.array_join(F.transform("r", lambda x: x["id"].cast("string")), ",").alias("ids"), F.array_join(F.transform("r", lambda x: F.when(x["hit"], "1").otherwise("0")), "").alias("hits"))


@query(f"WITH {RETRIEVED}, g AS (SELECT query_id % 3 AS variant, k, round(avg(CASE WHEN first <= k THEN 1.0 / first ELSE 0 END), 4) AS mrr FROM h, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY ALL) SELECT variant, k, mrr FROM g QUALIFY row_number() OVER (PARTITION BY variant ORDER BY mrr DESC, k) = 1")
def sweep_best_cell(spark, d):
    hits = E.first_hits(_retrieved(spark, d), ["query_id"], F.col("label") == F.col("gold")).withColumn("variant", F.col("query_id") % 3)
    cells = E.metrics_by_k(hits, [1, 3, 5, 10], ["variant"]).select("variant", "k", "mrr")
    return cells.withColumn("__r", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("mrr"), "k"))).where("__r = 1").drop("__r")


@query("SELECT lang, least(count(*), 25) AS n FROM documents GROUP BY lang")
def stratified_sample_sizes(spark, d):
    return E.stratified(table(spark, d, "documents"), "lang", "doc_id", 25, seed=3).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS total FROM s) SELECT source, CAST(least(n, greatest(5, CAST(floor(200.0 * n / total) AS BIGINT))) AS BIGINT) AS n FROM s, t")
def proportional_sample_sizes(spark, d):
    return E.proportional(table(spark, d, "documents"), "source", "doc_id", 200, least=5).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RETRIEVED} SELECT r.query_id, r.id, regexp_replace(regexp_replace(substr(d.text, 1, 240), '\\n', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS snippet, d.source FROM r JOIN documents d ON d.doc_id = r.id WHERE rank = 1")
def topk_with_payload(spark, d):
    top = _retrieved(spark, d).where("rank = 1").select("query_id", "id")
    snippet = F.regexp_replace(F.regexp_replace(F.substring("text", 1, 240), "\n", " "), r"^\s+|\s+\z", "")
    return top.join(table(spark, d, "documents"), F.col("doc_id") == F.col("id")).select("query_id", "id", snippet.alias("snippet"), "source")


@query(f"""WITH {RETRIEVED} SELECT query_id, first, CASE WHEN first IS NULL THEN 'retrieval_miss' WHEN trim(d.text) <> '' AND length(trim(d.text)) < 80 THEN 'ocr_loss' WHEN trim(d.text) <> '' THEN 'vlm_noise' ELSE 'answer_miss' END AS category
FROM h JOIN r USING (query_id, gold) JOIN documents d ON d.doc_id = r.id WHERE r.rank = 1 AND (first IS NULL OR first > 3)""")
def error_records(spark, d):
    got = _retrieved(spark, d)
    first = E.first_hits(got, ["query_id", "gold"], F.col("label") == F.col("gold"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    x = first.join(got.where("rank = 1").select("query_id", "id"), "query_id").join(docs, "id").where("first IS NULL OR first > 3")
    return x.select("query_id", "first", E.classify_error(F.col("first").isNotNull(), F.col("text")).alias("category"))


@query(f"WITH {RETRIEVED} SELECT 'v' || CAST(query_id // 20 % 3 + 1 AS VARCHAR) AS variant, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 4) AS recall, round(avg(CASE WHEN first <= 5 THEN 1.0 / first ELSE 0 END), 4) AS mrr, count(*) AS n FROM h GROUP BY 1")
def evaluate_variants(spark, d):
    hits = E.first_hits(_retrieved(spark, d), ["query_id", "gold"], F.col("label") == F.col("gold"))
    return E.metrics(hits.withColumn("variant", F.concat(F.lit("v"), F.expr("query_id div 20 % 3 + 1").cast("string"))), 5, ["variant"])


@query(f"WITH {RETRIEVED} SELECT query_id, bool_or(rank <= 3 AND list_contains([gold], label)) AS hit FROM r GROUP BY query_id")
def hits_at_three(spark, d):
    lists = _retrieved(spark, d).groupBy("query_id", "gold").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"] + 1).alias("pages"))
    return lists.select("query_id", E.hits_at_k(F.col("pages"), F.array("gold"), 3).alias("hit"))  # page numbers count from 1, gold pages from 0
