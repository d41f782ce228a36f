"""Store, data-quality and catalogue queries.  Files are documents, chunks their lines, courses their sources."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..operators import quality as Q, store as S
from ..sources.tables import table
from .catalogue import query

FILES = "f AS (SELECT doc_id AS uuid, source AS course_code, lang AS category, n_chars, sha256(text) AS file_hash, source || '/' || CASE doc_id % 3 WHEN 0 THEN 'practice/hw' WHEN 1 THEN 'study/notes' ELSE 'misc' END || '/' || lang || '/file_' || CAST(doc_id AS VARCHAR) || '.md' AS path FROM documents)"
CHUNKS = "c0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), c AS (SELECT doc_id AS file_uuid, line AS text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS chunk_index FROM c0 WHERE trim(line) <> '')"


def files(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "practice/hw").when(F.col("doc_id") % 3 == 1, "study/notes").otherwise("misc")
    return table(spark, d, "documents").select(F.col("doc_id").alias("uuid"), F.col("source").alias("course_code"), F.col("lang").alias("category"), "n_chars", F.sha2("text", 256).alias("file_hash"), F.concat("source", F.lit("/"), kind, F.lit("/"), "lang", F.lit("/file_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))


def chunks(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("file_uuid"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("l"))
    return lines.select("file_uuid", F.posexplode("l").alias("p", "text")).select("file_uuid", "text", (F.col("p") + 1).cast("long").alias("chunk_index"))


@query(f"WITH {FILES} SELECT uuid, course_code, CASE WHEN uuid % 7 = 0 THEN -1 ELSE n_chars END AS n_chars, CASE WHEN uuid % 7 = 0 THEN NULL ELSE file_hash END AS file_hash, category FROM f UNION ALL SELECT uuid + 1000000, 'new', -1, NULL, NULL FROM f WHERE uuid % 7 = 0 AND uuid % 2 = 1")
def upsert_files(spark, d):
    t = files(spark, d).select("uuid", "course_code", "n_chars", "file_hash", "category")
    seven = t.where("uuid % 7 = 0")
    new = seven.where("uuid % 2 = 1").select((F.col("uuid") + 1000000).alias("uuid"), F.lit("new").alias("course_code"), F.lit(-1).cast("long").alias("n_chars"), F.lit(None).cast("string").alias("file_hash"))
    source = seven.select("uuid", "course_code", F.lit(-1).cast("long").alias("n_chars"), F.lit(None).cast("string").alias("file_hash")).unionByName(new)
    return S.upsert(t, source, ["uuid"])


@query(f"WITH {FILES} SELECT uuid, CASE WHEN uuid % 5 = 0 THEN 'source' ELSE 'target' END AS note, 'target' AS created FROM f")
def upsert_keeping_created(spark, d):
    t = files(spark, d).select("uuid", F.lit("target").alias("note"), F.lit("target").alias("created"))
    return S.upsert(t, t.where("uuid % 5 = 0").select("uuid", F.lit("source").alias("note"), F.lit("source").alias("created")), ["uuid"], keep=("created",))


@query(f"WITH {FILES}, m AS (SELECT DISTINCT course_code, category FROM f) SELECT course_code, category, 'old' AS origin FROM m WHERE category <> 'es' UNION ALL SELECT course_code, category, 'new' FROM m WHERE category = 'es'")
def insert_absent_modules(spark, d):
    m = files(spark, d).select("course_code", "category").distinct()
    return S.insert_absent(m.where("category <> 'es'").withColumn("origin", F.lit("old")), m.withColumn("origin", F.lit("new")), ["course_code", "category"])


@query(f"WITH {FILES}, {CHUNKS} SELECT 'file' AS tab, count(*) AS n FROM f WHERE course_code <> 'src0' UNION ALL SELECT 'chunks', count(*) FROM c JOIN f ON c.file_uuid = f.uuid WHERE course_code <> 'src0'")
def delete_course_cascade(spark, d):
    out = S.delete_cascade(files(spark, d), {"chunks": (chunks(spark, d), "file_uuid")}, F.col("course_code") == "src0", "uuid")
    return out["parents"].select(F.lit("file").alias("tab")).unionAll(out["chunks"].select(F.lit("chunks").alias("tab"))).groupBy("tab").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES}, {CHUNKS} SELECT file_uuid, count(*) AS n FROM c JOIN f ON c.file_uuid = f.uuid WHERE course_code = 'src1' GROUP BY file_uuid")
def split_course(spark, d):
    return S.split_off(files(spark, d), {"chunks": (chunks(spark, d), "file_uuid")}, F.col("course_code") == "src1", "uuid")["chunks"].groupBy("file_uuid").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES} SELECT uuid, course_code, n_chars, CAST(NULL AS VARCHAR) AS note FROM f WHERE course_code NOT IN ('src2', 'src3') UNION ALL SELECT uuid, course_code, 0, 'merged' FROM f WHERE course_code = 'src2' AND uuid % 2 = 0 UNION ALL SELECT uuid, course_code, NULL, 'short' FROM f WHERE course_code = 'src3'")
def merge_sources(spark, d):
    t = files(spark, d).select("uuid", "course_code", "n_chars")
    a = t.where("course_code = 'src2' AND uuid % 2 = 0").select("uuid", "course_code", F.lit(0).cast("long").alias("n_chars"), F.lit("merged").alias("note"))
    b = t.where("course_code = 'src3'").select("uuid", "course_code", F.lit("short").alias("note"))
    return S.replace_groups(t, [a, b], "course_code").select("uuid", "course_code", "n_chars", "note")


@query(f"WITH {FILES} SELECT count(*) AS files, sum(CASE WHEN path LIKE '%/practice/%' THEN 1 ELSE 0 END)::BIGINT AS matching FROM f")
def cleanup_pattern_dry_run(spark, d):
    return files(spark, d).agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("path").like("%/practice/%").cast("long")).alias("matching"))


@query(f"WITH {FILES} SELECT uuid FROM f WHERE path NOT IN (SELECT path FROM f WHERE uuid % 4 = 0)")
def cleanup_vanished_files(spark, d):
    f = files(spark, d)
    listing = f.where("uuid % 4 <> 0").select("path")
    return f.join(listing, "path", "left_semi").select("uuid")


@query(f"WITH {FILES}, l AS (SELECT file_hash, CASE WHEN uuid % 6 = 0 THEN 'moved/' || path ELSE path END AS path FROM f), n AS (SELECT file_hash, min(path) AS np FROM l GROUP BY file_hash) SELECT uuid, file_hash, CASE WHEN path NOT IN (SELECT path FROM l) AND np IS NOT NULL THEN np ELSE path END AS path FROM f LEFT JOIN n USING (file_hash)")
def path_update_on_move(spark, d):
    f = files(spark, d).select("uuid", "file_hash", "path")
    return S.moved_paths(f, f.select("file_hash", F.when(F.col("uuid") % 6 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path")))


@query(f"WITH {FILES} SELECT file_hash, count(DISTINCT uuid) AS owners FROM f GROUP BY file_hash HAVING count(DISTINCT uuid) > 1")
def hash_conflict_guard(spark, d):
    return S.conflicts(files(spark, d))


# ---- data quality

STORE = "e AS (SELECT vec_id AS chunk_uuid, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CAST(vec_id % 97 AS BIGINT) END AS file_uuid, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE label END AS label, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE embedding END AS vector FROM embeddings)"


def store(spark, d):
    i = F.col("vec_id")
    return table(spark, d, "embeddings").select(i.alias("chunk_uuid"), F.when(i % 11 != 0, i % 97).alias("file_uuid"), F.when(i % 5 != 0, F.col("label")).alias("label"), F.when(i % 4 != 0, F.col("embedding")).alias("vector"))


@query(f"WITH {STORE}, a AS (SELECT 'chunk_uuid' AS col, count(*) AS total, count(*) - count(chunk_uuid) AS nulls FROM e UNION ALL SELECT 'file_uuid', count(*), count(*) - count(file_uuid) FROM e UNION ALL SELECT 'label', count(*), count(*) - count(label) FROM e UNION ALL SELECT 'vector', count(*), count(*) - count(vector) FROM e) SELECT col, total, nulls, total - nulls AS non_null, nulls = total AS all_null, round(100.0 * nulls / total, 2) AS null_percent, 100.0 * nulls / total > 90 AS warned FROM a")
def null_profile(spark, d):
    return Q.null_profile(store(spark, d))


@query(f"WITH {FILES} SELECT file_hash, count(*) AS n FROM f GROUP BY file_hash HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return Q.duplicates(files(spark, d), "file_hash")


@query(f"WITH {STORE} SELECT chunk_uuid FROM e LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id < 60) p ON e.file_uuid = p.doc_id WHERE p.doc_id IS NULL")
def orphaned_chunks(spark, d):
    return Q.orphans(store(spark, d), "file_uuid", table(spark, d, "documents").where("doc_id < 60"), "doc_id").select("chunk_uuid")


@query(f"WITH {STORE} SELECT count(*) AS n FROM e WHERE file_uuid NOT IN (SELECT doc_id FROM documents WHERE doc_id < 60)")
def orphans_three_valued(spark, d):
    return Q.orphans(store(spark, d).where("file_uuid IS NOT NULL"), "file_uuid", table(spark, d, "documents").where("doc_id < 60"), "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STORE} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT file_uuid FROM e WHERE file_uuid IS NOT NULL)")
def files_without_chunks(spark, d):
    return table(spark, d, "documents").join(store(spark, d), F.col("doc_id") == F.col("file_uuid"), "left_anti").select("doc_id")


@query(f"WITH {STORE} SELECT DISTINCT doc_id, lang, CAST(label AS VARCHAR) AS label FROM e JOIN documents ON doc_id = file_uuid WHERE CASE WHEN label % 2 = 0 THEN lang ELSE CAST(label AS VARCHAR) END IS DISTINCT FROM lang")
def mismatch_nullsafe(spark, d):
    j = store(spark, d).join(table(spark, d, "documents"), F.col("doc_id") == F.col("file_uuid"))
    other = F.when(F.col("label") % 2 == 0, F.col("lang")).otherwise(F.col("label").cast("string"))
    return Q.mismatched(j, other, F.col("lang")).select("doc_id", "lang", F.col("label").cast("string").alias("label")).distinct()


@query(f"WITH {STORE} SELECT count(*) AS total, count(vector) AS embedded, count(*) - count(vector) AS pending, round(100.0 * count(vector) / count(*), 2) AS percent, count(DISTINCT CASE WHEN vector IS NULL THEN file_uuid END) AS files_pending FROM e")
def embedding_coverage(spark, d):
    return Q.coverage(store(spark, d), "vector", "file_uuid")


@query(f"WITH {FILES}, {CHUNKS}, n AS (SELECT file_uuid, count(*) AS k FROM c GROUP BY file_uuid) SELECT course_code, count(*) AS files, coalesce(sum(k), 0)::BIGINT AS chunks, sum(CASE WHEN path LIKE '%/practice/%' THEN 1 ELSE 0 END)::BIGINT AS practice FROM f LEFT JOIN n ON n.file_uuid = f.uuid GROUP BY course_code")
def course_statistics(spark, d):
    n = chunks(spark, d).groupBy("file_uuid").agg(F.count(F.lit(1)).alias("k"))
    return files(spark, d).join(n, F.col("uuid") == F.col("file_uuid"), "left").groupBy("course_code").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("chunks"), F.sum(F.col("path").like("%/practice/%").cast("long")).alias("practice"))


@query(f"WITH {STORE} SELECT sum(CASE WHEN file_uuid IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_file, sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_label, sum(CASE WHEN vector IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_vector, sum(CASE WHEN label IS NULL AND vector IS NULL THEN 1 ELSE 0 END)::BIGINT AS neither FROM e")
def missing_counts(spark, d):
    null = lambda c: F.col(c).isNull()
    return Q.rule_counts(store(spark, d), {"no_file": null("file_uuid"), "no_label": null("label"), "no_vector": null("vector"), "neither": null("label") & null("vector")})


@query("SELECT unnest(['chunks', 'courses']) AS missing")
def expected_tables_missing(spark, d):
    return Q.difference(spark, ["file", "chunks", "module", "courses"], ["file", "module", "extra"], "missing")


# ---- catalogue

@query(f"WITH {FILES}, x AS (SELECT * FROM f WHERE course_code IN ('src1', 'src2') AND path ILIKE '%FILE_1%') SELECT uuid, path, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 10.0) AS BIGINT) AS pages, count(*) OVER () > 20 AS has_next, true AS has_prev FROM x ORDER BY path LIMIT 10 OFFSET 10")
def list_files_page(spark, d):
    x = files(spark, d).where(F.col("course_code").isin("src1", "src2") & F.col("path").ilike("%FILE_1%"))
    total = x.agg(F.count(F.lit(1)).alias("total"))
    page = x.select("uuid", "path").orderBy("path").offset(10).limit(10)
    return page.crossJoin(F.broadcast(total)).select("uuid", "path", "total", F.ceil(F.col("total") / 10).alias("pages"), (F.col("total") > 20).alias("has_next"), F.lit(True).alias("has_prev"))


@query(f"WITH {FILES}, x AS (SELECT string_split(path, '/') AS p FROM f WHERE starts_with(path, 'src3/')) SELECT p[2] AS child, count(*) AS file_count, bool_or(len(p) > 3) AS has_subdirs FROM x WHERE len(p) > 2 GROUP BY 1")
def browse_directory(spark, d):
    return Q.children(files(spark, d), "path", "src3")


@query(f"WITH {FILES}, x AS (SELECT course_code, string_split(path, '/') AS p FROM f), y AS (SELECT course_code, CASE WHEN p[2] = 'practice' AND len(p) >= 5 THEN array_to_string(p[1:4], '/') WHEN p[2] IN ('study', 'support') AND len(p) >= 4 THEN array_to_string(p[1:3], '/') END AS module FROM x) SELECT DISTINCT course_code, module FROM y WHERE module IS NOT NULL")
def module_derive(spark, d):
    return files(spark, d).select("course_code", T.module_path(F.col("path")).alias("module")).where("module IS NOT NULL").distinct()


@query(f"WITH {FILES} SELECT course_code, count(*) AS n FROM f WHERE course_code IS NOT NULL GROUP BY course_code ORDER BY n DESC, course_code LIMIT 10")
def course_totals(spark, d):
    return files(spark, d).where("course_code IS NOT NULL").groupBy("course_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "course_code").limit(10)


@query(f"WITH {FILES}, x AS (SELECT DISTINCT string_split(path, '/') AS p FROM f) SELECT DISTINCT array_to_string(p[1:k], '/') AS crumb, CAST(k AS INTEGER) AS depth FROM (SELECT p, unnest(generate_series(1, len(p))) AS k FROM x)")
def breadcrumb_paths(spark, d):
    return files(spark, d).select(F.posexplode(T.breadcrumbs(F.col("path"))).alias("k", "crumb")).select("crumb", (F.col("k") + 1).alias("depth")).distinct()


@query(f"WITH {FILES} SELECT regexp_replace(path, '[0-9]+', '<N>', 'g') AS pattern, count(*) AS n, min(path) AS first, max(path) AS last FROM f GROUP BY 1")
def path_pattern_groups(spark, d):
    return files(spark, d).groupBy(F.regexp_replace("path", "[0-9]+", "<N>").alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))


@query(f"WITH {CHUNKS}, m AS (SELECT *, abs(chunk_index - 4) AS gap, min(abs(chunk_index - 4)) OVER (PARTITION BY file_uuid) AS least FROM c) SELECT file_uuid, chunk_index, text FROM m WHERE gap = least")
def nearest_chunks(spark, d):
    gap = F.abs(F.col("chunk_index") - 4)
    return chunks(spark, d).withColumn("__l", F.min(gap).over(Window.partitionBy("file_uuid"))).where(gap == F.col("__l")).drop("__l")


@query("SELECT c_custkey, c_name FROM customer WHERE coalesce(c_acctbal > 0, true) AND lower(c_mktsegment) NOT IN ('building', 'machinery')")
def enabled_courses(spark, d):
    return table(spark, d, "customer").where(F.coalesce(F.col("c_acctbal") > 0, F.lit(True)) & ~F.lower("c_mktsegment").isin("building", "machinery")).select("c_custkey", "c_name")


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (3, 5, 5, 9, 100000000) AND text <> ''")
def lookup_by_keys(spark, d):
    keys = spark.createDataFrame([(k,) for k in (3, 5, 5, 9, 100000000)], "doc_id long")
    return table(spark, d, "documents").where("text <> ''").join(F.broadcast(keys.distinct()), "doc_id", "left_semi").select("doc_id", "text")


@query("SELECT CAST(min(doc_id) AS BIGINT) AS doc_id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_hash_dedup(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20")
def evict_oldest(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("__r", F.row_number().over(w)).where("__r <= 20").select("event_id")
