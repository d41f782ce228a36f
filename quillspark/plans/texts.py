"""Text, URL, JSON and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking, text as T, urls as U
from ..sources.tables import table
from .catalogue import query
from .stores import CHUNKS, FILES, chunks, files


def chain(x: str, steps) -> str:
    """Nested regexp_replace calls in SQL; steps of pattern and what takes its place."""
    for pattern, by in steps:
        by = by.replace("$1", "\\1").replace("\n", "' || chr(10) || '")
        x = f"regexp_replace({x}, '{pattern.replace('(?dm)', '(?m)')}', '{by}', 'g')"
    return x


TITLE = chain(chain("translate(lower(text), '‘’“”\"', '''''''''''')", [(r"\s+", " "), (r"^ +| +$", "")]), [(r"[:.;,!?\-–— ]+$", ""), ("''", "")])


@query(f"WITH {CHUNKS} SELECT file_uuid, chunk_index, {TITLE} AS title FROM c")
def title_clean(spark, d):
    return chunks(spark, d).select("file_uuid", "chunk_index", T.normal_title(F.col("text")).alias("title"))


@query(f"WITH {FILES} SELECT uuid, 'File ' || CAST(uuid AS VARCHAR) AS title FROM f")
def filename_title(spark, d):
    return files(spark, d).select("uuid", T.file_title(F.element_at(F.split("path", "/"), -1)).alias("title"))


# every page's URL, and others of other forms
FORMS = "u AS (SELECT page_id, unnest([url, url || '/', regexp_replace(url, '://([^/]*)', '://EXAMPLE.org:' || CASE WHEN url LIKE 'https%' THEN '443' ELSE '80' END), '//x.org/a/?q=1#f', 'rel/path//']) AS url FROM pages)"


@query(f"""WITH {FORMS}, x AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+):', 1) AS s, regexp_extract(url, '^(?:[a-z]+:)?//([^/?#]*)', 1) AS h, regexp_replace(url, '^(?:[a-z]+:)?(?://[^/?#]*)?', '') AS r FROM u),
y AS (SELECT page_id, url, CASE WHEN s <> '' THEN s || ':' ELSE '' END || CASE WHEN h <> '' THEN '//' || CASE WHEN regexp_matches(h, ':(80|443)$') THEN lower(regexp_replace(h, ':[0-9]+$', '')) ELSE h END ELSE '' END || regexp_replace(regexp_extract(r, '^[^?#]*'), '/+$', '') || regexp_extract(r, '[?#].*$') AS normal FROM x)
SELECT page_id, url, normal, starts_with(normal, 'https:') AS secure FROM y""")
def url_normalise(spark, d):
    url = F.col("url")
    port = F.when(url.startswith("https"), "443").otherwise("80")
    forms = F.array(url, F.concat(url, F.lit("/")), F.regexp_replace(url, F.lit("://([^/]*)"), F.concat(F.lit("://EXAMPLE.org:"), port)), F.lit("//x.org/a/?q=1#f"), F.lit("rel/path//"))
    odd = table(spark, d, "pages").select("page_id", F.explode(forms).alias("url"))
    return odd.select("page_id", "url", U.normalised(url).alias("normal"), U.sub_path(F.lit("https:"), url).alias("secure"))


@query("""WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1), lambda x: trim(x, '"''')) AS l FROM pages) SELECT page_id, len(list_distinct(l)) AS n_links, l[1] AS first_link FROM l""")
def distinct_links(spark, d):
    return table(spark, d, "pages").select("page_id", U.links(F.col("html")).alias("l")).select("page_id", F.size("l").cast("long").alias("n_links"), F.get("l", F.lit(0)).alias("first_link"))


@query()
def absolute_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(U.joined("url", U.links(F.col("html")))).alias("link"))


@query("SELECT page_id, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[\\\\/:*?\"<>|]', '_', 'g') AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r'[\\/:*?"<>|]', "_").alias("title"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT doc_id, 'c' || source || '/lec' || lang || '/page_' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS page_id FROM documents")
def page_id_format(spark, d):
    return table(spark, d, "documents").select("doc_id", T.page_id(F.concat(F.lit("c"), "source"), F.concat(F.lit("lec"), "lang"), (F.col("doc_id") % 1000).cast("int")).alias("page_id"))


CITED = "text || ' see [CITE: p' || CAST(doc_id % 7 AS VARCHAR) || '] and [CITE:q' || CAST(doc_id % 3 AS VARCHAR) || ' ] and [CITE: p' || CAST(doc_id % 2 AS VARCHAR) || ']'"
FOUND = f"regexp_extract_all({CITED}, '\\[CITE:\\s*([^\\]]+?)\\s*\\]', 1)"


@query(f"WITH x AS (SELECT doc_id, unnest({FOUND}) AS c, generate_subscripts({FOUND}, 1) AS n FROM documents), y AS (SELECT doc_id, c, min(n) AS n FROM x GROUP BY ALL) SELECT doc_id, string_agg(c, ',' ORDER BY n) AS cited FROM y GROUP BY doc_id")
def citations_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.citations(F.expr(CITED.replace("VARCHAR", "STRING"))), ",").alias("cited"))


REFERRED = "text || ' as in [Reference: ' || CAST(doc_id % 5 + 1 AS VARCHAR) || ', 9], references 8 and reference ' || CAST(doc_id % 3 + 1 AS VARCHAR) || ' & 12, 13 and 9.'"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all({REFERRED}, '{T.REFERENCES}'), lambda m: regexp_extract_all(m, '\\d+'))), lambda x: CAST(x AS INTEGER)))), ',') AS numbers FROM documents")
def reference_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.reference_numbers(F.expr(REFERRED.replace("VARCHAR", "STRING"))), ",").alias("numbers"))


MARKED = "'# ' || text || chr(10) || chr(10) || chr(10) || chr(10) || '![picture ' || lang || '](a.png) [' || source || '](http://x.org) `' || lang || '`  and' || chr(10) || '---' || chr(10) || '<!-- hidden' || chr(10) || ' -->```' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10)"


@query(f"SELECT doc_id, {chain(chain('(' + MARKED + ')', T.MARKDOWN), [(chr(94) + chr(92) + 's+|' + chr(92) + 's+$', '')])} AS plain, 1 AS level FROM documents")
def markdown_strip(spark, d):
    md = F.expr(MARKED.replace("chr(10)", "char(10)"))
    return table(spark, d, "documents").select("doc_id", T.plain_markdown(md).alias("plain"), T.heading_level(F.split(md, "\n")[0]).alias("level"))


@query("SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p) <> '')) AS n, CASE WHEN length(text) > 180 THEN substr(text, 1, 180) || '…' ELSE text END AS short FROM conversations")
def paragraph_count(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.paragraphs(F.col("text")).cast("long").alias("n"), T.shortened(F.col("text")).alias("short"))


@query("SELECT doc_id, source || ' > ' || lang || ' > z' AS four, source || ' > ' || lang AS one FROM documents")
def reference_path(spark, d):
    return table(spark, d, "documents").select("doc_id", T.reference_path(F.col("source"), F.array("lang", F.lit(""), F.lit("x"), F.lit("z"))).alias("four"), T.reference_path(F.col("source"), F.array(F.col("lang"), F.lit(""))).alias("one"))


KINDS = " ".join(f"WHEN list_has_any(w, {keys!r}) THEN '{kind}'" for kind, keys in T.SLIDE_WORDS.items())


@query(f"WITH l AS (SELECT conv_id, turn, text, regexp_split_to_array(lower(text), '\\s+') AS w FROM conversations) SELECT conv_id, turn, CASE {KINDS} WHEN regexp_matches(text, '\\S') THEN 'text' ELSE 'unknown' END AS kind FROM l")
def slide_type(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.slide_type(F.col("text")).alias("kind"))


@query("SELECT doc_id, substr(array_to_string(list_filter([text, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, source], lambda x: trim(x) <> ''), chr(10)), 1, 32000) AS v3 FROM documents")
def variant_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.variant_text(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.col("source"), 3).alias("v3"))


@query("SELECT source, lang, string_agg('[Reference ' || CAST(rn AS VARCHAR) || '] ' || CASE WHEN doc_id % 2 = 0 THEN 'About: ' || lang || chr(10) ELSE '' END || text, chr(10) ORDER BY rn) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3 GROUP BY source, lang")
def prompt_assembly(spark, d):
    from ..operators.sequence import ordered_text
    from ..operators.vectors import best

    top = best(table(spark, d, "documents"), ["source", "lang"], [F.asc("doc_id")], 3, "rn")
    about = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("About: "), "lang", F.lit("\n"))).otherwise("")
    return top.withColumn("line", F.concat(F.lit("[Reference "), F.col("rn").cast("string"), F.lit("] "), about, "text")).groupBy("source", "lang").agg(ordered_text("line", "rn", "\n").alias("prompt"))


@query("SELECT doc_id, md5('file:' || CAST(doc_id AS VARCHAR)) AS cache_key, sha256(text || '|md') AS content_key FROM documents")
def hash_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.concat(F.lit("file:"), F.col("doc_id").cast("string"))).alias("cache_key"), F.sha2(F.concat("text", F.lit("|md")), 256).alias("content_key"))


@query()
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


@query()
def chunk_documents(spark, d):
    return chunking.chunked(table(spark, d, "documents"), "doc_id", "text")


@query()
def deterministic_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.uuid5(F.concat(F.lit("file:"), F.sha2("text", 256))).alias("uuid"))
