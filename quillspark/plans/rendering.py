"""Markdown from structured content, model-calling stages and reports over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rendering as R
from ..operators import evaluate as E, models as M, store as S
from ..sources.tables import table
from .catalogue import query
from .retrieval import RETRIEVED, _retrieved
from .stores import CHUNKS, FILES, chunks, files

TRIMMED = r"regexp_replace(text, '^[\t\n\x0b\f\r ]+|[\t\n\x0b\f\r ]+$', '', 'g')"


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, {TRIMMED} AS t FROM conversations),
p AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN CASE WHEN starts_with(t, '#') THEN t ELSE repeat('#', CASE WHEN turn % 8 BETWEEN 1 AND 6 THEN turn % 8 ELSE 2 END) || ' ' || t END
WHEN 1 THEN CASE WHEN starts_with(t, '```') THEN t ELSE '```' || role || chr(10) || rtrim(text, chr(10)) || chr(10) || '```' END ELSE t END || CASE WHEN turn % 3 = 0 THEN ' [Reference: ' || turn || ']' ELSE '' END AS part FROM t WHERE t <> '')
SELECT conv_id, string_agg(part, chr(10) || chr(10) ORDER BY turn) AS markdown FROM p GROUP BY conv_id""")
def answer_markdown(spark, d):
    turn = F.col("turn").cast("int")
    kind = F.when(turn % 4 == 0, "heading").when(turn % 4 == 1, "code_block").otherwise("text")
    citations = F.when(turn % 3 == 0, F.array(F.struct(turn.cast("string").alias("id"), F.lit(None).cast("string").alias("quote_text")))).otherwise(F.array().cast("array<struct<id:string,quote_text:string>>"))
    block = F.struct(kind.alias("type"), F.col("text").alias("markdown_content"), F.col("role").alias("language"), (turn % 8).alias("level"), F.lit(None).cast("string").alias("unreadable"), citations.alias("citations"))
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", block.alias("b")).alias("s")).groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return turns.select("conv_id", R.answer_markdown(F.transform("s", lambda s: s["b"])).alias("markdown")).where("markdown <> ''")


@query("SELECT doc_id, lang AS speaker, text AS said, CAST(doc_id * 0.5 AS DOUBLE) AS started FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL")
def transcript_segments(spark, d):
    new, old = (F.to_json(F.array(F.struct(F.col("doc_id").alias(f"end{x}time"), (F.col("doc_id") * 0.5).alias(f"start{x}time"), F.col("lang").alias("speaker"), F.col("text").alias(f"text{x}content")))) for x in "_ ")
    rows = table(spark, d, "documents").select("doc_id", F.explode(R.transcript_segments(F.when(F.col("doc_id") % 2 == 0, new).otherwise(old))).alias("s"))
    return rows.select("doc_id", F.col("s.speaker").alias("speaker"), F.col("s.text_content").alias("said"), F.col("s.start_time").alias("started"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(35) || ' One' || chr(10) || '## Two ' || lang ELSE '# Other' || chr(10) || chr(10) || '## One' || chr(10) || '### Two ' || lang END AS markdown FROM documents")
def own_title_removed(spark, d):
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.upper("source"), F.lit(" "), "doc_id")).otherwise("Other")
    text = F.concat(F.lit("# "), title, F.lit("\n\n## One\n### Two "), "lang")
    return table(spark, d, "documents").select("doc_id", R.without_own_title(text, F.concat_ws("_", "source", "doc_id")).alias("markdown"))


@query(f"SELECT doc_id, '# S' || chr(10) || chr(10) || '## a' || chr(10) || chr(10) || source || chr(10) || chr(10) || '## b' || chr(10) || chr(10) || replace({TRIMMED}, chr(10), ' ') || chr(10) || chr(10) AS markdown FROM documents WHERE {TRIMMED} <> ''")
def paragraph_structure(spark, d):
    docs = table(spark, d, "documents")
    own = F.concat("source", F.lit("\n\n\n\n"), F.replace(R._text(F.col("text")), F.lit("\n"), F.lit(" ")))
    paragraphs = F.array(*(F.struct(F.lit(i).alias("paragraph_index"), F.lit(t).alias("title")) for i, t in ((2, "b"), (1, " a "))))
    sections = F.array(F.struct(F.lit(1).alias("start_paragraph_index"), F.lit("S").alias("section_title")))
    return docs.where(R._text(F.col("text")) != "").select("doc_id", R.titled_paragraphs(own, paragraphs, sections).alias("markdown"))


@query("SELECT doc_id, 'lead' || chr(10) || '# ' || source || chr(10) || '## ' || lang || chr(10) || 'body' || chr(10) || '### deep' AS markdown FROM documents WHERE lang IS NOT NULL")
def notebook_markdown(spark, d):
    raw = F.concat(F.lit("course\nlead\n### "), "source", F.lit("\n# "), "lang", F.lit("\n body \n##### deep"))
    return table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", R.notebook_markdown(raw).alias("markdown"))


def _threads(spark, d):
    """Each conversation as a post whose comments are its turns."""
    user = F.struct(F.col("role").alias("name"), F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), "admin").otherwise("student").alias("role"))
    comment = F.struct("turn", user.alias("user"), F.concat(F.lit("u"), "turn").alias("url"), F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") % 3).alias("votes"), F.expr("CAST(array() AS array<string>)").alias("comments"))
    return table(spark, d, "conversations").select("conv_id", comment.alias("c")).groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("comments"))


COMMENT = "'**User:** ' || role || chr(10) || '**Role:** ' || CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'admin' ELSE 'student' END || chr(10) || '**URL:** u' || turn || chr(10) || coalesce(text, '') || chr(10)"


@query(f"SELECT conv_id, '# T' || chr(10) || '**User:** x' || chr(10) || '**Role:** y' || chr(10) || '**URL:** z' || chr(10) || ' says' || chr(10) || string_agg('### Comment' || chr(10) || {COMMENT}, '' ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def thread_markdown(spark, d):
    post = F.struct(F.lit("T").alias("title"), F.struct(F.lit("x").alias("name"), F.lit("y").alias("role")).alias("user"), F.lit("z").alias("url"), F.lit("says").alias("text"), "comments")
    return _threads(spark, d).select("conv_id", R.threads_rendered(F.to_json(F.array(post))).alias("markdown"))


_HITS = " + ".join(f"(length(l) - length(replace(l, '{w}', ''))) // {len(w)}" for w in ("gradescope", "submi", "extension", "autograder", "slip day", "exception"))
_HAS = lambda words: " OR ".join(f"contains(l, '{w}')" for w in words)


@query(f"""WITH t AS (SELECT conv_id, turn, role, lower(coalesce(text, '')) AS l FROM conversations)
SELECT conv_id, turn FROM t WHERE (role = 'assistant' AND turn % 4 = 1) OR (turn % 3 > 0 AND {_HITS} <= 1 AND NOT (contains(l, 'when') AND ({_HAS(["submi", "post", "release", "due"])})) AND NOT (contains(l, 'publish') AND contains(l, ' be'))
AND NOT (len(string_split(l, ' ')) < 15 AND contains(l, 'release')) AND NOT ({_HAS([" can ", "could", "who", "what", "when", "where", "why", "how", "?"])}))""")
def thread_comments(spark, d):
    kept = F.from_json(R.comments_filtered(F.to_json("comments")), "array<struct<turn:long>>")
    return _threads(spark, d).select("conv_id", F.explode(kept).alias("c")).select("conv_id", F.col("c.turn").alias("turn"))


@query("SELECT doc_id, unnest([source, lang || '/' || doc_id]) AS link FROM documents WHERE lang IS NOT NULL")
def toctree_links(spark, d):
    page = F.concat(F.lit("Top\n\n.. toctree::\n   :maxdepth: 2\n\n   "), "source", F.lit("\n   Page <"), "lang", F.lit("/"), "doc_id", F.lit(">\n\nmore <x>"))
    return table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", F.explode(R.toctree_of(page)).alias("link"))


@query("SELECT doc_id, 'repo_url: ' || source || chr(10) || 'nav:' || chr(10) || '  - ' || lang || chr(10) || chr(10) || '  # note' || chr(10) || '  - b: c.md' AS kept FROM documents WHERE lang IS NOT NULL")
def site_navigation(spark, d):
    site = F.concat(F.lit("site_name: x\nrepo_url: "), "source", F.lit("\nnav:\n  - "), "lang", F.lit("\n\n  # note\n  - b: c.md\ntheme: t\nedit_uri: late"))
    return table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", R.navigation_of(site).alias("kept"))


@query(f"WITH {FILES}, {CHUNKS} SELECT 'parents' AS tab, count(*) AS before, count(*) FILTER (course_code = 'src0') AS going, TRUE AS dry_run, TRUE AS success FROM f UNION ALL SELECT 'chunks', count(*), count(*) FILTER (course_code = 'src0'), TRUE, TRUE FROM c JOIN f ON c.file_uuid = f.uuid")
def cleanup_report(spark, d):
    return S.cleanup_report(files(spark, d), {"chunks": (chunks(spark, d), "file_uuid")}, F.col("course_code") == "src0", "uuid")


@query(f"WITH {RETRIEVED} SELECT query_id, NOT bool_or(id = gold OR id = query_id + 1) AS abstained FROM r GROUP BY query_id")
def answer_abstained(spark, d):
    pages = _retrieved(spark, d).groupBy("query_id", "gold").agg(F.collect_list(F.col("id").cast("string")).alias("pages"))
    said = F.concat(F.lit("So [CITE: "), "gold", F.lit("] and [CITE: "), F.col("query_id") + 1, F.lit("]."))
    cited = F.regexp_extract_all(said, F.lit(r"\[CITE:\s*([^\]]+?)\s*\]"), 1)
    return pages.select("query_id", E.abstained(cited, F.col("pages")).alias("abstained"))


@query(f"""WITH {RETRIEVED}, g AS (SELECT query_id % 3 AS variant, query_id, id, rank, label = gold AS same, id % 50 - (query_id + 1) % 50 AS off FROM r),
q AS (SELECT variant, query_id, coalesce(bool_or(same) FILTER (rank = 1), FALSE) AS top1, coalesce(bool_or(same) FILTER (rank <= 5), FALSE) AS topk, bool_or(same AND off = 0) AS hit, bool_or(same AND abs(off) <= 1) AS near FROM g GROUP BY ALL),
a AS (SELECT variant, id, count(*) AS n FROM g WHERE rank = 1 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY variant ORDER BY n DESC, id) <= 5),
j AS (SELECT variant, string_agg(id || ':' || n, ' ' ORDER BY n DESC, id) AS attractors FROM a GROUP BY variant)
SELECT variant, count(*) AS n, count(*) FILTER (top1) AS top1_lecture, count(*) FILTER (topk) AS topk_lecture, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (NOT hit AND near) AS near_misses, any_value(attractors) AS attractors FROM q LEFT JOIN j USING (variant) GROUP BY variant""")
def diagnosis_bundle(spark, d):
    r = _retrieved(spark, d).withColumns({"page": F.col("id") % 50, "variant": F.col("query_id") % 3})
    out = E.diagnosis(r, "variant", (F.col("query_id") + 1) % 50, F.coalesce(F.col("label") == F.col("gold"), F.lit(False)))
    return out.withColumn("attractors", F.array_join("attractors", " "))


@query(f"WITH {FILES} SELECT uuid, CASE WHEN contains(path, 'practice/') THEN 'practice' WHEN contains(path, 'study/') THEN 'study' ELSE 'model:' || category END AS category FROM f")
def routed_classification(spark, d):
    rows = files(spark, d).select("uuid", "path", F.col("category").alias("topic"))
    # the model's place is taken by a rule on the topic
    return M.classified(rows, "path", {"practice": ["practice/"], "study": ["study/"]}, lambda asked: [f"model:{t}" for (t,) in asked], ["topic"]).select("uuid", "category")


@query(f"""WITH {CHUNKS}, s AS (SELECT file_uuid, sum(length(text)) + count(*) - 1 AS size, string_agg(text, chr(10) ORDER BY chunk_index) AS w, string_agg(left(text, 100), chr(10) ORDER BY chunk_index) AS p FROM c GROUP BY file_uuid)
SELECT file_uuid, CASE WHEN size <= 2000 THEN w WHEN size <= 8000 THEN left(w, 100) ELSE left(p, 100) END AS summary FROM s""")
def summaries(spark, d):
    return M.summarised(chunks(spark, d), "file_uuid", "chunk_index", "text", lambda text: text[:100])


@query(f"WITH {FILES} SELECT path AS file, CASE WHEN uuid % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN uuid % 7 = 0 THEN 'no converter' END AS error FROM f")
def conversion_log(spark, d):
    f = files(spark, d).withColumn("path", F.when(F.col("uuid") % 7 == 0, F.regexp_replace("path", "md$", "bin")).otherwise(F.col("path")))
    out = M.converted(f, "path", "category", {"md": lambda c: c, "txt": lambda c: F.concat(F.lit("# "), c)})
    log = M.event_log(out, "path", F.when(F.col("markdown").isNull() & F.col("path").endswith(".bin"), F.lit("no converter")))
    return log.withColumn("file", F.regexp_replace("file", "bin$", "md"))


@query("SELECT doc_id, '# ' || lang || chr(10) || chr(10) || 'A **b** [' || source || '](x/' || doc_id || ')' || chr(10) || chr(10) || '* one' || chr(10) || '* two' AS markdown FROM documents WHERE lang IS NOT NULL")
def html_markdown(spark, d):
    html = F.concat(F.lit("<html><head><title>t</title></head><body><nav>menu</nav><div class='wrap content'><h1> "), "lang", F.lit("</h1><p>A <b>b</b>\n <a href='x/"), "doc_id", F.lit("'>"), "source", F.lit("</a><ul><li>one</li><li>two</ul></div><script>no</script></body></html>"))
    site = {"https://a.example/other": [("p", "x")], "https://a.example/docs": [("div", "content")]}
    return table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", R.page_markdown(html, F.concat(F.lit("https://a.example/docs/"), "doc_id"), site).alias("markdown"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*(?:[^?#]*/)?([^/?#]+)/*(?:[?#].*)?$', 1) AS name, FALSE AS video FROM pages")
def url_file_names(spark, d):
    from ..functions import urls as U

    return table(spark, d, "pages").select("page_id", U.file_name(F.col("url")).alias("name"), U.video_host(F.col("url")).alias("video"))


@query("SELECT doc_id, unnest([1, 6]) AS first, unnest([3, 6]) AS last FROM documents WHERE lang IS NOT NULL")
def code_fences(spark, d):
    from pyspark.sql import types as T

    from ..functions.parsing import arrays, fence_spans

    spans = arrays(fence_spans, T.ArrayType(T.ArrayType(T.IntegerType())))
    text = F.concat("source", F.lit("\n```py\n"), "lang", F.lit("\n```\nx\n\n```"))
    rows = table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", F.explode(spans(text)).alias("s"))
    return rows.select("doc_id", F.col("s")[0].alias("first"), F.col("s")[1].alias("last"))
