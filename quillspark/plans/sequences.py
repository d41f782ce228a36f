"""Queries over ordered rows: events as recordings, conversations as transcripts, document lines as layouts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import sequence as S
from ..sources.tables import table
from .catalogue import query
from .stores import CHUNKS, chunks

SECONDS = "CAST(epoch(ts) AS DOUBLE)"


def _events(spark, d):
    return table(spark, d, "events").withColumn("sec", F.col("ts").cast("timestamp").cast("double"))


@query("""WITH x AS (SELECT user_id, event_id, ts, CASE WHEN date_diff('second', lag(ts) OVER w, ts) <= 7200 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT user_id, event_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM x) SELECT user_id, CAST(session AS INTEGER) AS session, count(*) AS n, min(event_id) AS first_event FROM y GROUP BY ALL""")
def gap_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp"))
    return S.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], gap > 7200, "session").groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""WITH x AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x) SELECT user_id, CAST(run AS INTEGER) AS run, min(event_type) AS event_type, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY ts, event_id) AS events FROM y GROUP BY user_id, run""")
def runlength_merge(spark, d):
    e = table(spark, d, "events")
    runs = S.islands(e, ["user_id"], ["ts", "event_id"], S.changed("event_type", ["user_id"], ["ts", "event_id"]), "run")
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    return runs.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.array_join(F.transform(rows, lambda x: x["event_id"].cast("string")), " ").alias("events"))


SEGMENTS = "g AS (SELECT l_orderkey % 50 AS rec, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seg_id, min(CAST(l_partkey % 900 AS DOUBLE)) AS lo, min(CAST(l_partkey % 900 AS DOUBLE)) + min(l_quantity) AS hi FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), t AS (SELECT rec, speaker, min(a) AS a, min(b) AS b FROM (SELECT o_orderkey % 50 AS rec, 'S' || CAST(o_custkey % 20 AS VARCHAR) AS speaker, CAST(o_custkey % 890 AS DOUBLE) AS a, CAST(o_custkey % 890 + 30 AS DOUBLE) AS b FROM orders) GROUP BY rec, speaker)"


def _segments(spark, d):
    seg = table(spark, d, "lineitem").where("l_linenumber = 1").selectExpr("l_orderkey % 50 AS rec", "l_orderkey * 10 + l_linenumber AS seg_id", "CAST(l_partkey % 900 AS DOUBLE) AS start", "l_quantity")
    seg = seg.groupBy("rec", "seg_id").agg(F.min("start").alias("start"), (F.min("start") + F.min("l_quantity")).alias("end"))
    turns = table(spark, d, "orders").selectExpr("o_orderkey % 50 AS rec", "concat('S', o_custkey % 20) AS speaker", "CAST(o_custkey % 890 AS DOUBLE) AS start", "CAST(o_custkey % 890 + 30 AS DOUBLE) AS end")
    return seg, turns.groupBy("rec", "speaker").agg(F.min("start").alias("start"), F.min("end").alias("end"))


@query(f"WITH {SEGMENTS}, o AS (SELECT g.rec, seg_id, speaker, least(hi, b) - greatest(lo, a) AS overlap, a FROM g JOIN t ON g.rec = t.rec AND lo < b AND a < hi), f AS (SELECT rec, seg_id, speaker FROM o QUALIFY row_number() OVER (PARTITION BY rec, seg_id ORDER BY overlap DESC, a, speaker) = 1) SELECT g.rec, g.seg_id, coalesce(speaker, 'UNKNOWN') AS speaker FROM g LEFT JOIN f ON g.rec = f.rec AND g.seg_id = f.seg_id")
def interval_overlap_best(spark, d):
    seg, turns = _segments(spark, d)
    return S.overlap_best(seg, turns, "rec", 60.0).select("rec", "seg_id", "speaker")


@query(f"WITH {SEGMENTS} SELECT g.rec, seg_id, speaker FROM g JOIN t ON g.rec = t.rec AND g.lo BETWEEN t.a AND t.b")
def scene_range_join(spark, d):
    seg, turns = _segments(spark, d)
    return S.in_ranges(seg.select("rec", "seg_id", F.col("start").alias("at")), turns.select("rec", "speaker", F.col("start").alias("lo"), F.col("end").alias("hi")), "rec", "at", 60.0).select("rec", "seg_id", "speaker")


@query("WITH x AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS kind FROM events) SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, kind, event_id) AS INTEGER) AS place FROM x")
def asof_interleave(spark, d):
    kind = F.when(F.col("event_type") == "purchase", 0).otherwise(1)
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", kind, "event_id")).alias("place"))


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events")
def carry_forward(spark, d):
    e = table(spark, d, "events").withColumn("s", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return S.carried_forward(e, ["user_id"], ["ts", "event_id"], "s", "last_signup").select("user_id", "event_id", "last_signup")


@query(f"WITH {CHUNKS}, n AS (SELECT file_uuid, max(chunk_index) AS last FROM c GROUP BY file_uuid), h AS (SELECT file_uuid, chunk_index FROM c WHERE length(text) < 60) SELECT h.file_uuid, h.chunk_index, coalesce(lead(h.chunk_index) OVER (PARTITION BY h.file_uuid ORDER BY h.chunk_index) - 1, last) AS section_end FROM h JOIN n ON h.file_uuid = n.file_uuid")
def section_extent(spark, d):
    c = chunks(spark, d)
    lines = c.withColumn("last", F.max("chunk_index").over(Window.partitionBy("file_uuid")))
    return S.section_extent(lines.where(F.length("text") < 60), ["file_uuid"], "chunk_index", F.col("last")).select("file_uuid", "chunk_index", "section_end")


@query("""WITH l AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS occurrence FROM events WHERE event_id % 2 = 0), r AS (SELECT event_type, user_id, event_id AS other, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS occurrence FROM events WHERE event_id % 2 = 1)
SELECT l.user_id, l.event_type, CAST(l.occurrence AS INTEGER) AS occurrence, l.event_id, r.other FROM l LEFT JOIN r ON l.user_id = r.user_id AND l.event_type = r.event_type AND l.occurrence = r.occurrence""")
def occurrence_match(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return S.nth_match(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").withColumnRenamed("event_id", "other"), ["user_id", "event_type"], "event_id", "other")


@query("WITH x AS (SELECT conv_id, turn, text, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS so_far FROM conversations) SELECT conv_id, turn, substr(so_far, length(so_far) - length(text) + 1) AS delta FROM x")
def delta_of_cumulative(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    x = table(spark, d, "conversations").withColumn("so_far", F.array_join(F.collect_list("text").over(w), ""))
    before = F.coalesce(F.length(F.lag("so_far").over(Window.partitionBy("conv_id").orderBy("turn"))), F.lit(0))
    return x.select("conv_id", "turn", F.expr("so_far").substr(before + 1, F.length("so_far")).alias("delta"))


@query("SELECT user_id, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS low, round(max(value), 6) AS high, round(stddev_samp(value), 6) AS stdev FROM events GROUP BY user_id")
def latency_stats(spark, d):
    r = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, d, "events").groupBy("user_id").agg(r(F.avg("value"), "mean"), r(F.median("value"), "median"), r(F.min("value"), "low"), r(F.max("value"), "high"), r(F.stddev_samp("value"), "stdev"))


@query("SELECT user_id, CAST(date_diff('second', min(CASE WHEN event_type = 'view' THEN ts END), min(CASE WHEN event_type = 'purchase' THEN ts END)) AS BIGINT) AS view_to_purchase FROM events GROUP BY user_id")
def stage_latency(spark, d):
    first = lambda t: F.unix_seconds(F.min(F.when(F.col("event_type") == t, F.col("ts"))).cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg((first("purchase") - first("view")).alias("view_to_purchase"))


@query("WITH x AS (SELECT event_type AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) SELECT before, after, count(*) AS n FROM x WHERE after IS NOT NULL GROUP BY ALL")
def transition_counts(spark, d):
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("event_type").alias("before"), after.alias("after")).where("after IS NOT NULL").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM events GROUP BY event_type")
def category_distribution(spark, d):
    from ..operators.evaluate import shares

    return shares(table(spark, d, "events"), "event_type")


@query("SELECT conv_id, string_agg(upper(role[1]) || lower(role[2:]) || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcript_render(spark, d):
    c = table(spark, d, "conversations").withColumn("line", F.concat(F.initcap("role"), F.lit(": "), "text"))
    return c.groupBy("conv_id").agg(S.ordered_text("line", "turn", "\n").alias("transcript"))


@query()
def word_budget_groups(spark, d):
    return S.budget_groups(table(spark, d, "conversations").withColumn("at", F.col("turn").cast("double")), "conv_id", "turn", "role", "at", "text").select("conv_id", "turn", "island", "part")


@query()
def sentence_merge(spark, d):
    c = chunks(spark, d).select("file_uuid", "chunk_index", F.lit(0).alias("block"), F.lit(10.0).alias("size"), (F.col("chunk_index") * 12.0).alias("y"), "text")
    return S.sentences_of_lines(c, "file_uuid", "chunk_index")
