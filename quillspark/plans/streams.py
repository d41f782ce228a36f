"""Streaming queries, with their batch equivalents as SQL where the result is the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import jobs
from .catalogue import query

PROGRESS = "SELECT user_id, count(*) AS processed, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS succeeded, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS failed, sum(CASE WHEN event_type NOT IN ('purchase', 'error') THEN 1 ELSE 0 END)::BIGINT AS skipped FROM events GROUP BY user_id"


def _stream(spark, d, name):
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


@query(PROGRESS)
def job_progress(spark, d):
    return jobs.job_progress(table(spark, d, "events"))


@query(PROGRESS)
def stream_job_progress(spark, d):
    return jobs.run_to_table(jobs.job_progress(_stream(spark, d, "events")), f"progress_{uuid.uuid4().hex}", "complete")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    e = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.run_to_table(jobs.windowed_counts(e), f"windows_{uuid.uuid4().hex}", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT conv_id AS request_id, string_agg(text, '' ORDER BY turn) AS said FROM conversations GROUP BY conv_id")
def stream_token_deltas(spark, d):
    from ..operators.sequence import ordered_text

    t = _stream(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.col("text").alias("token"))
    out = jobs.run_to_table(jobs.token_deltas(t), f"deltas_{uuid.uuid4().hex}", "append")
    return out.groupBy("request_id").agg(ordered_text("delta", "out_seq", "").alias("said"))


@query("SELECT conv_id AS request_id, regexp_extract(string_agg(text, ' ' ORDER BY turn), '^(.*\\. )', 1, 's') AS said FROM conversations GROUP BY conv_id HAVING contains(string_agg(text, ' ' ORDER BY turn), '. ')")
def stream_speech_segments(spark, d):
    from ..operators.sequence import ordered_text

    token = F.concat(F.when(F.col("turn") > 0, " ").otherwise(""), "text")
    t = _stream(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), token.alias("token"))
    out = jobs.run_to_table(jobs.speech_segments(t), f"speech_{uuid.uuid4().hex}", "append")
    return out.groupBy("request_id").agg(ordered_text("segment", "out_seq", "").alias("said"))


@query("""WITH b AS (SELECT conv_id, turn, text, turn % 3 = 0 AS o, turn % 2 = 1 AS c FROM conversations),
w AS (SELECT *, max(turn) FILTER (o) OVER (PARTITION BY conv_id ORDER BY turn) AS lo, max(turn) FILTER (c) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lc,
count(*) FILTER (text <> '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM b),
e AS (SELECT conv_id, turn, 0 AS k, 'open' AS event, CAST(turn AS VARCHAR) AS value FROM w WHERE o UNION ALL SELECT conv_id, turn, 1, 'text', CASE WHEN said > 0 THEN chr(10) || chr(10) ELSE '' END || text FROM w WHERE text <> ''
UNION ALL SELECT conv_id, turn, 2, 'close', CAST(lo AS VARCHAR) FROM w WHERE c AND lo IS NOT NULL AND (lc IS NULL OR lo > lc))
SELECT conv_id AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS out_seq, event, value FROM e""")
def stream_citation_events(spark, d):
    b = _stream(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), "text", F.col("turn").cast("long").alias("citation"), (F.col("turn") % 3 == 0).alias("opens"), (F.col("turn") % 2 == 1).alias("closes"))
    return jobs.run_to_table(jobs.citation_events(b), f"citations_{uuid.uuid4().hex}", "append")


@query("SELECT conv_id AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS out_seq, coalesce(text, '') AS point FROM conversations")
def stream_bullets(spark, d):
    bullet = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("point"), F.col("role").alias("purpose")))
    token = F.concat(F.when(F.col("turn") == 0, '{"title": "t", "bullets": [').otherwise(", "), bullet)
    t = _stream(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), token.alias("token"))
    out = jobs.run_to_table(jobs.growing_bullets(t), f"bullets_{uuid.uuid4().hex}", "append")
    return out.select("request_id", "out_seq", F.get_json_object("bullet", "$.point").alias("point"))
