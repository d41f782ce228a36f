"""Streams: job progress, token deltas, event-time windows, expiry.

Each takes a streaming (or batch) DataFrame and returns one; sources and sinks are the caller's.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.parsing import whole_bullets


def job_progress(events: DataFrame, job: str = "user_id", status: str = "event_type", done: tuple[str, ...] = ("purchase",), failed: tuple[str, ...] = ("error",)) -> DataFrame:
    """Counters of each job: processed, succeeded, failed, others skipped.  On a stream: update or complete mode."""
    is_in = lambda xs: F.sum(F.when(F.col(status).isin(*xs), 1).otherwise(0))
    return events.groupBy(job).agg(F.count(F.lit(1)).alias("processed"), is_in(done).alias("succeeded"), is_in(failed).alias("failed"), (F.count(F.lit(1)) - is_in(done) - is_in(failed)).alias("skipped"))


def windowed_counts(events: DataFrame, at: str = "ts", size: str = "1 day", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums in tumbling event-time windows; rows later than `late` are left out on a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, at: str = "ts", gap: str = "2 hours", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, key: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def token_deltas(tokens: DataFrame) -> DataFrame:
    """Rows (request_id, seq, token) to (request_id, out_seq, channel, delta): what each adds to the thinking or the answer channel.

    A tail that may yet become a reference mark or a channel mark is held back until it is decided.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, thinking, number = state.get if state.exists else ("", False, 0)
        out = []
        for token in pd.concat(list(frames)).sort_values("seq")["token"]:
            held += token
            while True:
                mark = "</think>" if thinking else "<think>"
                if mark in held:
                    before, held = held.split(mark, 1)
                    if before:
                        out.append((key[0], number, "thinking" if thinking else "final", before))
                        number += 1
                    thinking = not thinking
                    continue
                safe = len(held)
                for open_mark in (mark, "[Reference:"):
                    for k in range(min(len(open_mark), len(held)), 0, -1):
                        if held.endswith(open_mark[:k]):
                            safe = min(safe, len(held) - k)
                            break
                if (at := held.rfind("[Reference:")) >= 0 and "]" not in held[at:]:
                    safe = min(safe, at)
                if safe > 0:
                    out.append((key[0], number, "thinking" if thinking else "final", held[:safe]))
                    held, number = held[safe:], number + 1
                break
        state.update((held, thinking, number))
        yield pd.DataFrame(out, columns=["request_id", "out_seq", "channel", "delta"])

    return tokens.groupBy("request_id").applyInPandasWithState(step, "request_id long, out_seq long, channel string, delta string", "held string, thinking boolean, number long", "append", GroupStateTimeout.NoTimeout)


def speech_segments(tokens: DataFrame) -> DataFrame:
    """Rows (request_id, seq, token) to (request_id, out_seq, segment): whole sentences, as far as the last full stop and blank that has come."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number = state.get if state.exists else ("", 0)
        out = []
        for token in pd.concat(list(frames)).sort_values("seq")["token"]:
            held += token or ""
            if (end := held.rfind(". ")) > 0 and held[: end + 2].strip():
                out.append((key[0], number, held[: end + 2]))
                held, number = held[end + 2 :], number + 1
        state.update((held, number))
        yield pd.DataFrame(out, columns=["request_id", "out_seq", "segment"])

    return tokens.groupBy("request_id").applyInPandasWithState(step, "request_id long, out_seq long, segment string", "held string, number long", "append", GroupStateTimeout.NoTimeout)


def citation_events(blocks: DataFrame) -> DataFrame:
    """Rows (request_id, seq, text, citation, opens, closes) to ordered events (request_id, out_seq, event, value).

    A block that opens a citation says so before its text; one that closes says so after its text, where a citation is open.
    A blank line stands before the text of every block but the first that has text.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, said, number = state.get if state.exists else (None, False, 0)
        out = []
        for b in pd.concat(list(frames)).sort_values("seq").itertuples():
            here = []
            if b.opens and not pd.isna(b.citation):
                active = int(b.citation)
                here.append(("open", str(active)))
            if b.text:
                here.append(("text", ("\n\n" if said else "") + b.text))
                said = True
            if b.closes and active is not None:
                here.append(("close", str(active)))
                active = None
            out += [(key[0], number + k, *e) for k, e in enumerate(here)]
            number += len(here)
        state.update((active, said, number))
        yield pd.DataFrame(out, columns=["request_id", "out_seq", "event", "value"])

    return blocks.groupBy("request_id").applyInPandasWithState(step, "request_id long, out_seq long, event string, value string", "active long, said boolean, number long", "append", GroupStateTimeout.NoTimeout)


def growing_bullets(tokens: DataFrame) -> DataFrame:
    """Rows (request_id, seq, token) of growing JSON to (request_id, out_seq, bullet): each bullet once, as soon as it is whole."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number = state.get if state.exists else ("", 0)
        held += "".join(t or "" for t in pd.concat(list(frames)).sort_values("seq")["token"])
        new = whole_bullets(held)[number:]
        state.update((held, number + len(new)))
        yield pd.DataFrame([(key[0], number + k, b) for k, b in enumerate(new)], columns=["request_id", "out_seq", "bullet"])

    return tokens.groupBy("request_id").applyInPandasWithState(step, "request_id long, out_seq long, bullet string", "held string, number long", "append", GroupStateTimeout.NoTimeout)


def run_to_table(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what its source has now into Parquet below the shared folder, and reads it back.

    A batch that is run again replaces its own folder; in complete mode the last batch is the result.  A name that ran before goes on where it stopped.  Nothing passes through the driver.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    base = f"{(shared or 'file://' + tempfile.mkdtemp(prefix='streams-')).rstrip('/')}/{name}"
    last = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        last.append(number)

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{base}/rows/batch={last[-1]}" if mode == "complete" else f"{base}/rows/*")


def run_to_memory(df: DataFrame, name: str, mode: str) -> DataFrame:
    """The same into the driver's memory: for looking at a small stream, not for results that grow."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
