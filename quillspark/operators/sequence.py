"""Operators over ordered rows: sessions, runs, intervals, as-of joins, sections, and the folds that need an order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """Numbers groups of consecutive rows from 1; a row where starts holds (or is null: the first) opens one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def changed(column: str, by: list[str], order: list[str]) -> Column:
    """Whether a value differs from the row's before."""
    return ~F.col(column).eqNullSafe(F.lag(column).over(Window.partitionBy(*by).orderBy(*order))) | F.row_number().over(Window.partitionBy(*by).orderBy(*order)).eqNullSafe(1)


def ordered_text(text: str, order: str, separator: str) -> Column:
    """Texts of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)


def overlap_best(segments: DataFrame, turns: DataFrame, by: str, bucket: float, default: str = "UNKNOWN") -> DataFrame:
    """Each segment (by, seg_id, start, end) gets the speaker of the turn (by, speaker, start, end) that overlaps it most; the first of equals.

    Both sides are dealt into buckets of time, so that the join has an equality besides the range.
    """
    s = segments.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    t = turns.toDF(*[c if c == by else f"t_{c}" for c in turns.columns]).withColumn("__b", F.explode(F.sequence(F.floor(F.col("t_start") / bucket), F.floor(F.col("t_end") / bucket))))
    hit = s.join(t, [by, "__b"]).where("start < t_end AND t_start < end").withColumn("overlap", F.least("end", "t_end") - F.greatest("start", "t_start"))
    first = hit.groupBy(by, "seg_id").agg(F.min_by("t_speaker", F.struct(-F.col("overlap"), "t_start", "t_speaker")).alias("speaker"))
    return segments.join(first, [by, "seg_id"], "left").withColumn("speaker", F.coalesce("speaker", F.lit(default)))


def in_ranges(points: DataFrame, ranges: DataFrame, by: str, at: str, bucket: float) -> DataFrame:
    """Points joined with all ranges [lo, hi] that hold them, both ends included."""
    r = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    return points.withColumn("__b", F.floor(F.col(at) / bucket)).join(r, [by, "__b"]).where(F.col(at).between(F.col("lo"), F.col("hi"))).drop("__b")


def carried_forward(df: DataFrame, by: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """The last value so far that isn't null."""
    return df.withColumn(name, F.last(column, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def section_extent(df: DataFrame, by: list[str], line: str, last: Column) -> DataFrame:
    """Each heading's section ends one line before the next heading."""
    return df.withColumn("section_end", F.coalesce(F.lead(line).over(Window.partitionBy(*by).orderBy(line)) - 1, last))


def nth_match(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """The n-th row of a key on the left meets the n-th on the right."""
    number = lambda df, o: df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(o)))
    return number(left, left_order).join(number(right, right_order), [*keys, "occurrence"], "left")


def budget_groups(df: DataFrame, by: str, order: str, speaker: str, at: str, text: str, gap: float = 5.0, words: int = 200) -> DataFrame:
    """Rows with group_no: a new group on a change of speaker, a gap above `gap`, or when the group's words would pass `words`.

    The first two rules cut islands with windows; the word budget is a fold, done island by island in pandas.
    """
    w = Window.partitionBy(by).orderBy(order)
    starts = changed(speaker, [by], [order]) | (F.col(at) - F.lag(at).over(w) > gap)
    cut = islands(df, [by], [order], starts, "island").withColumn("n_words", F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, total, number, out = pdf.sort_values(order), 0, 0, []
        for n in pdf["n_words"]:
            if out and total + n > words:
                number, total = number + 1, 0
            total += n
            out.append(number)
        return pdf.assign(part=out)

    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", part int"
    return cut.groupBy(by, "island").applyInPandas(fold, schema)


def sentences_of_lines(df: DataFrame, by: str, order: str, limit: int = 10) -> DataFrame:
    """Lines (by, order, block, size, y, text) merged to sentences: same block, no terminal mark before, gap of at most two line sizes, fewer than `limit` lines."""

    def fold(lines: list[dict]) -> list[dict]:
        out: list[dict] = []
        before = None
        for r in lines:
            joins = before is not None and r["block"] == before["block"] and not before["text"].rstrip().endswith((".", "!", "?")) and abs(r["y"] - before["y"]) <= 2 * before["size"] and out[-1]["n_lines"] < limit
            if joins:
                out[-1]["text"] += " " + r["text"].strip()
                out[-1]["n_lines"] += 1
            else:
                out.append({"sentence": len(out), "text": r["text"].strip(), "n_lines": 1})
            before = r
        return out

    return folded(df, by, [order, "block", "size", "y", "text"], fold, "sentence int, text string, n_lines int")


def folded(df: DataFrame, by: str, columns: list[str], fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """What a fold over each group's rows, in order of the first of the columns, makes of them: by, and the columns of the schema.

    Groups come as arrays, many to a batch: a group of a few rows costs no call of its own between Spark and Python.
    """
    lists = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    empty = df.sparkSession.createDataFrame([], schema).schema
    out = T.StructType([df.schema[by], T.StructField("rows", T.ArrayType(empty))])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                made = [fold(rows) for rows in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, arrow.field("rows").type)], names=[by, "rows"])

    return lists.mapInArrow(run, out).select(by, F.explode("rows").alias("r")).select(by, "r.*")


def levels_repaired(headings: DataFrame, by: str, order: str) -> DataFrame:
    """Headings (by, order, level) with levels without jumps."""
    repaired = repaired_levels  # the function alone travels, not its module

    def fold(rows: list[dict]) -> list[dict]:
        return [{order: r[order], "level": n} for r, n in zip(rows, repaired([r["level"] for r in rows]))]

    return folded(headings, by, [order, "level"], fold, f"{order} {headings.schema[order].dataType.simpleString()}, level int")


def repaired_levels(levels: list[int]) -> list[int]:
    """Heading levels without jumps of more than one: the run of deeper headings after a jump moves up to it."""
    out = list(levels)
    for i in range(1, len(out)):
        if (excess := out[i] - out[i - 1] - 1) > 0:
            floor, j = out[i], i
            while j < len(out) and out[j] >= floor:
                out[j] -= excess
                j += 1
    return out
