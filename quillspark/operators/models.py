"""Stages that call a model the user brings: any function of texts.  The engine batches, routes, and puts results together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.rules import by_folder
from .sequence import ordered_text


#: Rows that are Python objects at once.
AT_ONCE = 200


def predicted(rows: DataFrame, predict: Callable[[list], list], inputs: list[str], name: str = "prediction", batch: int = 10, keep: list[str] | None = None) -> DataFrame:
    """A column of what predict gives for lists of at most `batch` inputs (tuples); a fault of the model is a null with its text beside it.

    keep: the columns that come back, all by default; long inputs needn't.
    """
    keep = rows.columns if keep is None else keep
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(name, T.StringType()), T.StructField(f"{name}_error", T.StringType())])
    size = batch * max(1, AT_ONCE // batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), size):
                part = whole.slice(start, size)
                said, out, faults = [part.column(c).to_pylist() for c in inputs], [], []
                for at in range(0, len(part), batch):
                    asked = list(zip(*(c[at : at + batch] for c in said)))
                    try:
                        got, fault = list(predict(asked)), None
                        if len(got) != len(asked):
                            raise ValueError(f"{len(got)} answers to {len(asked)} inputs")
                    except Exception as e:  # noqa: BLE001 - one batch's fault is a result of its rows
                        got, fault = [None] * len(asked), str(e)
                    out += got
                    faults += [fault] * len(asked)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(out, pa.string()), pa.array(faults, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def classified(rows: DataFrame, path: str, rules: dict[str, list[str]], classify: Callable[[list], list], inputs: list[str], batch: int = 10) -> DataFrame:
    """category of each row: that of the first rule whose folder stands in the path, or the model's for the rest, in batches."""
    ruled = rows.withColumn("category", by_folder(F.col(path), rules))
    rest = predicted(ruled.where("category IS NULL").drop("category"), classify, inputs, "category", batch).drop("category_error")
    return ruled.where("category IS NOT NULL").unionByName(rest)


def summarised(chunks: DataFrame, by: str, order: str, text: str, summarise: Callable[[str], str], short: int = 2000, most: int = 8000) -> DataFrame:
    """One summary of each group of texts: as it is where all of it is short, of the whole where that fits, else of its chunks' summaries.

    Chunks are summarised wherever they lie, so a long file is no task of its own.
    """
    said = lambda rows: predicted(rows, lambda asked: [summarise(t) for (t,) in asked], ["t"], "s", keep=[c for c in rows.columns if c != "t"]).drop("s_error")
    size = chunks.groupBy(by).agg((F.sum(F.length(F.coalesce(text, F.lit("")))) + F.count(F.lit(1)) - 1).alias("size"))
    sized = chunks.select(by, F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")).join(size, by)
    parts = sized.where(F.col("size") <= most).unionByName(said(sized.where(F.col("size") > most)).withColumnRenamed("s", "t"))
    whole = parts.groupBy(by, "size").agg(ordered_text("t", "o", "\n").alias("t"))
    long = said(whole.where(F.col("size") > short)).select(by, F.col("s").alias("summary"))
    return whole.where(F.col("size") <= short).select(by, F.col("t").alias("summary")).unionByName(long)


def converted(files: DataFrame, path: str, content: str, converters: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """markdown of each file by the converter of its extension; null where none is registered."""
    kind, out = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit(None).cast("string")
    for extension, convert in converters.items():
        out = F.when(kind == extension, convert(F.col(content))).otherwise(out)
    return files.withColumn("markdown", out)


def event_log(rows: DataFrame, file: str, error: Column) -> DataFrame:
    """What a progress callback would be told of each file: (file, status, error)."""
    return rows.select(F.col(file).alias("file"), F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error"))
