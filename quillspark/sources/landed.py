"""Readers of landed files: JSON lines, folders of any files, YAML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.rules import ignored
from ..operators.catalog import lenient_json, strict_json


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines with their file's name; blank lines are skipped, malformed ones skipped or an error."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    return (strict_json if strict else lenient_json)(lines, schema)


def folder(spark: SparkSession, path: str, extensions: list[str] | None = None, ignore: list[str] | None = None, hidden: bool = False) -> DataFrame:
    """path (below the folder), name, kb, modified of all files; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.removeprefix("file:").rstrip("/")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{base}/", "")
    rows = rows.select(below.alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), (F.col("length") / 1024).alias("kb"), F.col("modificationTime").alias("modified"))
    if extensions is not None:
        rows = rows.where(F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(extensions))
    if not hidden:
        rows = rows.where(~F.col("path").rlike(r"(^|/)\."))
    return rows.where(~ignored(F.col("path"), ignore or []))


def yaml_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents, or lists of them, of all .yml and .yaml files, one row each; parsed where the files are read."""
    kind = spark.createDataFrame([], schema).schema

    def parsed(batches):
        import pandas as pd
        import yaml

        for b in batches:
            rows = [r for raw in b["content"] for doc in yaml.safe_load_all(raw) if doc is not None for r in (doc if isinstance(doc, list) else [doc])]
            yield pd.DataFrame([[r.get(f.name) for f in kind.fields] for r in rows], columns=kind.fieldNames())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yml,yaml}").load(path)
    return files.select("content").mapInPandas(parsed, kind)
