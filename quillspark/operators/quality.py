"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def null_profile(df: DataFrame, warn_above: float = 90.0) -> DataFrame:
    """col, total, nulls, non_null, all_null, null_percent, warned: one pass over all columns."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = one.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), (F.col("total") - F.col(f"c{i}")).alias("nulls")) for i, c in enumerate(df.columns)])).alias("r")).select("total", "r.*")
    percent = F.try_divide(100.0 * F.col("nulls"), F.col("total"))
    return rows.select("col", "total", "nulls", (F.col("total") - F.col("nulls")).alias("non_null"), (F.col("nulls") == F.col("total")).alias("all_null"), F.round(percent, 2).alias("null_percent"), (percent > warn_above).alias("warned"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(children: DataFrame, fk: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent isn't there; a null key has none."""
    return children.join(parents.select(F.col(key).alias("__key")), F.col(fk) == F.col("__key"), "left_anti")


def mismatched(joined: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows on which the two differ, null against a value too."""
    return joined.where(~a.eqNullSafe(b))


def coverage(df: DataFrame, vector: str, owner: str) -> DataFrame:
    total, have = F.count(F.lit(1)), F.count(vector)
    return df.agg(total.alias("total"), have.alias("embedded"), (total - have).alias("pending"), F.round(F.try_divide(100.0 * have, total), 2).alias("percent"), F.countDistinct(F.when(F.col(vector).isNull(), F.col(owner))).alias("files_pending"))


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: how many rows meet each rule."""
    return df.agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in rules.items()])


def difference(spark: SparkSession, expected: list[str], found: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in expected], f"{name} string").exceptAll(spark.createDataFrame([(x,) for x in found], f"{name} string"))


def children(df: DataFrame, path: str, directory: str) -> DataFrame:
    """child, file_count, has_subdirs of the directories right below one."""
    depth = directory.count("/") + 1
    p = F.split(path, "/")
    return df.where(F.startswith(F.col(path), F.lit(directory + "/"))).select(p.alias("p")).where(F.size("p") > depth + 1).groupBy(F.col("p")[depth].alias("child")).agg(F.count(F.lit(1)).alias("file_count"), F.bool_or(F.size("p") > depth + 2).alias("has_subdirs"))
