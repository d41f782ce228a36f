"""Reports and exports, written by Spark; numbering without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Sampled keys for each range.
KEYS_A_RANGE = 32


def _range_of(key: Column, ends: list) -> Column:
    """How many of the sorted ends are at most the key, by halving; null keys come first."""

    def among(lo: int, hi: int) -> Column:
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(key < F.lit(ends[mid]), among(lo, mid)).otherwise(among(mid + 1, hi))

    return F.when(key.isNull(), 0).otherwise(among(0, len(ends)))


def numbered(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """The place of each row in the order of the key, from 1: rows fall into ranges, and a range begins where those before it end.

    The ends of ranges are fixed values, from the keys of least hash: where a row falls rests on its key alone, however often or
    along with which columns the rows are read.
    """
    n = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 256)
    some = rows.select(F.col(key).alias("k")).where("k IS NOT NULL").orderBy(F.xxhash64("k"), "k").limit(KEYS_A_RANGE * n)
    ends = list(dict.fromkeys(r.k for r in some.orderBy("k").collect()[KEYS_A_RANGE - 1 :: KEYS_A_RANGE]))
    parts = rows.withColumn("__p", _range_of(F.col(key), ends))
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__k"))
    before = counts.select("__p", F.coalesce(F.sum("__k").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # a row a range
    place = F.row_number().over(Window.partitionBy("__p").orderBy(key))
    return parts.withColumn("__i", place).join(F.broadcast(before), "__p").withColumn(name, (F.col("__b") + F.col("__i")).cast("long")).drop("__p", "__i", "__b")


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """A report as JSON lines, CSV with a header, or Parquet; an older one at the path is replaced."""
    writer = df.write.mode("overwrite")
    {"json": writer.json, "csv": writer.option("header", True).csv, "parquet": writer.parquet}[form](path)


def compacted(df: DataFrame, path: str, files: int) -> None:
    """Rewrites a table to few files; rows don't move between executors."""
    df.coalesce(files).write.mode("overwrite").parquet(path)


def as_documents(df: DataFrame, key: str) -> DataFrame:
    """Rows as JSON documents with their key as _id; timestamps and decimals as text."""
    def plain(name: str, kind: str) -> Column:
        return F.col(name).cast("string").alias(name) if kind.startswith(("timestamp", "date", "decimal", "binary")) else F.col(name)

    return df.select(F.to_json(F.struct(F.col(key).cast("string").alias("_id"), *[plain(n, k) for n, k in df.dtypes])).alias("line"))
