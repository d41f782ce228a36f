"""What the operators share: written tables in the shared folder, worker caches, hold-out rules."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder.  Only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Only a session in one process (as in tests) does without: it gets a temporary one."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not folder:
        folder = _own_folder = _own_folder or f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    return folder.rstrip("/")


_own_folder = ""
#: Rows of an Arrow batch while a table is written: long texts stay within the memory of a worker.
BATCH_ROWS = 2000
#: Input bytes (as stored) that one part of a packed shuffle stands for.
PART_BYTES = 32 << 20


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Plans made inside use batches of BATCH_ROWS; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def parts_for(documents: DataFrame) -> int:
    """Parts of a packed shuffle: twice the shuffle partitions, or more where the input's size asks for it, so that no part grows with the input."""
    least = 2 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = documents._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # what has no statistics says 2^63
    return max(least, known // PART_BYTES)


def give_back() -> None:
    """Returns memory that is free inside a worker to the system; workers live on between tasks and stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):
        ctypes.CDLL(None).malloc_trim(0)


def lean(rows):
    """A function of batches whose worker gives its memory back at the end of the task."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def free_shuffles(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of finished jobs now: it does so once their plans are collected in the driver."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables written below the shared folder.  Writing one cuts lineage, and its rows survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with bounded_batches(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that nothing lazy reads any more; none named: all of them."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [f"{self.base}/{n}" for n in names] or [self.base]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id gives 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0)) % modulus


def text_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text (null: empty) reach the workers, whatever other columns there are."""
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process, across its tasks."""
    module = sys.modules.get("_quillspark_worker") or sys.modules.setdefault("_quillspark_worker", types.ModuleType("_quillspark_worker"))
    return module.__dict__.setdefault(name, {})
