"""Changes to a store as pure functions: tables in, tables out.  Every one is a join on the key; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of source replace those of equal key, nulls and all; the columns in keep stay the target's where it has the row."""
    t, s = target.withColumn("__t", F.lit(True)), source.withColumn("__s", F.lit(True))
    columns = list(dict.fromkeys([*target.columns, *source.columns]))
    joined = t.alias("t").join(s.alias("s"), keys, "full")

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c not in source.columns:
            return F.col(f"t.{c}").alias(c)
        if c not in target.columns:
            return F.col(f"s.{c}").alias(c)
        take_target = F.col("__s").isNull() | (F.col("__t").isNotNull() if c in keep else F.lit(False))
        return F.when(take_target, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c)

    return joined.select(*[value(c) for c in columns])


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows of source whose key the target doesn't have, one for each key."""
    return target.unionByName(source.dropDuplicates(keys).join(target.select(keys), keys, "left_anti"))


def delete_cascade(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], condition: Column, key: str) -> dict[str, DataFrame]:
    """The tables after the parents that meet the condition and all rows that point at them have gone."""
    gone = parents.where(condition).select(F.col(key).alias("__key"))
    out = {"parents": parents.where(~F.coalesce(condition, F.lit(False)))}
    return out | {n: df.join(gone, df[fk] == gone["__key"], "left_anti") for n, (df, fk) in children.items()}


def cleanup_report(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], condition: Column, key: str, dry_run: bool = True) -> DataFrame:
    """What delete_cascade takes, table by table: rows before, rows that go, and whether they have gone; no parent to delete is a failure."""
    going = parents.where(condition)
    keys = going.select(F.col(key).alias("__key")).distinct()
    count = lambda df, name, gone: df.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("before"), F.count(F.when(gone, 1)).alias("going"))
    out = count(parents, "parents", F.coalesce(condition, F.lit(False)))
    for name, (df, fk) in children.items():
        marked = df.select(F.col(fk).alias("__fk")).join(keys, F.col("__fk") == F.col("__key"), "left")
        out = out.unionByName(count(marked, name, F.col("__key").isNotNull()))
    found = out.agg(F.max(F.when(F.col("tab") == "parents", F.col("going"))).alias("__n"))
    return out.crossJoin(F.broadcast(found)).select("tab", "before", "going", F.lit(dry_run).alias("dry_run"), (F.lit(dry_run) | (F.col("__n") > 0)).alias("success"))


def split_off(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], condition: Column, key: str) -> dict[str, DataFrame]:
    """Only the parents that meet the condition and the rows that point at them."""
    kept = parents.where(condition)
    keys = kept.select(F.col(key).alias("__key"))
    return {"parents": kept} | {n: df.join(keys, df[fk] == keys["__key"], "left_semi") for n, (df, fk) in children.items()}


def replace_groups(target: DataFrame, sources: list[DataFrame], group: str) -> DataFrame:
    """Merges sources into target: each group that a source has is replaced whole; columns missing on a side are null."""
    merged = sources[0]
    for s in sources[1:]:
        merged = merged.unionByName(s, allowMissingColumns=True)
    return target.join(merged.select(group).distinct(), group, "left_anti").unionByName(merged, allowMissingColumns=True)


def moved_paths(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files (uuid, file_hash, path) whose path is gone while their hash stands at a new one get that path (the smallest)."""
    there = listing.select("path").distinct().withColumn("__there", F.lit(True))
    new = listing.groupBy("file_hash").agg(F.min("path").alias("__new"))
    joined = files.join(there, "path", "left").join(new, "file_hash", "left")
    return joined.select("uuid", "file_hash", F.when(F.col("__there").isNull() & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("path")).alias("path"))


def conflicts(files: DataFrame, key: str = "file_hash", owner: str = "uuid") -> DataFrame:
    """Keys that several owners claim."""
    return files.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(owner).alias("owners")).where("owners > 1")


def ensure_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))
