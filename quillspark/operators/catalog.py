"""Scans of a course catalogue, lookups and rule-based joins: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def vector_index(chunks: DataFrame, course: str | None = None, module: str | None = None, file: int | None = None) -> DataFrame:
    """Chunks with a vector of the commonest dimension (the smaller of equals) in a course, and a file or else a module; null texts are '', null places 0."""
    rows = chunks.where("vector IS NOT NULL")
    if course is not None:
        rows = rows.where(F.col("course") == course)
    if file is not None:
        rows = rows.where(F.col("file_uuid") == file)
    elif module is not None:
        rows = rows.where(F.startswith("file_path", F.lit(f"{module}/")))
    modal = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).select("dim")
    rows = rows.join(F.broadcast(modal), F.size("vector") == F.col("dim")).drop("dim")  # one row
    return rows.withColumns({"text": F.coalesce("text", F.lit("")), "idx": F.coalesce("idx", F.lit(0))})


def first_choice(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of the first table, or of the second where the first has none."""
    some = first.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return first.unionByName(second.crossJoin(F.broadcast(some)).where("n = 0").drop("n"))


def lenient_json(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """The fields of JSON lines; blank and malformed lines are skipped."""
    rows = lines.where(F.trim(line) != "").withColumn("__r", F.from_json(line, f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}))
    rows = rows.where("__r IS NOT NULL AND __r.__bad IS NULL")
    return rows.select(*[c for c in lines.columns if c != line], "__r.*").drop("__bad")


def strict_json(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """The same, but a malformed line is an error."""
    rows = lines.where(F.trim(line) != "").withColumn("__r", F.from_json(line, schema, {"mode": "FAILFAST"}))
    return rows.select(*[c for c in lines.columns if c != line], "__r.*")


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; rows without a key are skipped."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__l")).select(key, "__l.*")


def first_distinct(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each group, in the given order."""
    others = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("__f")).select(*by, "__f.*")


def valid_pairs(pairs: DataFrame, types: list[str], most: int, normal: Column, grounded: Column, by: str = "page_id", order: str = "pos") -> DataFrame:
    """Question pairs of the given types with a question, an answer and grounds; the first of equal questions, the first `most` a page."""
    rows = pairs.where(F.col("question_type").isin(types) & F.col("answer").isNotNull()).withColumn("__q", normal).where(F.coalesce(F.col("__q") != "", F.lit(False)) & grounded)
    rows = first_distinct(rows, [by, "__q"], order).drop("__q")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__n") <= most).drop("__n")


def answers_kept(answers: DataFrame, by: str = "post") -> DataFrame:
    """Without answers of others that no one took up, where an admin answered the post."""
    admin = F.bool_or(F.col("role") == "admin").over(Window.partitionBy(by))
    return answers.withColumn("__a", admin).where(~F.col("__a") | (F.col("role") == "admin") | (F.col("votes") > 0) | (F.col("n_comments") > 0)).drop("__a")


def page_texts(contents: DataFrame, kept: Column, joint: str) -> DataFrame:
    """page, text: the kept contents (page, pos, text) of each page in order, joined."""
    rows = F.array_sort(F.collect_list(F.when(kept, F.struct("pos", "text"))))
    return contents.groupBy("page").agg(F.array_join(F.transform(rows, lambda r: r["text"]), joint).alias("text"))


def title_paths(headings: DataFrame, by: str, deepest: int = 6) -> DataFrame:
    """The path of titles above each heading (by, line, level, title): a heading ends all deeper ones before it."""
    order = Window.partitionBy(by).orderBy("line")
    out = headings
    for n in range(1, deepest + 1):
        # the last heading of level n, unless a higher one came after it
        at = F.last(F.when(F.col("level") == n, F.struct("line", "title")), True).over(order)
        above = F.last(F.when(F.col("level") < n, F.col("line")), True).over(order)
        out = out.withColumns({f"__t{n}": at, f"__u{n}": above})
    parts = [F.when((F.col("level") >= n) & (F.col(f"__u{n}").isNull() | (F.col(f"__t{n}")["line"] > F.col(f"__u{n}"))), F.col(f"__t{n}")["title"]) for n in range(1, deepest + 1)]
    return out.withColumn("path", F.concat_ws(" > ", *parts)).select(*headings.columns, "path")


def merged_json(current: Column, added: Column) -> Column:
    """Two JSON objects of texts as one; the added one's keys win."""
    as_map = lambda x: F.coalesce(F.from_json(x, "map<string,string>"), F.create_map().cast("map<string,string>"))
    old, new = as_map(current), as_map(added)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)))))


def written_back(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Vectors for the chunks that miss one."""
    return chunks.alias("c").join(vectors.alias("v"), key, "left").select(*[F.col(f"c.{c}") if c != "vector" else F.coalesce("c.vector", "v.vector").alias("vector") for c in chunks.columns])


def observed_types(df: DataFrame) -> DataFrame:
    """col, types: what the values of each text column look like, over all rows."""
    kind = lambda c: F.when(F.col(c).isNull(), "null").when(F.col(c).rlike(r"^-?\d+$"), "integer").when(F.col(c).rlike(r"^-?\d*\.\d+(?:[eE][+-]?\d+)?$"), "real").otherwise("text")
    sets = df.agg(*[F.array_join(F.array_sort(F.collect_set(kind(c))), ",").alias(c) for c in df.columns])
    return sets.unpivot([], df.columns, "col", "types")


def expired(rows: DataFrame, now: Column, ttl_seconds: int, created: str = "created") -> DataFrame:
    """Rows older than their time to live."""
    return rows.where(F.unix_timestamp(now) - F.unix_timestamp(created) > ttl_seconds)


def crawled(links: DataFrame, roots: DataFrame, deepest: int) -> DataFrame:
    """url, depth of all that the roots (url) reach over links (src, dst) in at most so many steps, each at its least depth."""
    seen = frontier = roots.distinct().withColumn("depth", F.lit(0))
    for depth in range(1, deepest + 1):
        frontier = links.join(frontier, F.col("src") == F.col("url")).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen


def grid(spark, values: dict[str, list], idle: dict[str, str] | None = None) -> DataFrame:
    """All combinations of parameter values; a parameter that is idle while another is off stays at its first value, once, as null."""
    from itertools import product

    rows = []
    for cell in product(*values.values()):
        row = dict(zip(values, cell))
        off = {p for p, switch in (idle or {}).items() if not row[switch]}
        if all(row[p] == values[p][0] for p in off):
            rows.append(tuple(None if p in off else row[p] for p in values))
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    return spark.createDataFrame(rows, ", ".join(f"{p} {kinds[type(v[0])]}" for p, v in values.items()))


class IndexCache:
    """Frames kept by scope as long as the data's version stays: another version builds anew and lets the old frame go."""

    def __init__(self):
        self._kept: dict[str, tuple[object, DataFrame]] = {}

    def get(self, scope: str, version: object, build) -> DataFrame:
        kept = self._kept.get(scope)
        if kept is None or kept[0] != version:
            if kept is not None:
                kept[1].unpersist()
            self._kept[scope] = kept = (version, build().persist())
        return kept[1]

    def clear(self) -> None:
        for _, df in self._kept.values():
            df.unpersist()
        self._kept.clear()
