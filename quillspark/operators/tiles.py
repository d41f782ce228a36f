"""Exact all-pairs scores of vectors and queries, tile by tile: a tile is one block of vectors and one block of queries.

A tile's products are one matrix product; what leaves it is bounded by its queries, not by its pairs.  Scores that matter are summed
up again in the order of the components and rounded as Spark rounds, so results are those of `vectors.score`, bit for bit.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Most rows a block has about, of vectors and of queries; the fewest vectors for which a block is worth a tile of its own.
VECTORS, QUERIES, LEAST = 32_768, 8_192, 1_024
#: Queries taken at once, and pairs summed up at once.
AT_ONCE, PAIRS = 256, 65_536
#: A relative error of one float32 and one float64 operation.
E32, E64 = 2.0**-24, 2.0**-53


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark rounds doubles: half up, by their shortest decimal form."""
    with np.errstate(all="ignore"):
        y = np.abs(x) * 10.0**digits
        low = np.floor(y)
        out = np.copysign(np.where(y - low >= 0.5, low + 1, low) / 10.0**digits, x) + 0.0
        close = np.isfinite(x) & ((np.abs(y - low - 0.5) < 1e-4) | (y >= 2.0**50))
    for i in np.flatnonzero(close).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0 if abs(x[i]) < 1e15 else x[i]
    return np.where(np.isfinite(x), out, x)


class Block:
    """Vectors of one length: values in double precision (0 for nulls), which of them hold nulls, and their norms."""

    def __init__(self, x: np.ndarray, null: np.ndarray):
        self.x, self.null, self.norm = x, null, np.sqrt(added(x, x))

    @staticmethod
    def by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, Block]]:
        """The places of the vectors of each length, and the vectors."""
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        lengths, out = pc.list_value_length(column).to_numpy(zero_copy_only=False), {}
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            flat = (column if len(at) == len(column) else column.take(pa.array(at))).flatten()
            null = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), n).any(axis=1) if flat.null_count else np.zeros(len(at), bool)
            x = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
            out[n] = at, Block(x, null)
        return out


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows, summed up from the first component to the last."""
    s = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            s += a[:, j] * b[:, j]
    return s


class Metric:
    """One of the metrics of `vectors.score` between two blocks."""

    def __init__(self, name: str, v: Block, q: Block):
        if name not in ("dot", "normalised", "cosine"):
            raise ValueError(f"unknown metric {name}")
        self.name, self.v, self.q = name, v, q
        # what is null or zero has no direction: such pairs score 0
        self.q_flat = (q.null | (q.norm == 0)) & (name != "dot")
        self.v_flat = (v.null | (v.norm == 0)) & (name == "cosine")

    def sides(self, kind) -> tuple[np.ndarray, np.ndarray]:
        """The sides whose product scores the pairs, but for what rounding does."""
        with np.errstate(all="ignore"):
            v = self.v.x / np.where(self.v_flat, np.inf, self.v.norm)[:, None] if self.name == "cosine" else self.v.x
            q = self.q.x / np.where(self.q_flat, np.inf, self.q.norm)[:, None] if self.name != "dot" else self.q.x
            return v.astype(kind), q.astype(kind)

    def nulls(self, c: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Which pairs of vectors c and queries r score null."""
        if self.name == "cosine":
            return np.zeros(np.broadcast(c, r).shape, bool)
        return (self.v.null[c] | self.q.null[r]) & ~self.q_flat[r]

    def exact(self, c: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.empty(len(c))
        for at in range(0, len(c), PAIRS):
            i, j = c[at : at + PAIRS], r[at : at + PAIRS]
            s = added(self.v.x[i], self.q.x[j])
            with np.errstate(all="ignore"):
                if self.name == "normalised":
                    s = np.where(self.q_flat[j], 0.0, s / self.q.norm[j])
                elif self.name == "cosine":
                    s = np.where(self.q_flat[j] | self.v_flat[i], 0.0, s / (self.q.norm[j] * self.v.norm[i]))
            out[at : at + PAIRS] = s
        return out


def column_of(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def best_of_tile(vt: pa.Table, qt: pa.Table, k: int, metric: str, digits: int, other: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of vectors and queries, scores and which are null: for each query the k best of a tile, ties by the smaller id."""
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))]
    sorted_ids = pc.sort_indices(vt, sort_keys=[("id", "ascending")], null_placement="at_start").to_numpy()
    place = np.empty(len(sorted_ids), int)
    place[sorted_ids] = np.arange(len(sorted_ids))
    queries = Block.by_length(qt.column("q"))
    for n, (v_at, v) in Block.by_length(vt.column("v")).items():
        if n not in queries:
            continue
        q_at, q = queries[n]
        m = Metric(metric, v, q)
        a, b = m.sides(np.float32)
        with np.errstate(all="ignore"):
            longest = np.linalg.norm(a.astype(np.float64), axis=1).max(initial=0.0)
            margin = 1.1 * 10.0**-digits + 4 * (n + 8) * E32 * longest * np.linalg.norm(b.astype(np.float64), axis=1)
        margin = np.nan_to_num(margin, nan=np.inf, posinf=np.inf)
        ids = qids = order = None
        if other:
            ids, qids = column_of(vt, "id")[v_at], column_of(qt, "query_id")[q_at]
            order = np.argsort(ids, kind="stable")
        for lo in range(0, len(q_at), AT_ONCE):
            r_all = np.arange(lo, min(lo + AT_ONCE, len(q_at)))
            with np.errstate(all="ignore"):
                s = b[r_all] @ a.T
            if not np.isfinite(s).all():
                s[~np.isfinite(s)] = np.inf  # looked at one by one
            if v.null.any() or q.null.any():
                s[m.nulls(np.arange(len(v_at))[None, :], r_all[:, None])] = -np.inf
            if other:
                first, last = (np.searchsorted(ids[order], qids[r_all], side) for side in ("left", "right"))
                for i in np.flatnonzero(last > first).tolist():
                    s[i, order[first[i] : last[i]]] = -np.inf
            least = np.full(len(r_all), -np.inf) if len(v_at) <= k else np.partition(s, len(v_at) - k, axis=1)[:, len(v_at) - k].astype(np.float64)
            with np.errstate(all="ignore"):
                floor = np.where(np.isinf(least) & (least > 0), np.inf, least - margin[r_all])
            r, c = np.nonzero(s >= np.where(np.isnan(floor), -np.inf, floor).astype(np.float64)[:, None])
            r = r_all[r]
            if other:
                apart = ids[c] != qids[r]
                r, c = r[apart], c[apart]
            null = m.nulls(c, r)
            score = half_up(m.exact(c, r), digits)
            key = np.where(null, np.inf, np.where(np.isnan(score), -np.inf, -score))
            by = np.lexsort((place[v_at[c]], key, null, ~np.isnan(score) | null, r))
            starts = np.flatnonzero(np.diff(r[by], prepend=-1))
            kept = by[np.arange(len(by)) - np.repeat(starts, np.diff(starts, append=len(by))) < k]
            found.append((v_at[c[kept]], q_at[r[kept]], score[kept], null[kept]))
    return tuple(np.concatenate(x) for x in zip(*found))


def blocks_of(vectors: DataFrame, queries: DataFrame, scope: list[str], most: tuple[int, int] = (VECTORS, QUERIES)) -> tuple[int, int]:
    """How many blocks the vectors and the queries (of the largest scope) fall into."""
    def rows(df):
        return df.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()

    (n, scopes), (m, _) = rows(vectors), rows(queries)
    nq = max(1, -(-m // most[1]))
    tasks = 2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-n // most[0]), min(-(-tasks // (nq * max(scopes, 1))), n // LEAST)), nq


def block_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def tiled(vectors: DataFrame, queries: DataFrame, run, schema: T.StructType, scope: list[str] | None = None, by: str = "id", most: tuple[int, int] = (VECTORS, QUERIES)) -> DataFrame:
    """run(vectors, queries) of each tile, both as Arrow tables; vectors with equal `by` share a block."""
    scope = scope or []
    vectors, queries = vectors.where("v IS NOT NULL"), queries.where("q IS NOT NULL")
    for c in scope:  # nulls meet nothing
        vectors, queries = vectors.where(F.col(c).isNotNull()), queries.where(F.col(c).isNotNull())
    nv, nq = blocks_of(vectors, queries, scope, most)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select("*", block_of(F.col(by), nv).alias("__i"), every(nq).alias("__j"))
    q = queries.select("*", every(nv).alias("__i"), block_of(F.col("query_id"), nq).alias("__j"))
    names = schema.names

    def tile(vt: pa.Table, qt: pa.Table) -> pa.Table:
        return run(vt, qt).select(names)

    keys = [*scope, "__i", "__j"]
    return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(tile, schema)


def topk_pairs(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "dot", digits: int = 6, scope: list[str] | None = None, other: bool = False) -> DataFrame:
    """Pairs with their score that hold the k best vectors of each query, k a tile: query_id, id, the other columns of both but q and v, score.

    other: a vector with the query's own id is left out, and null ids.
    """
    scope = scope or []
    if other:
        vectors, queries = vectors.where("id IS NOT NULL"), queries.where("query_id IS NOT NULL")
    from_q = [f for f in queries.schema.fields if f.name not in ("q", *scope)]
    from_v = [f for f in vectors.schema.fields if f.name != "v" and f.name not in scope]
    schema = T.StructType([*from_q, *from_v, T.StructField("score", T.DoubleType())])

    def run(vt: pa.Table, qt: pa.Table) -> pa.Table:
        c, r, score, null = best_of_tile(vt, qt, k, metric, digits, other)
        of_q, of_v = qt.select([f.name for f in from_q]).take(pa.array(r)), vt.select([f.name for f in from_v]).take(pa.array(c))
        return pa.table([*of_q.columns, *of_v.columns, pa.array(score, mask=null)], names=[*of_q.column_names, *of_v.column_names, "score"])

    return tiled(vectors, queries, run, schema, scope)


def page_pairs(vectors: DataFrame, queries: DataFrame, how: str, digits: int, score_digits: int = 6) -> DataFrame:
    """query_id, page_id, score: the rounded scores of a page's vectors (id, v, page_id) by max, sum or mean; a page lies in one block."""
    schema = T.StructType([queries.schema["query_id"], vectors.schema["page_id"], T.StructField("score", T.DoubleType())])

    def run(vt: pa.Table, qt: pa.Table) -> pa.Table:
        pages = vt.column("page_id").combine_chunks().dictionary_encode(null_encoding="encode")
        pages = pages.combine_chunks() if isinstance(pages, pa.ChunkedArray) else pages
        names, page = pages.dictionary, pages.indices.to_numpy(zero_copy_only=False)
        m = len(qt)
        total = np.full((m, len(names)), -np.inf if how == "max" else 0.0)
        seen, pairs = np.zeros((m, len(names)), np.int64), np.zeros((m, len(names)), bool)
        queries = Block.by_length(qt.column("q"))
        for n, (v_at, v) in Block.by_length(vt.column("v")).items():
            if n not in queries:
                continue
            q_at, q = queries[n]
            by = np.argsort(page[v_at], kind="stable")
            own = page[v_at][by]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            metric = Metric("dot", v, q)
            for lo in range(0, len(q_at), AT_ONCE):
                r = np.arange(lo, min(lo + AT_ONCE, len(q_at)))
                s = all_scores(metric, r, score_digits)[:, by]
                null = metric.nulls(by[None, :], r[:, None])
                cell = np.ix_(q_at[r], own[starts])
                if null.any():
                    s[null] = -np.inf if how == "max" else 0.0
                with np.errstate(all="ignore"):
                    part = (np.maximum if how == "max" else np.add).reduceat(s, starts, axis=1)
                    total[cell] = np.maximum(total[cell], part) if how == "max" else total[cell] + part
                seen[cell] += np.add.reduceat(~null, starts, axis=1, dtype=np.int64)
                pairs[cell] = True
        with np.errstate(all="ignore"):
            total = total / seen if how == "mean" else total
        r, c = np.nonzero(pairs)
        none = seen[r, c] == 0
        score = half_up(np.where(none, 0.0, total[r, c]), digits)
        return pa.table([qt.column("query_id").take(pa.array(r)), pa.chunked_array([names.take(pa.array(c))]), pa.array(score, mask=none)], names=["query_id", "page_id", "score"])

    return tiled(vectors.select("id", "v", "page_id"), queries.select("query_id", "q"), run, schema, by="page_id", most=(2048, 512))  # every pair of a page and a query leaves its tile


def ranks_of(vectors: DataFrame, queries: DataFrame, wanted: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, id, dense_rank of the wanted rows (query_id, id, score: rounded dot products): their places in each query's whole list.

    A tile counts which of its vectors come before each wanted row; ids are whole numbers.
    """
    lists = wanted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("w"))
    q = queries.join(lists, "query_id").select("query_id", "q", F.col("w.id").alias("ids"), F.col("w.score").alias("scores"))
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])

    def run(vt: pa.Table, qt: pa.Table) -> pa.Table:
        queries, out = Block.by_length(qt.column("q")), []
        places, ids_of, scores_of = (qt.column(c).combine_chunks() for c in ("query_id", "ids", "scores"))
        for n, (v_at, v) in Block.by_length(vt.column("v")).items():
            if n not in queries:
                continue
            q_at, q = queries[n]
            ids = column_of(vt, "id")[v_at]
            by = np.argsort(ids, kind="stable")
            sorted_ids, metric = ids[by], Metric("dot", v, q)
            for lo in range(0, len(q_at), AT_ONCE):
                r = np.arange(lo, min(lo + AT_ONCE, len(q_at)))
                s = all_scores(metric, r, digits)[:, by]
                s[metric.nulls(by[None, :], r[:, None])] = -np.inf
                s[np.isnan(s)] = np.inf
                keys = before(s, np.arange(len(by))[None, :], digits)
                if keys is not None:
                    keys.sort(axis=1)
                for i, at in enumerate(q_at[r].tolist()):
                    own_ids = ids_of[at].values.to_numpy()
                    own = scores_of[at].values.to_numpy(zero_copy_only=False).astype(np.float64)
                    own = np.where(scores_of[at].values.is_null().to_numpy(zero_copy_only=False), -np.inf, np.where(np.isnan(own), np.inf, own))
                    place = np.searchsorted(sorted_ids, own_ids)
                    own_keys = None if keys is None else before(own, place, digits)
                    if own_keys is None:
                        count = [int(((s[i] > x) | ((s[i] == x) & (sorted_ids < k))).sum()) for x, k in zip(own, own_ids)]
                    else:
                        count = np.searchsorted(keys[i], own_keys)
                    out.append((at, own_ids, np.asarray(count, np.int64)))
        r = np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64)
        ids, counts = (np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in (1, 2))
        return pa.table([places.take(pa.array(r)), pa.array(ids), pa.array(counts)], names=["query_id", "id", "n"])

    counts = tiled(vectors, q, run, schema, most=(VECTORS, 1024))
    return counts.groupBy("query_id", "id").agg((F.sum("n") + 1).alias("dense_rank"))


def before(s: np.ndarray, place: np.ndarray, digits: int) -> np.ndarray | None:
    """Whole numbers that order rounded scores, the largest first, then places; None for scores that are too large for it."""
    r, most = np.rint(np.nan_to_num(s, posinf=0.0, neginf=0.0) * 10.0**digits), 2.0**40
    if np.abs(r).max(initial=0.0) >= most:
        return None
    r = np.where(s == np.inf, most, np.where(s == -np.inf, -most, r)).astype(np.int64)
    return -r * (1 << 22) + place


def all_scores(m: Metric, r: np.ndarray, digits: int) -> np.ndarray:
    """Rounded scores of queries r with all vectors of a block; what lies near a half, or is not finite, is summed up in order."""
    a, b = m.sides(np.float64)
    with np.errstate(all="ignore"):
        s = b[r] @ a.T
        y = np.abs(s) * 10.0**digits
        low = np.floor(y)
        wide = m.v.norm.max(initial=0.0) if m.name != "cosine" else 1.0
        wide = wide * (m.q.norm[r].max(initial=0.0) if m.name == "dot" else 1.0)
        near = 1e-6 + 4 * (a.shape[1] + 8) * E64 * wide * 10.0**digits
        odd = ~(np.abs(y - low - 0.5) > near) | (y >= 2.0**50)
        out = np.copysign(np.where(y - low >= 0.5, low + 1, low) / 10.0**digits, s) + 0.0
    if odd.any():
        i, c = np.nonzero(odd)
        out[i, c] = half_up(m.exact(c, r[i]), digits)
    return out
