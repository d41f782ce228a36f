"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, recomputed in double only where they may matter.

Vectors of one label are brought to unit length.  Equal ones are taken together and counted.  The rest are dealt into blocks
of at most about ``BLOCK``; a tile holds two blocks of one label.  What travels to the tiles is int8: codes q, a step s and the norm
of what is lost, with x = s q + e; since |x.y - s t q.r| <= |e_x| + |e_y| + |e_x||e_y| (unit vectors; |s q| <= 1 + |e|), a tile's
integer product tells which pairs surely link, which can't, and which may.  Vectors of pairs that may link meet once more, tile by
tile, in full precision; no pair is ever a row.

Links found in a tile are counted for each vector; of the links themselves only a spanning forest of the tile leaves it.

Defined cases: vectors that are null, zero or hold null or non-finite components, vectors with null labels, and vectors of
unlike lengths link with nothing; repeated vec_ids are rows of their own that share id and component; a null vec_id takes part and
keeps a null component unless a copy or a link has an id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch
from .graph import Forest, components

BLOCK = 1024
#: Codes whose products sum up exactly in float32 (1024 * 127 * 127 < 2^24), and what rounding may add to a bound.
WIDE, SLACK = 1024, 1e-9
#: Vectors without any vec_id get ids from here on, which no result shows.
NAMELESS = 1 << 62


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, scaled first so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantised:
    """int8 codes of unit vectors, steps, and norms of what is lost, rounded up."""

    def __init__(self, codes: np.ndarray, step: np.ndarray, lost: np.ndarray):
        self.codes, self.step, self.lost = codes, step, lost

    @staticmethod
    def of(x: np.ndarray) -> Quantised:
        step = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
        codes = np.rint(x / step[:, None]).astype(np.int8)
        return Quantised(codes, step, np.linalg.norm(x - step[:, None] * codes, axis=1) * (1 + 1e-9) + 1e-12)

    def packed(self) -> bytes:
        return self.step.tobytes() + self.lost.tobytes() + self.codes.tobytes()

    @staticmethod
    def unpacked(raw: bytes, n: int) -> Quantised:
        step, lost = (np.frombuffer(raw, np.float64, n, at) for at in (0, 8 * n))
        return Quantised(np.frombuffer(raw, np.int8, offset=16 * n).reshape(n, -1), step, lost)

    def bounds(self, other: Quantised) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds on all cosines; sums of products of at most WIDE codes are exact in float32."""
        product = np.zeros((len(self.step), len(other.step)))
        for k in range(0, self.codes.shape[1], WIDE):
            product += self.codes[:, k : k + WIDE].astype(np.float32) @ other.codes[:, k : k + WIDE].astype(np.float32).T
        product *= self.step[:, None] * other.step[None, :]
        error = self.lost[:, None] + other.lost[None, :] + self.lost[:, None] * other.lost[None, :] + SLACK
        return product - error, product + error


class Links:
    """What the links of one tile add up to: for each vector the copies it links with, and its root in the tile's forest."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray):
        self.ids, self.copies = ids, copies
        self.links, self.forest = np.zeros(len(ids), dtype=np.int64), Forest(len(ids))

    def add(self, i: int, j: np.ndarray) -> None:
        """Links of vector i with the vectors j; each link comes once."""
        self.links[i] += self.copies[j].sum()
        self.links[j] += self.copies[i]
        for k in j.tolist():
            self.forest.union(i, k)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of vectors with links, their number, and an id that stands for their component."""
        at = np.flatnonzero(self.links)
        return self.ids[at], self.links[at], self.ids[self.forest.roots()[at]]


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"))
    good = F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.exists("x", lambda v: v != 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    keyed = rows.select("vec_id", F.when(F.coalesce(good, F.lit(False)), F.sha2(F.concat_ws("|", "label", F.col("x").cast("string")), 256)).alias("vector"))
    # one row for each distinct vector of a label, with its copies' number and smallest id
    distinct = rows.where(good).select("vec_id", "label", "x", F.sha2(F.concat_ws("|", "label", F.col("x").cast("string")), 256).alias("vector"))
    distinct = scratch.save(distinct.groupBy("vector").agg(F.coalesce(F.min("vec_id"), F.lit(NAMELESS) + F.xxhash64("vector").bitwiseAND(F.lit(NAMELESS - 1))).alias("id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("x").alias("x")).withColumn("dim", F.size("x")), "distinct")
    sizes = distinct.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = distinct.join(sizes, ["label", "dim"]).select("label", "dim", "blocks", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int").alias("block"), "id", "copies", "x")

    packed_schema = "label string, dim int, blocks int, block int, ids binary, copies binary, codes binary"

    def pack(t: pa.Table) -> pa.Table:
        n = t.num_rows
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        first = lambda c: t.column(c)[0].as_py()
        codes = Quantised.of(unit(x)).packed()
        return pa.table({"label": [first("label")], "dim": [first("dim")], "blocks": [first("blocks")], "block": [first("block")], "ids": [t.column("id").to_numpy().tobytes()], "copies": [t.column("copies").to_numpy().tobytes()], "codes": [codes]}, schema=pa.schema([("label", pa.string()), *[(c, pa.int32()) for c in ("dim", "blocks", "block")], *[(c, pa.binary()) for c in ("ids", "copies", "codes")]]))

    packed = scratch.save(dealt.groupBy("label", "dim", "block").applyInArrow(pack, packed_schema), "packed")
    # tile (i, j), i <= j, of a label: block b is in (b, j) for j >= b and in (i, b) for i < b
    tiles = packed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "ids", "copies", "codes")
    out = [("label", pa.string()), *[(c, pa.int32()) for c in ("dim", "i", "j", "block")], ("id", pa.int64()), ("links", pa.int64()), ("hub", pa.int64())]
    out_schema = "label string, dim int, i int, j int, block int, id long, links long, hub long"

    def tile(t: pa.Table) -> pa.Table:
        """Sure links, summed up (with links), and the vectors of pairs that may link (links null, hub their copies)."""
        first = lambda c: t.column(c)[0].as_py()
        blocks = []
        for k in np.argsort(t.column("block").to_numpy()).tolist():
            ids, copies = (np.frombuffer(t.column(c)[k].as_py(), np.int64) for c in ("ids", "copies"))
            blocks.append((ids, copies, Quantised.unpacked(t.column("codes")[k].as_py(), len(ids)), t.column("block")[k].as_py()))
        (ids, copies, x, block), (ids2, copies2, y, block2) = blocks[0], blocks[-1]
        same, n = len(blocks) == 1, len(ids)
        low, high = x.bounds(y)
        if same:  # each pair once
            low, high = np.triu(low, 1) - 2 * np.tri(n), np.triu(high, 1) - 2 * np.tri(n)
        sure = low >= threshold
        links = Links(ids, copies) if same else Links(np.concatenate((ids, ids2)), np.concatenate((copies, copies2)))
        for i in np.flatnonzero(sure.any(axis=1)).tolist():
            links.add(i, np.flatnonzero(sure[i]) + (0 if same else n))
        may = (high >= threshold) & ~sure
        rows, columns = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        if same:
            rows, columns = np.union1d(rows, columns), columns[:0]
        a, b, c = links.table()
        again = np.concatenate((ids[rows], ids2[columns]))
        of = np.concatenate((np.full(len(a) + len(rows), block), np.full(len(columns), block2)))
        count, size = pa.array([*b.tolist(), *[None] * len(again)], pa.int64()), len(a) + len(again)
        return pa.table([pa.array([first("label")] * size, pa.string()), *[pa.array(np.full(size, first(k), np.int32)) for k in ("dim", "i", "j")], pa.array(of.astype(np.int32)), pa.array(np.concatenate((a, again))), count, pa.array(np.concatenate((c, copies[rows], copies2[columns])))], schema=pa.schema(out))

    tiled = scratch.save(tiles.groupBy("label", "dim", "i", "j").applyInArrow(tile, out_schema), "tiled")
    again = tiled.where("links IS NULL").select("i", "j", "block", "id", F.col("hub").alias("copies"), "label", "dim")

    def exact(t: pa.Table) -> pa.Table:
        """Links, in double precision, of the pairs of a tile that its codes have left open."""
        t = t.sort_by([("block", "ascending"), ("id", "ascending")])
        ids, copies, block = (t.column(c).to_numpy() for c in ("id", "copies", "block"))
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        x = unit(t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        codes, links = Quantised.of(x), Links(ids, copies)
        low, high = codes.bounds(codes)
        for i in range(len(ids)):
            j = np.flatnonzero((high[i] >= threshold) & (low[i] < threshold))
            j = j[j > i]
            if not same:
                j = j[block[j] != block[i]]
            j = j[(x[j] * x[i]).sum(axis=1) >= threshold]
            if len(j):
                links.add(i, j)
        a, b, c = links.table()
        return pa.table([pa.array(a), pa.array(b), pa.array(c)], names=["id", "links", "hub"])

    open_pairs = again.join(dealt.select("id", "label", "dim", "block", "x"), ["label", "dim", "block", "id"]).groupBy("label", "dim", "i", "j").applyInArrow(exact, "id long, links long, hub long")
    found = scratch.save(tiled.where("links IS NOT NULL").select("id", "links", "hub").unionByName(open_pairs), "found")
    groups = components(found.select(F.col("id").alias("a"), F.col("hub").alias("b")), scratch)
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    result = distinct.select("vector", "id", "copies").join(counted, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    result = result.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    result = result.withColumn("component_id", F.when(F.col("component_id") < NAMELESS, F.col("component_id")))
    return keyed.join(result, "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
