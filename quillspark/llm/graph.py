"""Connected components of link tables, without bringing links to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import Scratch


class Forest:
    """Union-find over the positions 0 .. n-1 of one block of rows."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], dtype=np.int64)


#: Links that one task settles in memory; more take rounds of joins until as few are left or nothing changes.
AT_ONCE = 200_000


def settled(batches):
    """(u, v) of each node and the smallest it reaches, for the links of one task."""
    import pyarrow as pa

    got = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if got:
        names, at = np.unique(np.concatenate(got, axis=1), return_inverse=True)
        forest = Forest(len(names))
        for x, y in at.reshape(2, -1).T.tolist():
            forest.union(x, y)
        root = forest.roots()
        far = root != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[root[far]])], ["u", "v"])


def components(links: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 40) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (a long, b long).

    Alternates large-star and small-star steps: each hooks a node's neighbours to the smallest around it, so that the depth
    halves or better each round; every round is a written table.  Ends when a round changes nothing, or, with the same outcome,
    in one task once no more than AT_ONCE links are left.
    """
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    seen = None
    for k in range(1, rounds + 1):
        if edges.count() <= AT_ONCE:
            edges = scratch.save(edges.coalesce(1).mapInArrow(settled, "u long, v long"), f"{name}-settled")
            break
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours go to the smallest of the neighbourhood
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = scratch.save(small.where("u <> v").distinct(), f"{name}-{k}")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or seen == (state["n"], state["h"]):
            break
        seen = (state["n"], state["h"])
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # settled: every node points at its component's smallest node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
