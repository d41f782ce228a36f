"""Exact n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct 5-word shingles (64-bit hashes); documents of equal sets are one node, so copies
cost nothing more.  Nodes that may link share one of their first n - ceil(0.8 n) + 1 shingles in one global order (frequent
shingles last, else by hash): the prefix filter, which loses no link.  The first shingle that two sets share has all others behind
it, so its places in both bound the overlap.  Prefix postings meet in groups by hash; one without a partner that sizes and places let link is let go.

1. Each node goes to the leader it shares most prefix shingles with; a leader's nodes form tiles of bounded size.
2. Inside a tile nodes stand in bands of sizes that can reach the threshold; bit counts of their hashed bitmaps bound each
   overlap from above, and only pairs within the bound are intersected exactly, as sorted arrays.  Pairs already joined are
   skipped: what leaves a tile is one star for each of its components, however many copies there are.
3. Postings whose nodes are by then in different components give the pairs that no tile has seen, held against their bitmaps.
   First, in two large postings of each node, the likeliest pair of every two components among neighbours in size is
   intersected exactly, which joins what the tiles of one large group have split; only the graph of components is settled again.  Then all pairs still
   in different components and within the bound are intersected exactly, and the graph of components is settled once more.

Only arrays of postings, candidate pairs and stars move; fingerprints and links never reach the driver.  The set of frequent
shingles (at most HEAVY_KEPT) only orders the filter: any order gives the same links.

Defined cases: null and empty texts, and texts without words, have empty sets and link with nothing; fewer than n words make one
shingle; rows of equal id share a component, whatever their texts; other columns are ignored; an empty table gives no rows.
Sets are compared by 64-bit hashes: two different sets of one fingerprint are expected once in some 10^9 documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytes import chunks, mix64, shingle_sets
from .common import Scratch, free_shuffles, give_back, lean, parts_for, text_rows
from .graph import Forest, components

HEAVY_KEPT = 200_000
#: Documents of one task, and of all of them, from which on a shingle counts as frequent; the same at every size.
OFTEN_HERE, OFTEN = 8, 32
#: Nodes of a leader that meet in one tile.
TILE = 256
#: Neighbours in size that are paired first, in postings of more nodes; all postings are paired in full afterwards.
NEAR = 32
#: Nodes of a posting up to which postings of one first node meet in one part, so that nodes that share a passage meet once; larger ones are dealt one by one.
TOGETHER = 256
#: Pairs whose bitmaps are compared at once, and bytes of bitmaps.
PAIRS, BITMAP_BYTES = 1 << 20, 1 << 24


def fingerprint(s: np.ndarray) -> int:
    """One signed 64-bit value for a set of hashes."""
    return int(mix64(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def needed(nx, ny, percent: int):
    """The least overlap at which two sets of these sizes link: percent * (nx + ny) / (100 + percent), rounded up."""
    return -((-percent * (nx + ny)) // (100 + percent))


def prefix(s: np.ndarray, heavy: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set, frequent ones last and the most frequent (by level) last of all, one of which any partner shares."""
    length = len(s) - (-((-percent * len(s)) // 100)) + 1
    if not len(heavy):
        return s[:length]
    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
    return s[np.argsort(np.where(heavy[at] == s, level[at], 0), kind="stable")[:length]]


def reach(size: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """The largest partner that a set of this size can link with if the first shingle they share, in the global order, is its at-th."""
    return (100 + percent) * (size - at) // percent - size


#: A prefix posting: 32 bits of the hash beyond its part (postings only propose pairs), node, size of the set, place in the order.
POSTING = np.dtype([("h", "<u4"), ("node", "<i8"), ("size", "<i4"), ("at", "<i4")])


def packed(rows: np.ndarray) -> bytes:
    """Records byte by byte: first bytes of all of them, second bytes, ...; bytes that are mostly zero then compress away."""
    return rows.view(np.uint8).reshape(len(rows), rows.itemsize).T.tobytes()


def unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def starts(h: np.ndarray) -> np.ndarray:
    """Of each entry the place where its run of equal values begins."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
    return np.repeat(first, np.diff(np.append(first, len(h))))


def paired(rows: np.ndarray, percent: int) -> np.ndarray:
    """Which postings, in order of hash, then size, have a partner that sizes and places let link; beyond NEAR neighbours all of a run count."""
    size = rows["size"].astype(np.int64)
    most, start = reach(size, rows["at"], percent), starts(rows["h"])
    out, active = np.zeros(len(rows), bool), np.arange(len(rows))
    for offset in range(1, NEAR + 2):
        active = active[active - offset >= start[active]]
        active = active[100 * size[active - offset] >= percent * size[active]]
        if offset <= NEAR:
            ok = active[(size[active - offset] <= most[active]) & (size[active] <= most[active - offset])]
            out[ok] = out[ok - offset] = True
    many = np.zeros(len(rows), bool)
    many[start[active]] = True
    return out | many[start]


def bits_for(size: int) -> int:
    """Bits of the bitmap of a set: four to eight for each element of a small set, two to four for each of a large one."""
    return min(1 << 20, max(256, min(1024, 1 << (4 * size - 1).bit_length()), 1 << (2 * size - 1).bit_length()))


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Bit h modulo bits is set for each hash h; halves of a bitmap fold onto one another."""
    out = np.zeros(bits // 64, dtype=np.uint64)
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (in the last axis) of so many words, halves laid over one another."""
    while x.shape[-1] > width:
        half = x.shape[-1] // 2
        x = x[..., :half] | x[..., half:]
    return x


class Bitmaps:
    """Bitmaps of many sets, stacked by width."""

    def __init__(self, bits: list[bytes], sizes: np.ndarray):
        self.sizes, self.width = sizes, np.array([len(x) // 8 for x in bits], dtype=np.int64)
        self.place, self.stacks = np.zeros(len(bits), dtype=np.int64), {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.stacks[w] = np.frombuffer(b"".join(bits[k] for k in at.tolist()), dtype=np.uint64).reshape(len(at), w)

    def slack(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """How far the bound on each overlap is above what a link needs; negative: no link."""
        out = np.empty(len(i), dtype=np.int64)
        kinds, kind = np.unique(np.stack([self.width[i], self.width[j]], axis=1), axis=0, return_inverse=True)
        count = lambda v: np.bitwise_count(v).sum(axis=1, dtype=np.int64)
        for n, (wi, wj) in enumerate(kinds.tolist()):
            at = np.flatnonzero(kind.reshape(-1) == n)
            step = max(1, BITMAP_BYTES // (8 * max(wi, wj)))
            for k in (at[m : m + step] for m in range(0, len(at), step)):
                x = folded(self.stacks[wi][self.place[i[k]]], min(wi, wj))
                y = folded(self.stacks[wj][self.place[j[k]]], min(wi, wj))
                out[k] = count(x & y) + np.minimum(self.sizes[i[k]] - count(x), self.sizes[j[k]] - count(y))
        return out - needed(self.sizes[i], self.sizes[j], percent)


def posting_pairs(h: np.ndarray, doc: np.ndarray, component: np.ndarray, maps: Bitmaps, percent: int, near: int | None = None, most: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """(place, place, slack) of documents that share a posting, stand in different components and whose sizes, places in the order and bitmaps let them link.

    h, doc (a place among the bitmaps) and most (the reach of each) are the postings, in order of hash, then size.  With near, only that many neighbours pair.
    """
    sizes, count = maps.sizes, len(maps.sizes)
    start, held, total = starts(h), [], 0
    active = np.arange(len(h))

    def settle():
        i, j = np.divmod(np.unique(np.concatenate(held)), count)
        slack = maps.slack(i, j, percent)
        return np.stack([i, j, slack], axis=1)[slack >= 0]

    offset = 1
    while len(active) and (near is None or offset <= near):
        active = active[active - offset >= start[active]]
        # smaller partners stand further off: who is out of reach now stays so
        active = active[100 * sizes[doc[active - offset]] >= percent * sizes[doc[active]]]
        for k in (active[m : m + PAIRS] for m in range(0, len(active), PAIRS)):
            i, j = doc[k], doc[k - offset]
            apart = component[i] != component[j]
            if most is not None:
                apart &= (sizes[j] <= most[k]) & (sizes[i] <= most[k - offset])
            held.append(np.maximum(i, j)[apart] * count + np.minimum(i, j)[apart])
            total += int(apart.sum())
            if total > PAIRS:
                yield settle()
                held, total = [], 0
        offset += 1
    if total:
        yield settle()


def tile_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the sets of a tile into their components."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order])
    bits = bits_for(int(np.median(sizes)))
    maps = np.array([bitmap(sets[k], bits) for k in order])
    spare = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)  # elements beyond one a bit
    component = np.arange(len(sets))
    out = []
    for i in range(1, len(sets)):
        low = int(np.searchsorted(sizes, -((-percent * sizes[i]) // 100)))  # the band of smaller partners
        while True:
            j = low + np.flatnonzero(component[low:i] != component[i])
            common = np.bitwise_count(maps[j] & maps[i]).sum(axis=1, dtype=np.int64)
            bound = common + np.minimum(spare[j], spare[i])
            low_next = None
            for k in j[bound >= needed(sizes[j], sizes[i], percent)].tolist():
                if overlap(sets[order[k]], sets[order[i]]) >= needed(int(sizes[k]), int(sizes[i]), percent):
                    out.append((int(order[k]), int(order[i])))
                    component[component == component[k]] = component[i]
                    low_next = k + 1
                    break
            if low_next is None:
                break
            low = low_next
    return out


def _scan(percent: int, n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: doc_id, size, node; kind 1: shingle, documents of this task that have it (where they are many)."""
        seen: set[int] = set()
        tally, pending = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []
        names = ["kind", "a", "b", "c"]

        def settle():
            nonlocal tally
            parts = np.concatenate([tally[0], *pending])
            weight = np.concatenate([tally[1], np.ones(len(parts) - len(tally[0]), np.int64)])
            values, at = np.unique(parts, return_inverse=True)
            tally = values, np.bincount(at, weights=weight, minlength=len(values)).astype(np.int64)
            pending.clear()
            if len(values) > 2_000_000:  # rare ones are let go: the tally only orders the filter
                keep = tally[1] > 1
                tally = values[keep], tally[1][keep]

        for batch in batches:
            for part, data, offsets in chunks(batch):
                sets = shingle_sets(data, offsets, n)
                nodes = [fingerprint(s) for s in sets]
                for s, node in zip(sets, nodes):
                    if len(s) and node not in seen:
                        seen.add(node)
                        pending.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), batch.column(0).slice(part.start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())], names)
                if sum(map(len, pending)) > 1_000_000:
                    settle()
        if pending:
            settle()
        many = np.flatnonzero(tally[1] >= OFTEN_HERE)
        if len(many):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(many), np.int32)), pa.array(tally[0][many].view(np.int64)), pa.array(tally[1][many]), pa.array(np.zeros(len(many), np.int64))], names)

    return rows


def groups(documents: DataFrame, scratch: Scratch, percent: int = 80, n: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, size, node) of every row; the components (node, component) that tiles join; and those (node, component) of the components among them that the last links join."""
    spark = documents.sparkSession
    texts = text_rows(documents)
    parts = parts_for(documents)
    scan = scratch.save(texts.mapInArrow(lean(_scan(percent, n)), "kind int, a long, b long, c long"), "scan")
    docs = scan.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("size"), F.col("c").alias("node"))
    often = scan.where("kind = 1").groupBy("a").agg(F.sum("b").alias("k")).where(F.col("k") >= OFTEN)
    top = often.orderBy(F.desc("k"), "a").limit(HEAVY_KEPT).collect()  # bounded; an order, not a filter
    hashes = np.array([r["a"] for r in top], dtype=np.int64).view(np.uint64)
    level = np.array([r["k"].bit_length() for r in top], dtype=np.int8)
    heavy = spark.sparkContext.broadcast((np.sort(hashes), level[np.argsort(hashes)]))

    def postings(batches):
        """Prefix postings, dealt by hash into packed rows."""
        seen: set[int] = set()
        held, dealt, count = [], [], 0

        def flush():
            rows = np.concatenate(held)
            p = np.concatenate(dealt)
            order = np.argsort(p, kind="stable")
            rows, cuts = rows[order], np.searchsorted(p[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([packed(rows[cuts[k] : cuts[k + 1]]) for k in full.tolist()], pa.binary())], ["p", "v"])

        for batch in batches:
            for _, data, offsets in chunks(batch):
                for s in shingle_sets(data, offsets, n):
                    if not len(s) or (node := fingerprint(s)) in seen:
                        continue
                    seen.add(node)
                    first = prefix(s, *heavy.value, percent)
                    rows = np.empty(len(first), dtype=POSTING)
                    rows["h"], rows["node"], rows["size"], rows["at"] = (first // np.uint64(parts)).astype(np.uint32), node, len(s), np.arange(len(first))
                    held.append(rows)
                    dealt.append((first % np.uint64(parts)).astype(np.int32))
                    count += len(rows)
                if count > 500_000:
                    yield flush()
                    held, dealt, count = [], [], 0
        if held:
            yield flush()

    def meet(t: pa.Table) -> pa.Table:
        """Of postings that several nodes share which sizes and places let link: each node and the leader of the group, counted; and the postings themselves, each with its reach."""
        rows = np.concatenate([unpacked(v, POSTING) for v in t.column("v").to_pylist()])
        rows = rows[np.lexsort((rows["node"], rows["size"], rows["h"]))]
        rows = rows[np.concatenate(([True], (rows["h"][1:] != rows["h"][:-1]) | (rows["node"][1:] != rows["node"][:-1])))]  # copies in several tasks
        rows = rows[paired(rows, percent)]
        start, node, size = starts(rows["h"]), rows["node"], rows["size"].astype(np.int64)
        first = np.flatnonzero(start == np.arange(len(rows)))
        lead = np.repeat(np.minimum.reduceat(node, first) if len(first) else node, np.diff(np.append(first, len(rows))))
        pairs, k = np.unique(np.stack([node, lead], axis=1)[node != lead], axis=0, return_counts=True)
        h = rows["h"].astype(np.int64) * parts + t.column("p")[0].as_py()
        m, n_rows = len(pairs), len(rows)
        give_back()
        return pa.table({
            "kind": np.concatenate((np.zeros(m, np.int32), np.ones(n_rows, np.int32))), "a": np.concatenate((pairs[:, 0], node)), "b": np.concatenate((pairs[:, 1], h)),
            "c": np.concatenate((k.astype(np.int64), reach(size, rows["at"], percent))),
        }, schema=pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())]))

    met = scratch.save(texts.mapInArrow(lean(postings), "p int, v binary").groupBy("p").applyInArrow(meet, "kind int, a long, b long, c long"), "met")
    free_shuffles(spark)
    led = met.where("kind = 0").groupBy(F.col("a").alias("node"), F.col("b").alias("leader")).agg(F.sum("c").alias("k")).groupBy("node").agg(F.max_by("leader", F.struct("k", "leader")).alias("leader"))
    led = scratch.save(led, "led")
    # every node that shares a posting, with the document that stands for it
    reps = docs.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"))
    alive = met.where("kind = 1").select(F.col("a").alias("node")).distinct()
    reps_alive = scratch.save(reps.join(alive, "node", "left_semi"), "reps")

    # tiles: a leader's nodes, in parts of about TILE, the leader in each; texts join their places in them, so that they move once for both
    counts = led.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    members = led.join(counts, "leader").select("node", "leader", F.pmod("node", F.col("tiles")).cast("int").alias("tile"))
    leaders = counts.select(F.col("leader").alias("node"), "leader", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    places = reps_alive.join(members, "node", "left").withColumn("main", F.lit(True)).unionByName(reps_alive.join(leaders, "node").withColumn("main", F.lit(False)))

    def described(batches):
        """Each place with its text, and the bitmap where it is the node's main one."""
        for batch in batches:
            for part, data, offsets in chunks(batch):
                sets = shingle_sets(data, offsets, n)
                rest = batch.slice(part.start, len(sets))
                keep = [k for k, (s, node) in enumerate(zip(sets, rest.column(2).to_pylist())) if fingerprint(s) == node]  # a repeated id may have another text
                main = rest.column(5).to_pylist()
                bits = [bitmap(sets[k], bits_for(len(sets[k]))).tobytes() if main[k] else b"" for k in keep]
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in rest.columns), pa.array(bits, pa.binary())], [*rest.schema.names, "bits"])

    placed_texts = texts.join(places, "doc_id").select("doc_id", "text", "node", "leader", "tile", "main", "size")
    nodes = scratch.save(placed_texts.mapInArrow(lean(described), "doc_id long, text string, node long, leader long, tile int, main boolean, size long, bits binary"), "nodes")
    free_shuffles(spark)

    def tile(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        ids = t.column("doc_id").to_numpy()
        batch = t.select(["text"]).combine_chunks().to_batches()[0]
        sets = [s for _, data, offsets in chunks(batch) for s in shingle_sets(data, offsets, n)]
        joins = Forest(len(sets))
        for x, y in tile_forest(sets, percent):
            joins.union(x, y)
        root = joins.roots()
        return pa.table({"a": ids[root], "b": ids}).filter(pa.array(root != np.arange(len(sets)), pa.bool_()))

    tiles = nodes.where("tile IS NOT NULL").select("leader", "tile", "doc_id", "text").groupBy("leader", "tile").applyInArrow(tile, "a long, b long")
    joined = scratch.save(tiles, "joined")
    free_shuffles(spark)

    # postings of pairs that are still apart
    near = components(joined, scratch, "first")

    def placed(last: DataFrame) -> DataFrame:
        """node, component of all nodes that share postings."""
        return reps_alive.join(last.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("node", F.coalesce("component", "doc_id").alias("component"))

    def sift(t: pa.Table) -> pa.Table:
        """Postings that hold several components, with how many nodes each has and the part it is dealt to."""
        h, node, most, c = (t.column(k).to_numpy() for k in ("h", "node", "most", "component"))
        order = np.argsort(h, kind="stable")
        h, node, most, c = h[order], node[order], most[order], c[order]
        start = starts(h)
        first = np.flatnonzero(start == np.arange(len(h)))
        length = np.diff(np.append(first, len(h)))
        several = np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
        by = np.where(length <= TOGETHER, mix64(np.minimum.reduceat(node, first).view(np.uint64)), mix64(h[first].view(np.uint64))) % np.uint64(parts)
        keep = np.repeat(several, length)
        return pa.table({"h": h[keep], "node": node[keep], "most": most[keep], "k": np.repeat(length, length)[keep], "p": np.repeat(by.astype(np.int32), length)[keep]})

    def apart(rows: DataFrame, last: DataFrame) -> DataFrame:
        """Of postings (h, node, most) those that hold several components."""
        return rows.join(placed(last), "node").groupBy(F.pmod("h", F.lit(parts)).alias("of")).applyInArrow(sift, "h long, node long, most long, k long, p int")

    def across(neighbours: int | None):
        def pairs(t: pa.Table) -> pa.Table:
            """Pairs of the posting groups of one part, from different components, of sizes, places and bitmaps that let them link."""
            d, s, c = (t.column(k).to_numpy() for k in ("doc_id", "size", "component"))
            lists = t.column("postings").combine_chunks()
            (h, most), doc = (x.to_numpy() for x in lists.flatten().flatten()), np.repeat(np.arange(len(d)), lists.value_lengths().to_numpy())
            order = np.lexsort((d[doc], s[doc], h))
            out = [np.zeros((0, 5), np.int64)]
            for i, j, slack in (p.T for p in posting_pairs(h[order], doc[order], c, Bitmaps(t.column("bits").to_pylist(), s), percent, neighbours, most[order])):
                i, j = np.where(c[i] < c[j], i, j), np.where(c[i] < c[j], j, i)
                out.append(np.stack([c[i], c[j], -slack, d[i], d[j]], axis=1))
            found = np.unique(np.concatenate(out), axis=0)  # by component pair, likeliest first
            give_back()
            if neighbours:
                found = found[np.unique(found[:, :2], axis=0, return_index=True)[1]]
            return pa.table({k: found[:, n] for n, k in enumerate(("x", "y", "loose", "a", "b"))})

        return pairs

    def exact(batches):
        for b in batches:
            p, q = ([s for _, data, offsets in chunks(b, k) for s in shingle_sets(data, offsets, n)] for k in (2, 3))
            ok = [overlap(s, t) >= needed(len(s), len(t), percent) for s, t in zip(p, q)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    whole, bitmaps = nodes.where("main").select("doc_id", "text"), nodes.where("main").select("node", "doc_id", "size", "bits")

    def late(rows: DataFrame, last: DataFrame, neighbours: int | None, name: str) -> DataFrame:
        """Components of the graph whose nodes are components, from the pairs between them that link."""
        dealt = rows.repartition("node").groupBy("node", "p").agg(F.collect_list(F.struct("h", "most")).alias("postings")).join(bitmaps.join(placed(last), "node"), "node").drop("node")
        pairs = dealt.groupBy("p").applyInArrow(across(neighbours), "x long, y long, loose long, a long, b long")
        pairs = pairs.groupBy("x", "y").agg(F.min(F.struct("loose", "a", "b")).alias("m")).select("x", "y", "m.a", "m.b") if neighbours else pairs.select("x", "y", "a", "b").distinct()
        pairs = scratch.save(pairs, f"{name}-pairs")
        asked = scratch.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-asked")
        some = whole.join(asked, "doc_id", "left_semi")  # only texts of candidates move on
        linked = pairs.join(some.toDF("a", "text_a"), "a").join(some.toDF("b", "text_b"), "b").select("x", "y", "text_a", "text_b").mapInArrow(exact, "a long, b long")
        return components(linked, scratch, name)

    rest = scratch.save(apart(met.where("kind = 1").select(F.col("b").alias("h"), F.col("a").alias("node"), F.col("c").alias("most")), near), "apart")
    free_shuffles(spark)
    large, small = rest.where(F.col("k") > NEAR), rest.where(F.col("k") <= NEAR)
    chance = F.xxhash64("h", "node")
    both = large.groupBy("node").agg(F.min_by(F.struct("h", "most", "p"), chance).alias("x"), F.max_by(F.struct("h", "most", "p"), chance).alias("y"))
    some = both.select("node", F.explode(F.array_distinct(F.array("x", "y"))).alias("x")).select("node", "x.*")
    second = late(some, near, NEAR, "second")
    moved = near.join(second.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(second.join(near, "node", "left_anti"))
    near = scratch.save(moved, "near")
    last = late(apart(large.select("h", "node", "most"), near).unionByName(small), near, None, "last")
    free_shuffles(spark)
    return docs, near, last


def cluster(documents: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    scratch = Scratch(documents.sparkSession, "jaccard")
    docs, near, last = groups(documents, scratch, percent, n)
    reps = docs.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k"))
    # only nodes with copies or links have anything to tell
    first = reps.join(near.toDF("rep", "first"), "rep", "left").withColumn("first", F.coalesce("first", "rep"))
    told = first.join(last.toDF("first", "component"), "first", "left").select("node", "k", "rep", F.coalesce("component", "first").alias("component")).where("k > 1 OR component <> rep").select("node", "component")
    scratch.drop("nodes", "met", "led", "joined", "apart", "second-pairs", "second-asked", "last-pairs", "last-asked")
    return docs.join(told, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(documents: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """The documents that stand for their group (the smallest doc_id), with all their columns.

    A row without an id takes part by its text: it goes where its group holds an id or one of its copies stands already, else it
    stays.  Rows without an id and without words are all kept.
    """
    made = F.lit(1 << 62) + F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit((1 << 62) - 1))  # above all ids
    own = "id" + "_" * max(map(len, documents.columns))  # longer than any name that is there
    rows = documents.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), made))
    kept = cluster(rows.select(F.col(own).alias("doc_id"), "text"), percent, n).where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0d]")
    named, unnamed = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    rows = named.unionByName(unnamed.where(~worded)).unionByName(unnamed.where(worded).dropDuplicates([own]))
    return rows.join(kept, own, "left_semi").drop(own)
