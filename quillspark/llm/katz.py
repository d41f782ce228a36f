"""Language-model scores by Katz backoff over word n-grams of any order, three by default.

Counts of each order are Good-Turing discounted; what a context's seen words give up is its backoff weight, normalised exactly over the
words it has not seen, where each word's probability is asked of the next lower order, and at the lowest of the unseen class.  A text is
its words and one end; before its first word stand starts.

The corpus is read once into blocks: distinct words, and the text as places among them.  A block asks for the counts and numbers of its
distinct words, then, order by order, for the counts of its distinct n-grams; asks travel as packed arrays to the partition of their word
or context, are counted there with those of all other blocks, and come back as packed arrays (written tables, partitioned by word and by
context).  So an n-gram that stands in a block a thousand times is asked for once, no table is ever whole anywhere, and scoring needs no
row for each token.  A word's number is small where the word is common, so n-grams travel in few bytes.

A word seen after a context was seen after the shorter one too, where its probability is discount * count / total.  So the lower-order mass
that a context has seen is told by whole numbers: how many of its words the shorter context counts once, twice, ... K times, and the sum of
the larger counts.  They travel back for the contexts that back off in a block alone.

Defined cases: null text is empty and has one token, its end; repeated rows are learned from and scored each; an empty table gives no
rows; without training rows every token has probability one half; other columns are ignored; order one has no contexts.  Words are told
apart by 64-bit hashes, n-grams by the numbers of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .bytes import chunks, mix64, seeded, words
from .common import Scratch, free_shuffles, give_back, parts_for, remainder

SEED, END = (int(x) for x in seeded(2, 9))
#: Words of the longest n-gram.
ORDER = 3
#: Counts up to this are discounted.
K = 5
#: Tokens of a block; a block and its n-grams are held in memory (some 200 bytes a token at most).
BLOCK = 2_000_000
DOC = np.dtype([("doc", "<i8"), ("null", "u1"), ("held", "u1"), ("n", "<i4")])


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string; the bytes of one place of all items stand together, which halves counts and places."""
    import struct

    codec, out = pa.Codec("zstd", 1), []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        small = codec.compress(raw, asbytes=True) if raw else b""
        out.append(struct.pack("<qq", len(raw), len(small)) + small)
    return b"".join(out)


def unpacked(data: bytes, *types: str) -> list[np.ndarray]:
    import struct

    codec, out, at = pa.Codec("zstd"), [], 0
    for t in types:
        size, small = struct.unpack_from("<qq", data, at)
        at += 16
        raw = np.frombuffer(codec.decompress(data[at : at + small], size, asbytes=True) if size else b"", dtype=np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(np.dtype(t).itemsize, -1).T).reshape(-1).view(t))
        at += small
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discount for counts 0 .. K + 1, from the numbers n[r] of things counted r times; the last is for all larger counts."""
    out = np.ones(K + 2)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        if n[r] and common < 1:
            d = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common)
            if 0 < d <= 1:
                out[r] = d
    return out


class Lowest:
    """The unigram order: discounted counts, and the mass of the unseen class."""

    def __init__(self, n: np.ndarray, total: int, kinds: int):
        self.total, self.kinds, self.d = total, kinds, discounts(n)
        low = np.arange(1, K + 1) * n[1 : K + 1]
        given = (self.d[1 : K + 1] * low).sum() + (total - low.sum())
        self.scale = 1.0 if total and given < total else (total / (total + 1.0) if total else 0.0)
        self.unseen = (1 - given / total * self.scale) if total else 0.5

    def p(self, c: np.ndarray) -> np.ndarray:
        seen = self.d[np.minimum(c, K + 1)] * c / max(self.total, 1) * self.scale
        return np.where(c > 0, seen, self.unseen)


class Level:
    """The distinct n-grams of a block, by context and word: the context's place among the (n-1)-grams + 1, or 0 for starts alone; the
    word's place; the place of the (n-1)-gram without the first word; the training count; and each token's n-gram."""

    def __init__(self, context, word, suffix, count, which):
        self.context, self.word, self.suffix, self.count, self.which = context, word, suffix, count, which


class Block:
    """One block: its distinct words' partitions (the commonest word first), tokens as places among them, and its documents."""

    def __init__(self, part: np.ndarray, stream: np.ndarray, docs: np.ndarray):
        self.part, self.stream, self.docs = part, stream.astype(np.int64), docs
        starts = np.concatenate(([0], np.cumsum(docs["n"], dtype=np.int64)))
        self.starts = starts[:-1]
        self.train = np.repeat(docs["held"] == 0, docs["n"])

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.stream[self.train], minlength=len(self.part))

    def levels(self, order: int) -> Iterator[tuple[int, Level]]:
        """The n-grams of the orders from two on."""
        v, which = max(len(self.part), 1), self.stream
        for n in range(2, order + 1):
            code = np.empty(len(self.stream), dtype=np.int64)
            code[1:] = which[:-1] + 1
            code[self.starts] = 0
            code *= v
            code += self.stream
            code, first, here = np.unique(code, return_index=True, return_inverse=True)
            suffix, which = which[first], here
            yield n, Level(code // v, code % v, suffix, np.bincount(which[self.train], minlength=len(code)), which)


def wider(level: Level, tokens: list[np.ndarray], ids: np.ndarray) -> list[np.ndarray]:
    """Word numbers of a level's n-grams, from those of its contexts."""
    return [x[level.context] for x in tokens] + [ids[level.word]]


def contexts(tokens: list[np.ndarray]) -> list[np.ndarray]:
    """Word numbers of all contexts: that of starts alone (0), then the n-grams one shorter."""
    return [np.concatenate((np.zeros(1, np.uint64), x)) for x in tokens]


def routes(level: Level, tokens: list[np.ndarray], parts: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(partition, its n-grams in order, where each context's run begins among them)."""
    h = np.full(len(tokens[0]), SEED, dtype=np.uint64)
    for x in tokens:
        h = mix64(h ^ x)
    p = (h % np.uint64(parts)).astype(np.int32)[level.context]
    order = np.argsort(p, kind="stable")
    out = []
    for at in np.split(order, np.flatnonzero(np.diff(p[order])) + 1):
        if len(at):
            c = level.context[at]
            out.append((int(p[at[0]]), at, np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))))
    return out


def runs(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def folded(columns: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Equal rows of some columns get equal numbers, from 0 on; and how many there are."""
    code, n = np.zeros(len(columns[0]), dtype=np.int64), 1
    for x in columns:
        seen, code = np.unique(code * (int(x.max(initial=0)) + 1) + x.astype(np.int64), return_inverse=True)
        n = len(seen)
    return code, n


def backing(count: np.ndarray, home: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The contexts that were seen, but not before some word asked for."""
    return np.flatnonzero((np.bincount(home[count == 0], minlength=len(total)) > 0) & (total > 0))


def ask_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(h) % np.uint64(parts)).astype(np.int64)


def score(documents: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; held_out rows are not learned from."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "katz")
    parts = parts_for(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, held, count = (TaskContext.get().partitionId() << 24), 0, [], 0

        def block():
            hashes, docs = np.concatenate([h for h, _ in held]), np.concatenate([d for _, d in held])
            vocabulary, stream, often = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # the commonest words get the smallest places, which pack best
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            vocabulary, stream = vocabulary[order], place[stream]
            b = Block(ask_of(vocabulary, parts), stream, docs)
            return pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([packed(vocabulary, b.word_counts().astype(np.uint32))], pa.binary()), pa.array([packed(b.part.astype(np.uint32), stream.astype(np.uint32), docs)], pa.binary())], ["block", "words", "body"])

        for batch in batches:
            for part, data, offsets in chunks(batch):
                hashes, first = words(data, offsets)
                n = np.diff(first)
                tokens = np.insert(hashes, first[1:], np.uint64(END))
                docs = np.empty(len(n), dtype=DOC)
                ids = batch.column(0).slice(part.start, len(n))
                docs["doc"], docs["null"] = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                docs["held"], docs["n"] = batch.column(2).slice(part.start, len(n)).to_numpy(zero_copy_only=False), n + 1
                held.append((tokens, docs))
                count += len(tokens)
                if count >= BLOCK:
                    yield block()
                    held, count, k = [], 0, k + 1
        if held:
            yield block()

    blocks = scratch.save(rows.mapInArrow(read, "block long, words binary, body binary"), "blocks")

    def ask_words(batches):
        for b in batches:
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                vocabulary, counts = unpacked(v, "<u8", "<u4")
                p = ask_of(vocabulary, parts)
                for k in np.unique(p).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([key], pa.int64()), pa.array([packed(vocabulary[p == k], counts[p == k])], pa.binary())], ["p", "block", "v"])

    answer_schema = "kind int, p int, block long, v binary"
    answer_type = pa.schema([("kind", pa.int32()), ("p", pa.int32()), ("block", pa.int64()), ("v", pa.binary())])

    def answers(t: pa.Table, tally: np.ndarray, replies: list[bytes]) -> pa.Table:
        """kind 0: a reply to each block; kind 1: the numbers of things counted 1 .. K + 1 times, all, and their sum."""
        p = t.column("p")[0].as_py()
        seen = tally[tally > 0]
        stats = np.concatenate(([0], [(seen == r).sum() for r in range(1, K + 2)], [len(seen), seen.sum()])).astype(np.int64)
        return pa.table({"kind": [0] * len(replies) + [1], "p": [p] * (len(replies) + 1), "block": [*t.column("block").to_pylist(), 0], "v": [*replies, stats.tobytes()]}, schema=answer_type)

    def count_words(t: pa.Table) -> pa.Table:
        """Training counts of the asked words over all blocks, and their numbers: 0 is the start's, the commonest get the smallest."""
        asked = [unpacked(v, "<u8", "<u4") for v in t.column("v").to_pylist()]
        distinct, at = np.unique(np.concatenate([h for h, _ in asked]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([c for _, c in asked])).astype(np.int64)
        cut = np.cumsum([len(h) for h, _ in asked])[:-1]
        number = np.empty(len(distinct), dtype=np.uint64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(distinct)) * parts + t.column("p")[0].as_py() + 1
        return answers(t, total, [packed(c.astype(np.uint64), i) for c, i in zip(np.split(total[at], cut), np.split(number[at], cut))])

    word_table = scratch.save(blocks.select("block", "words").mapInArrow(ask_words, "p int, block long, v binary").repartition(parts, "p").groupBy("p").applyInArrow(count_words, answer_schema), "words")

    def statistic(answered: DataFrame) -> np.ndarray:
        """Sums of the partitions' fixed-size statistics."""

        def numbers(batches):
            for b in batches:
                for v in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(K + 4, dtype=np.int32)), pa.array(np.frombuffer(v, dtype="<i8"))], ["i", "x"])

        out = np.zeros(K + 4, dtype=np.int64)
        for r in answered.where("kind = 1").select("v").mapInArrow(numbers, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r["i"]] = r["x"]
        return out

    s = statistic(word_table)
    lowest = Lowest(s[: K + 2], int(s[K + 3]), int(s[K + 2]))

    def opened(t: pa.Table) -> tuple[int, Block]:
        return t.column("block")[0].as_py(), Block(*unpacked(t.column("body")[0].as_py(), "<u4", "<u4", DOC))

    def word_replies(b: Block, t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        c, ids = np.zeros(len(b.part), dtype=np.int64), np.zeros(len(b.part), dtype=np.uint64)
        for k, v in zip(t.column("p").to_pylist(), t.column("v").to_pylist()):
            total, number = unpacked(v, "<u8", "<u8")
            at = b.part == k
            c[at], ids[at] = total, number
        return c, ids

    def of_level(replies: pa.Table, n: int) -> pa.Table:
        return replies.filter(pc.equal(replies.column("kind"), n))

    def ask_grams(n: int):
        def ask(key, t: pa.Table, replies: pa.Table) -> pa.Table:
            """The block's distinct n-grams by context: the context's words, then each word, its count after the shorter context, and its count here."""
            give_back()
            block, b = opened(t)
            counts, ids = word_replies(b, of_level(replies, 1))
            tokens, out = [ids], []
            for m, level in b.levels(n):
                known = contexts(tokens)
                if m < n:
                    if m == n - 1:
                        got, counts = of_level(replies, m), np.zeros(len(level.word), dtype=np.int64)
                        by_part = dict(zip(got.column("p").to_pylist(), got.column("v").to_pylist()))
                        for k, at, _ in routes(level, known, parts):
                            counts[at] = unpacked(by_part[k], "<u8")[0]
                    tokens = wider(level, known, ids)
                    continue
                for k, at, first in routes(level, known, parts):
                    own = level.context[at[first]]
                    shorter = counts[level.suffix[at]].astype(np.uint64)
                    out.append((k, packed(*(x[own] for x in known), runs(first, len(at)).astype(np.uint32), ids[level.word[at]], shorter, level.count[at].astype(np.uint32))))
            return pa.table({"p": [k for k, _ in out], "block": [block] * len(out), "v": [v for _, v in out]}, schema=pa.schema([("p", pa.int32()), ("block", pa.int64()), ("v", pa.binary())]))

        return ask

    def count_grams(n: int):
        def count_part(t: pa.Table) -> pa.Table:
            """Counts of the asked n-grams over all blocks; for each context its total and which of the counts 1 .. K it has; and for those that
            back off, how often it has them, and the lower-order mass it has seen."""
            give_back()
            asked = [unpacked(v, *["<u8"] * (n - 1), "<u4", "<u8", "<u8", "<u4") for v in t.column("v").to_pylist()]
            at, m = folded([np.concatenate([a[j] for a in asked]) for j in range(n - 1)])
            own = np.split(at, np.cumsum([len(a[0]) for a in asked])[:-1])
            local = [np.repeat(np.arange(len(a[0])), a[n - 1]) for a in asked]
            w, shorter, times = (np.concatenate([a[i] for a in asked]) for i in (n, n + 1, n + 2))
            sizes = np.cumsum([len(a[n]) for a in asked])[:-1]
            del asked
            width = int(w.max(initial=0)) + 1
            code, first, gram = np.unique(np.concatenate([x[i] for x, i in zip(own, local)]) * width + w.astype(np.int64), return_index=True, return_inverse=True)
            count = np.bincount(gram, weights=times, minlength=len(code)).astype(np.int64)
            home, shorter, seen = code // width, shorter[first].astype(np.int64), count > 0
            total = np.bincount(home, weights=count, minlength=m).astype(np.int64)
            having = [np.bincount(home[count == r], minlength=m) for r in range(1, K + 1)]
            mask = sum((x > 0).astype(np.uint8) << r for r, x in enumerate(having)).astype(np.uint8)
            if n == 2:
                mass = [np.bincount(home[seen], weights=lowest.p(shorter[seen]), minlength=m)]
            else:
                mass = [np.bincount(home[seen & (shorter == r)], minlength=m).astype(np.uint64) for r in range(1, K + 1)]
                more = seen & (shorter > K)
                mass.append(np.bincount(home[more], weights=shorter[more], minlength=m).astype(np.uint64))
            replies = []
            for x, i, c in zip(own, local, np.split(count[gram], sizes)):
                back = x[backing(c, i, total[x])]
                replies.append(packed(c.astype(np.uint64), total[x].astype(np.uint64), mask[x], *(r[back].astype(np.uint64) for r in having), *(y[back] for y in mass)))
            return answers(t, count, replies)

        return count_part

    replies, d = word_table.where("kind = 0").withColumn("kind", F.lit(1)), {1: lowest.d}
    # as many tasks as the input asks for: none reads more blocks or parts as the input grows
    dealt = lambda df, key: df.repartition(parts, key).groupBy(key)
    bodies = dealt(blocks.select("block", "body"), "block")
    free_shuffles(spark)
    for n in range(2, order + 1):
        asked = bodies.cogroup(dealt(replies.where(F.col("kind").isin(1, n - 1)), "block")).applyInArrow(ask_grams(n), "p int, block long, v binary")
        table = scratch.save(dealt(asked, "p").applyInArrow(count_grams(n), answer_schema), f"grams-{n}")
        d[n] = discounts(statistic(table)[: K + 2])
        replies = replies.unionByName(table.where("kind = 0").withColumn("kind", F.lit(n)))
        del asked
        free_shuffles(spark)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def score_block(key, t: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()
        _, b = opened(t)
        c, ids = word_replies(b, of_level(replies, 1))
        tokens, p, which, wide = [ids], lowest.p(c), b.stream, None
        for n, level in b.levels(order):
            known, lower = contexts(tokens), p[level.suffix]
            shorter_wide = wide[level.suffix] if n > 2 else None
            p, wide = np.empty(len(level.word)), np.empty(len(level.word))
            got = of_level(replies, n)
            by_part = dict(zip(got.column("p").to_pylist(), got.column("v").to_pylist()))
            for k, at, first in routes(level, known, parts):
                mass_types = ["<f8"] if n == 2 else ["<u8"] * (K + 1)
                count, total, mask, *rest = unpacked(by_part[k], "<u8", "<u8", "u1", *["<u8"] * K, *mass_types)
                count, total, run = count.astype(np.int64), total.astype(np.float64), runs(first, len(at))
                home = np.repeat(np.arange(len(first)), run)
                # a context whose seen words give up nothing gets one count more
                gives = np.zeros(len(first), dtype=bool)
                for r in range(K):
                    gives |= (mask >> r & 1).astype(bool) & bool(d[n][r + 1] < 1)
                whole = np.where(gives, total, total + 1)
                back, weight = backing(count, home, total), np.ones(len(first))
                having, mass = [x.astype(np.float64) for x in rest[:K]], [x.astype(np.float64) for x in rest[K:]]
                given_up = whole[back] - total[back] + sum((1 - d[n][r + 1]) * (r + 1) * x for r, x in enumerate(having))
                if n == 2:
                    covered = mass[0]
                else:
                    covered = (sum(d[n - 1][r + 1] * (r + 1) * x for r, x in enumerate(mass[:K])) + mass[K]) / shorter_wide[at[first[back]]]
                weight[back] = given_up / whole[back] / np.maximum(1 - covered, 1e-300)
                seen = d[n][np.minimum(count, K + 1)] * count / whole[home]
                p[at], wide[at] = np.where(count > 0, seen, weight[home] * lower[at]), whole[home]
            tokens, which = wider(level, known, ids), level.which
        occurrences = c[b.stream]
        base = np.log10((occurrences + 1) / (lowest.total + (lowest.kinds + 1)))
        add = lambda x: np.add.reduceat(x, b.starts) if len(b.starts) else np.zeros(0)
        doc_ids = pa.array(b.docs["doc"], pa.int64(), mask=b.docs["null"].astype(bool))
        return pa.table([doc_ids, pa.array(b.docs["held"].astype(bool)), pa.array(b.docs["n"].astype(np.int64)), pa.array(add((occurrences > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(p)[which]))], schema=pa.schema(list(zip(names, types))))

    out = bodies.cogroup(dealt(replies, "block")).applyInArrow(score_block, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(lowest.total).cast("long"))


def score_documents(documents: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod 7 is not 2 and scores all of them."""
    return score(documents, remainder("doc_id", 7) == 2)
