"""Quality classifier: random Fourier features, partition-summed normal equations, ridge scores, isotonic calibration.

Every text is read once, whole, into document statistics.  Random Fourier features approximate a Gaussian
kernel over the standardised statistics.  Each partition sums its normal equations (per fold); the sums meet in
grouped blocks, so only fixed-size matrices reach the driver.  The ridge penalty is the one with the least
out-of-fold error, which follows from the sums alone.  Out-of-fold scores, counted in fixed bins, give the
isotonic map to probabilities.

Defined cases: null text counts as empty and is scored; repeated rows are scored each; a document with several
labels counts with their mean; null labels are ignored; without any training label every score is 0.5; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytes import IS_SPACE, LOWER, chunks, span_hashes, spans
from .common import Scratch, lean, remainder, text_rows

N_STATS = 24
#: Classes of bytes: lower, upper, digit, blank, line feed, sentence marks, other marks, lead bytes, later bytes, controls.
BYTE_CLASS = np.full(256, 9, dtype=np.int64)
BYTE_CLASS[33:127] = 6
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58] = 0, 1, 2
BYTE_CLASS[[32, 9]], BYTE_CLASS[10] = 3, 4
BYTE_CLASS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 5
BYTE_CLASS[192:256], BYTE_CLASS[128:192] = 7, 8
NOT_LINE_FEED = np.ones(256, dtype=bool)
NOT_LINE_FEED[10] = False


def _distinct(hashes: np.ndarray) -> tuple[int, int]:
    """Distinct values, and the count of the commonest."""
    if not len(hashes):
        return 0, 0
    s = np.sort(hashes)
    edges = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
    return len(edges) - 1, int(np.diff(edges).max())


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """N_STATS statistics of each text of a chunk."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    classes = BYTE_CLASS[data]
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 10 + classes, minlength=n * 10).reshape(n, 10).astype(float)
    starts, ends, first = spans(data, offsets, ~IS_SPACE)
    low = LOWER[data]
    hashes = span_hashes(low, starts, ends)
    pairs = hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(7) if len(hashes) > 1 else hashes[:0]
    lstarts, lends, lfirst = spans(data, offsets, NOT_LINE_FEED)
    lines = span_hashes(low, lstarts, lends)
    before = {k: np.concatenate(([0], np.cumsum(classes == k))) for k in (1, 2, 6)}
    has = {k: c[ends] - c[starts] for k, c in before.items()}
    length = ends - starts
    flags = np.stack([length, length.astype(float) ** 2, has[1] == length, has[2] > 0, has[6] > 0, classes[starts] == 1 if len(starts) else length > 0, has[6] == length], axis=1).astype(float)
    sums = np.concatenate((np.zeros((1, 7)), np.cumsum(flags, axis=0)))
    per = sums[first[1:]] - sums[first[:-1]]
    out = np.zeros((n, N_STATS))
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        w, size_i = b - a, float(size[i])
        share = counts[i] / max(size_i, 1.0)
        kinds, top = _distinct(hashes[a:b])
        kinds2, top2 = _distinct(pairs[a : max(a, b - 1)])
        la, lb = int(lfirst[i]), int(lfirst[i + 1])
        line_kinds, _ = _distinct(lines[la:lb])
        full = share[share > 0]
        m, w1 = per[i, 0] / max(w, 1), max(w, 1)
        out[i, :10] = share
        out[i, 10:] = (
            np.log1p(size_i), np.log1p(w), m, np.sqrt(max(0.0, per[i, 1] / w1 - m * m)), kinds / w1, top / w1,
            kinds2 / max(w - 1, 1), top2 / max(w - 1, 1), line_kinds / max(lb - la, 1),
            per[i, 2] / w1, per[i, 3] / w1, per[i, 4] / w1, per[i, 5] / w1, -(full * np.log(full)).sum() if size_i else 0.0,
        )
    return out


def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch):
            flat = statistics(data, offsets).ravel()
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, N_STATS, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, rows.stop - rows.start), x], ["doc_id", "x"])


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, x: one row per row of documents, from the whole text."""
    return text_rows(documents).mapInArrow(lean(_statistic_rows), "doc_id long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        return np.interp(design(x, self.mean, self.scale, self.omega, self.phase) @ self.weights, self.knots, self.values)


def design(x: np.ndarray, mean, scale, omega, phase) -> np.ndarray:
    """Columns: one, the standardised statistics, and the random Fourier features of the Gaussian kernel."""
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / len(phase)) * np.cos(z @ omega + phase)])


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def pool_adjacent(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Isotonic regression by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for w, v in zip(weight, value):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(int(n), v) for _, v, n in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out_fold: int = 0, features: int = 256, bins: int = 512, seed: int = 7) -> Model:
    """Learns from the labelled rows whose crc32(doc_id) remainder is not the held-out one.  All of them are used."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    known = known.where(remainder("doc_id", folds) != held_out_fold)
    rows = stats.join(known, "doc_id").select("x", "y", remainder("doc_id", folds).cast("int").alias("fold"))

    def moments(batches):
        n, s, q = 0, np.zeros(N_STATS), np.zeros(N_STATS)
        for b in batches:
            x = matrix(b)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_pydict({"n": [n], "i": [0], "v": [np.concatenate((s, q)).tolist()]}, schema=pa.schema([("n", pa.int64()), ("i", pa.int32()), ("v", pa.list_(pa.float64()))]))

    def added(t: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(v) for v in t.column("v").to_pylist()], axis=0)
        return pa.table({"n": [sum(t.column("n").to_pylist())], "i": [t.column("i")[0].as_py()], "v": [total.tolist()]}, schema=t.schema)

    got = rows.select("x").mapInArrow(moments, "n long, i int, v array<double>").groupBy("i").applyInArrow(added, "n long, i int, v array<double>").collect()
    n = got[0]["n"] if got else 0
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(size=(N_STATS, features)) / np.sqrt(N_STATS), rng.uniform(0, 2 * np.pi, features)
    empty = Model(np.zeros(N_STATS), np.ones(N_STATS), omega, phase, np.zeros(0), np.zeros(0), np.zeros(0))
    if not n:
        return empty
    v = np.asarray(got[0]["v"])
    mean = v[:N_STATS] / n
    scale = np.sqrt(np.maximum(v[N_STATS:] / n - mean**2, 1e-12))
    d = 1 + N_STATS + features
    width, schema = 64, "fold int, block int, v binary"

    def normal_equations(batches):
        """For each fold [design, y]' [design, y], cut into blocks of rows."""
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x, y, fold = matrix(b), b.column(1).to_numpy(), b.column(2).to_numpy()
            a = np.hstack([design(x, mean, scale, omega, phase), y[:, None]])
            for f in np.unique(fold).tolist():
                part = a[fold == f]
                sums[f] = sums.get(f, 0) + part.T @ part
        for f, g in sums.items():
            for k in range(0, d + 1, width):
                yield pa.RecordBatch.from_pydict({"fold": [f], "block": [k], "v": [g[k : k + width].tobytes()]}, schema=pa.schema([("fold", pa.int32()), ("block", pa.int32()), ("v", pa.binary())]))

    def add_blocks(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v) for v in t.column("v").to_pylist()], axis=0)
        return pa.table({"fold": [t.column("fold")[0].as_py()], "block": [t.column("block")[0].as_py()], "v": [total.tobytes()]}, schema=t.schema)

    grams: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(normal_equations, schema).groupBy("fold", "block").applyInArrow(add_blocks, schema).collect():
        part = np.frombuffer(r["v"]).reshape(-1, d + 1)
        grams.setdefault(r["fold"], np.zeros((d + 1, d + 1)))[r["block"] : r["block"] + len(part)] = part
    total = sum(grams.values())

    def solve(g: np.ndarray, penalty: float) -> np.ndarray:
        ridge = penalty * np.eye(d)
        ridge[0, 0] = 1e-9
        return np.linalg.solve(g[:d, :d] + ridge, g[:d, d])

    def error(penalty: float) -> float:
        out = 0.0
        for g in grams.values():
            w = solve(total - g, penalty)
            out += g[d, d] - 2 * w @ g[:d, d] + w @ g[:d, :d] @ w
        return out

    penalty = min((0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0), key=error)
    weights, by_fold = solve(total, penalty), {f: solve(total - g, penalty) for f, g in grams.items()}

    def binned(batches):
        tally = np.zeros((bins, 2))
        for b in batches:
            a, y, fold = design(matrix(b), mean, scale, omega, phase), b.column(1).to_numpy(), b.column(2).to_numpy()
            raw = np.zeros(len(y))
            for f, w in by_fold.items():
                raw[fold == f] = a[fold == f] @ w
            at = np.clip(((raw + 0.5) / 2 * bins).astype(int), 0, bins - 1)
            tally[:, 0] += np.bincount(at, minlength=bins)
            tally[:, 1] += np.bincount(at, weights=y, minlength=bins)
        at = np.flatnonzero(tally[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(tally[at, 0]), pa.array(tally[at, 1])], ["bin", "n", "s"])

    counted = rows.mapInArrow(binned, "bin int, n double, s double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("bin").collect()  # at most `bins` rows
    at, weight = np.array([r["bin"] for r in counted]), np.array([r["n"] for r in counted])
    value = pool_adjacent(weight, np.array([r["s"] for r in counted]) / weight)
    return Model(mean, scale, omega, phase, weights, (at + 0.5) / bins * 2 - 0.5, value)


def apply(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of each row of statistics."""

    def scored(batches):  # the model, some 60 kB whatever the corpus, travels with the function, by value
        for b in batches:
            s = np.clip(model.score(matrix(b)), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.select("doc_id", "x").mapInArrow(scored, "doc_id long, score double, predicted int")


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents."""
    scratch = Scratch(documents.sparkSession, "quality")
    stats = scratch.save(document_statistics(documents), "stats")
    return apply(stats, fit(stats, labels), threshold).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def filter_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns; texts are scored where they are, without a shuffle."""
    scratch = Scratch(documents.sparkSession, "quality")
    model = fit(scratch.save(document_statistics(documents), "stats"), labels)
    scratch.drop()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(statistics(data, offsets)) for _, data, offsets in chunks(batch)]
            if score:
                yield batch.filter(pa.array(np.concatenate(score) >= threshold))

    return documents.mapInArrow(lean(kept), documents.schema)
