"""Language identification by error-correcting output codes.

Languages get codewords of bits.  For each bit a binary naive Bayes classifier over hashed byte trigrams tells the
languages whose bit is 1 from the rest; all of them follow from one partition-summed table of trigram counts per
language, taken over every training document.  Decoding is loss-weighted: each bit's logistic loss counts by how far
apart its two classes lie, the codeword with the least loss wins, and a close second marks the result as ambiguous.

Defined cases: null text and text without any letter give ``und`` and score 0; rows with null language are not learned
from; repeated rows count as often as they occur; without training rows every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytes import LOWER, chunks
from .common import lean, remainder

DIM = 4096
#: Letters keep a code of their own (high bytes too, as parts of letters); all else is one separator, 0.
LETTER_CODE = np.zeros(256, dtype=np.int64)
LETTER_CODE[97:123] = np.arange(1, 27)
LETTER_CODE[128:256] = np.arange(27, 155)


#: Texts whose counts are held at once: a row is DIM floats.
ROWS = 256


def pieces(part: slice, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """A chunk in pieces of at most ROWS texts."""
    for k in range(0, len(offsets) - 1, ROWS):
        at = offsets[k : k + ROWS + 1]
        yield slice(part.start + k, part.start + k + len(at) - 1), data[at[0] : at[-1]], at - at[0]


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed trigram counts of each text of a chunk; trigrams around a separator count, those in the middle of two don't."""
    n = len(offsets) - 1
    code = LETTER_CODE[LOWER[data]]
    if len(code) < 3:
        return np.zeros((n, DIM), dtype=np.float32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    a, b, c = code[:-2], code[1:-1], code[2:]
    keep = (doc[:-2] == doc[2:]) & (b > 0)
    slot = (a * 24593 + b * 769 + c * 31) % 4093
    return np.bincount(doc[:-2][keep] * DIM + slot[keep], minlength=n * DIM).reshape(n, DIM).astype(np.float32)


def codewords(classes: int) -> np.ndarray:
    """A row of -1/+1 for each class: every split of the classes for up to 6 of them, else fixed pseudo-random splits."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:
        splits = np.arange(1, 1 << (classes - 1))
        bits = (splits[None, :] >> np.arange(classes)[:, None]) & 1
    else:
        rng = np.random.default_rng(11)
        columns: dict[bytes, np.ndarray] = {}  # no split twice, nor its complement
        while len(columns) < max(24, int(np.ceil(10 * np.log2(classes)))):
            bit = rng.permutation(np.arange(classes) % 2)
            bit = bit if bit[0] else 1 - bit
            columns[bit.tobytes()] = bit
        bits = np.stack(list(columns.values()), axis=1)
    return bits * 2.0 - 1


class Model:
    def __init__(self, names: list[str], counts: np.ndarray):
        self.names, self.code = names, codewords(len(names))
        weights, far = [], []
        for bit in self.code.T:
            one, zero = counts[bit > 0].sum(0) + 0.5, counts[bit < 0].sum(0) + 0.5
            p, q = one / one.sum(), zero / zero.sum()
            w = np.log(p / q)
            weights.append(w)
            far.append(((p - q) * w).sum())
        self.weights, far = np.array(weights, dtype=np.float32).T, np.array(far)
        self.importance = far / far.sum() if far.sum() else np.ones(len(far)) / len(far)
        self.sharp = 8.0 / np.maximum(far, 1e-6)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, score and the lead over the second class, of rows of trigram counts."""
        margin = (x @ self.weights) / np.maximum(x.sum(1, keepdims=True), 1) * self.sharp
        loss = np.stack([(np.logaddexp(0, -margin * word) * self.importance).sum(1) for word in self.code], axis=1)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, axis=1)
        return loss.argmin(1), order[:, -1], order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Sums trigram counts by language within partitions, then across them; one fixed-size vector a language reaches the driver."""
    schema = "lang string, v binary"
    arrow = pa.schema([("lang", pa.string()), ("v", pa.binary())])

    def summed(batches: Iterator[pa.RecordBatch]):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1)
            for part, data, offsets in (piece for chunk in chunks(batch) for piece in pieces(*chunk)):
                x = trigram_counts(data, offsets)
                code = langs.slice(part.start, part.stop - part.start).dictionary_encode()
                which = code.indices.to_numpy(zero_copy_only=False)
                for k, name in enumerate(code.dictionary.to_pylist()):
                    sums[name] = sums.get(name, 0) + x[which == k].sum(0, dtype=np.float64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "v": [v.tobytes()]}, schema=arrow)

    def added(t: pa.Table) -> pa.Table:
        return pa.table({"lang": [t.column("lang")[0].as_py()], "v": [np.sum([np.frombuffer(v) for v in t.column("v").to_pylist()], axis=0).tobytes()]}, schema=arrow)

    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    got = sorted((r["lang"], r["v"]) for r in known.mapInArrow(lean(summed), schema).groupBy("lang").applyInArrow(added, schema).collect())
    return Model([k for k, _ in got], np.array([np.frombuffer(v) for _, v in got])) if got else None


def predict(documents: DataFrame, model: Model | None, ambiguous_below: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row."""
    m = model  # DIM x bits floats, whatever the corpus; travels with the function, by value

    def labelled(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column(1)
            for part, data, offsets in (piece for chunk in chunks(batch) for piece in pieces(*chunk)):
                n = part.stop - part.start
                letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.slice(part.start, n).to_pylist()], dtype=bool)
                if m is None:
                    names, score, lead = np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n)
                else:
                    best, score, lead = m.decode(trigram_counts(data, offsets))
                    names = np.where(letters, np.array(m.names, dtype=object)[best], "und")
                    score, lead = np.where(letters, score, 0.0), np.where(letters, lead, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), pa.array(names, pa.string()), pa.array(score.astype(float)), pa.array(lead < ambiguous_below)], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(labelled), "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(documents: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod 4 is not 2 and labels all of them."""
    model = fit(documents.where(remainder("doc_id", 4) != 2))
    out = predict(documents, model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
