"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 16 bytes cuts texts into chunks of about 16 bytes wherever certain bits are zero, so cuts
follow the content and an insertion moves none but its own.  Chunks are deduplicated by 64-bit digests: the first occurrence, in order
of doc_id and position, stays, and later ones are repeats.  A stretch of consecutive repeats of at least ``SHORTEST`` bytes is taken
out of its text; shorter ones are how people write, and stay.

Each block of texts settles its own repeats first, so that a digest sends at most one entry a block into the shuffle; entries travel
in packed arrays.  Nothing but repeats comes back to the texts.

Defined cases: null text stays null and empty text empty; rows of one id and text share their outcome; rows of one id and different
texts are told apart by a hash of the text; texts may lose all they have and then are empty; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bytes import chunks, seeded, span_hashes
from .common import Scratch, give_back, lean, parts_for

WINDOW, LONGEST = 16, 1024
#: The shortest stretch of repeated chunks that is taken out, in bytes: some 16 words, what is left of 50 repeated words
#: when the partial chunks at both ends are not counted.
SHORTEST = 100
GEAR = seeded(256, 3).astype(np.uint32)
#: Bits of the hash that have to be zero at a cut: the upper four of those that hang on the window.
MASK = np.uint32(0b1111 << (WINDOW - 4))


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all texts, and the first chunk of each text."""
    size = np.diff(offsets)
    n = len(data)
    position = np.arange(n) - np.repeat(offsets[:-1], size)  # within the text
    h = GEAR[data]
    step = 1
    while step < WINDOW:  # h[i] becomes the sum over the last 2 * step bytes of gear << distance, within the text
        back = np.zeros_like(h)
        back[step:] = h[:-step] if n > step else h[:0]
        back[position < step] = 0
        h = h + (back << np.uint32(step))
        step *= 2
    cut = (h & MASK) == 0
    cut[:-1] &= (data[1:] & 0xC0) != 0x80  # never inside a character
    cut[offsets[1:][size > 0] - 1] = True
    ends = np.flatnonzero(cut) + 1
    gap = np.diff(np.concatenate(([0], ends)))
    if len(gap) and gap.max() > LONGEST:
        extra = [np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends[gap > LONGEST].tolist(), gap[gap > LONGEST].tolist())]
        more = np.concatenate(extra)
        for _ in range(3):
            inside = (data[np.minimum(more, n - 1)] & 0xC0) == 0x80
            more = more + inside
        ends = np.unique(np.concatenate((ends, more)))
    return ends, np.searchsorted(ends, offsets, side="right")


def chunk_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, end) of each chunk and the first chunk of each text."""
    ends, first = cuts(data, offsets)
    starts = np.concatenate(([0], ends[:-1]))[: len(ends)]
    return span_hashes(data, starts, ends), ends, first


def repeated_spans(ends: np.ndarray, repeats: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Byte spans of the stretches of repeated chunks in one text; ends: of its chunks, from the text's start."""
    flag = np.zeros(len(ends) + 2, dtype=np.int8)
    flag[1 + repeats[(repeats >= 0) & (repeats < len(ends))]] = 1
    edge = np.diff(flag)
    at = np.concatenate(([0], ends))
    return [(int(at[a]), int(at[b])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)) if at[b] - at[a] >= shortest]


RECORD = np.dtype([("digest", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("key", "<i8")])
#: Entries of a block; a block's repeats are settled in memory (28 bytes each, and the sort).
BLOCK = 600_000
#: Stands for a null id: after all others, so that copies with an id come first.
NO_ID = (1 << 63) - 1


def ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order, which of them lead their digest, and which are repeats: all others but the lead's own place in a row that stands several times."""
    rows = rows[np.lexsort((rows["key"], rows["pos"], rows["doc"], rows["digest"]))]
    first = np.concatenate(([True], rows["digest"][1:] != rows["digest"][:-1]))
    at = np.flatnonzero(first)
    lead = np.repeat(at, np.diff(np.append(at, len(rows))))
    return rows, first, (rows["doc"] != rows["doc"][lead]) | (rows["pos"] != rows["pos"][lead]) | (rows["key"] != rows["key"][lead])


def repeats(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_key, repeats (chunk numbers) of each text that holds any."""
    parts = parts_for(documents)
    names = ["kind", "p", "v"]

    def settle(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, first, again = ranked(np.concatenate(held))
        again, rows = rows[again], rows[first]
        p = (rows["digest"] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(p, kind="stable")
        rows, at = rows[order], np.searchsorted(p[order], np.arange(parts + 1))
        full = np.flatnonzero(np.diff(at)).tolist()
        packed = [rows[at[k] : at[k + 1]].tobytes() for k in full]
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array(packed, pa.binary())], names)
        if len(again):
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([0], pa.int32()), pa.array([again[["doc", "key", "pos"]].copy().astype(PLACE).tobytes()], pa.binary())], names)

    def cut_up(batches):
        held, count = [], 0
        for batch in batches:
            for part, data, offsets in chunks(batch):
                digest, _, first = chunk_digests(data, offsets)
                per = np.diff(first)
                rows = np.empty(len(digest), dtype=RECORD)
                rows["digest"], rows["pos"] = digest, np.arange(len(digest)) - np.repeat(first[:-1], per)
                for name, column in (("doc", 0), ("key", 1)):
                    rows[name] = np.repeat(batch.column(column).slice(part.start, part.stop - part.start).fill_null(0).to_numpy(), per)
                held.append(rows)
                count += len(rows)
                if count > BLOCK:
                    yield from settle(held)
                    held, count = [], 0
        if count:
            yield from settle(held)

    def meet(t: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(t.column("v").to_pylist()), dtype=RECORD)
        rows, _, again = ranked(rows)
        rows = rows[again]
        if len(again) > BLOCK:
            give_back()
        return pa.table({"doc_id": rows["doc"], "text_key": rows["key"], "pos": rows["pos"]}, schema=pa.schema(PLACES))

    def unpack(batches):
        for b in batches:
            for v in b.column(0).to_pylist():
                rows = np.frombuffer(v, dtype=PLACE)
                for k in range(0, len(rows), 100_000):
                    r = rows[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(r["doc"]), pa.array(r["key"]), pa.array(r["pos"])], ["doc_id", "text_key", "pos"])

    rows = documents.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    cut = scratch.save(rows.mapInArrow(lean(cut_up), "kind int, p int, v binary"), "cut")
    schema = "doc_id long, text_key long, pos int"
    places = cut.where("kind = 0").groupBy("p").applyInArrow(meet, schema).unionByName(cut.where("kind = 1").select("v").mapInArrow(unpack, schema))
    return scratch.save(places.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("repeats")), "repeats")


PLACE = np.dtype([("doc", "<i8"), ("key", "<i8"), ("pos", "<i4")])
PLACES = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32())]


def deduplicate(documents: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """All columns of documents, text without its repeated stretches, and removed_chars, n_spans (in place of columns of these names)."""
    scratch = Scratch(documents.sparkSession, "substrings")
    found = repeats(documents, scratch)
    scratch.drop("cut")
    documents = documents.drop("removed_chars", "n_spans")
    fields, at = documents.schema.fields, documents.columns.index("text")
    own = (F.coalesce(F.col("d.doc_id").cast("long"), F.lit(NO_ID)) == F.col("r.doc_id")) & (F.xxhash64("d.text") == F.col("r.text_key"))
    extra = "repeats" + "_" * max(map(len, documents.columns))  # longer than any name that is there
    joined = documents.alias("d").join(found.alias("r"), own, "left").select("d.*", F.col("r.repeats").alias(extra))

    def taken_out(batches):
        for b in batches:
            hits, texts = b.column(b.num_columns - 1), b.column(at).to_pylist()
            removed, spans = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for k in np.flatnonzero(hits.is_valid().to_numpy(zero_copy_only=False)).tolist():
                raw = texts[k].encode("utf-8")
                data = np.frombuffer(raw, dtype=np.uint8)
                ends, _ = cuts(data, np.array([0, len(data)]))
                parts, last = [], 0
                for x, y in repeated_spans(ends, np.array(hits[k].as_py(), dtype=np.int64), shortest):
                    parts.append(raw[last:x])
                    last, spans[k] = y, spans[k] + 1
                if last:
                    before, texts[k] = len(texts[k]), (b"".join(parts) + raw[last:]).decode("utf-8")
                    removed[k] = before - len(texts[k])
            columns = [*b.columns[:-1], pa.array(removed), pa.array(spans)]
            columns[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "removed_chars", "n_spans"])

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + [T.StructField("removed_chars", T.LongType()), T.StructField("n_spans", T.LongType())])
    return joined.mapInArrow(lean(taken_out), schema)
