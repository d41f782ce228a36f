"""BPE encoding and decoding with a public vocabulary, exactly as the tokenizers library gives them.

A text falls into stretches between ASCII white space, which no token crosses; a stretch is encoded once per worker
and kept.  Short ones go to the library in batches.  A stretch longer than ``LONG`` is split by the library's own
pre-tokenizer, and any single piece still longer is encoded by tree concatenation: its halves are encoded apart, in
parallel, then a window around each join grows until its tokens agree on both sides with those already there, so
the cost of one join is that of a few tokens.  The last leaf holds the end of the word, and so its end marker.

Defined cases: null text is empty and has no tokens; special token strings within texts become their special ids;
very long texts need memory for themselves alone; repeated rows and other columns change nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, text_rows, worker_cache

LONG = 256
LEAF = 128
#: Stretches kept by a worker; all are let go when it has so many.
KEPT = 700_000
#: Stretches whose characters lower-case and fall into pieces alike here and in the library: ASCII and composed Latin letters.
SIMPLE = re.compile("[\x21-\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u017f]+")
#: White space for Python but not for the library's patterns.
ODD_SPACE = re.compile("[\x1c-\x1f]")


class Encoder:
    """A tokenizers file, and the tree concatenation over it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models

        text = open(path, encoding="utf-8").read()
        self.whole = Tokenizer.from_str(text)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.final = self.whole.model
        self.inner = models.BPE(vocab=model["vocab"], merges=merges) if self.suffix else self.whole.model
        specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.special_ids = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.token = self.whole.id_to_token
        self.plain = spec.get("decoder") is None
        self.pieces = self._own_pieces(spec)
        self.byte_level = _byte_level()
        self.kept: dict[str, list[int]] = {}
        self.pool: ThreadPoolExecutor | None = None

    def leaf(self, piece: str, last: bool) -> list[tuple[str, int]]:
        """(surface, id) of the tokens of one short piece; surface is without the end marker."""
        got = (self.final if last else self.inner).tokenize(piece)
        return [(t.value[: -len(self.suffix)] if last and self.suffix and k == len(got) - 1 and t.value.endswith(self.suffix) else t.value, t.id) for k, t in enumerate(got)]

    def join(self, left: list, right: list, last: bool) -> list:
        """Tokens of the concatenation of two encoded pieces: the window around the join grows until both its ends agree."""
        reach = 4
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = self.leaf("".join(s for s, _ in left[a:]) + "".join(s for s, _ in right[:b]), last and b == len(right))
            whole = a == 0 and b == len(right)
            sides = 2  # tokens that have to agree at either end
            fits_left = a == 0 or window[:sides] == left[a : a + sides]
            fits_right = b == len(right) or window[-sides:] == right[b - sides : b]
            if whole or fits_left and fits_right and len(window) >= 2 * sides:
                return left[:a] + window + right[b:]
            reach *= 2

    def tree(self, piece: str) -> list[tuple[str, int]]:
        """Tree concatenation over one piece of byte-level characters."""
        parts = [piece[i : i + LEAF] for i in range(0, len(piece), LEAF)]
        self.pool = self.pool or ThreadPoolExecutor(2)
        level = list(self.pool.map(lambda k: self.leaf(parts[k], k == len(parts) - 1), range(len(parts))))
        while len(level) > 1:
            pairs = [(level[k], level[k + 1], k + 2 >= len(level)) for k in range(0, len(level) - 1, 2)]
            level = list(self.pool.map(lambda p: self.join(*p), pairs)) + ([level[-1]] if len(level) % 2 else [])
        return level[0]

    def long(self, stretch: str) -> list[int]:
        ids: list[int] = []
        for part in self.special.split(stretch) if self.special else [stretch]:
            if part in self.special_ids:
                ids.append(self.special_ids[part])
            elif part:
                text = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(text):
                    ids += [i for _, i in self.tree(piece)] if len(piece) > LONG else [t.id for t in self.final.tokenize(piece)]
        return ids

    @staticmethod
    def _own_pieces(spec: dict):
        """The file's piece pattern for SIMPLE stretches, if the file has the parts for which that is exact."""
        import regex

        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"] or parts[1].get("use_regex") or parts[1].get("add_prefix_space"):
            return None
        return regex.compile(parts[0]["pattern"]["Regex"]).findall if parts[0]["invert"] and parts[0]["behavior"] == "Removed" else None

    def simple(self, stretch: str) -> list[int]:
        """Ids of a SIMPLE stretch, piece by piece; pieces are kept, as many stretches share them."""
        ids: list[int] = []
        for piece in self.pieces(stretch.lower()):
            got = self.kept.get(piece)
            if got is None:
                got = [t.id for t in self.final.tokenize(piece if piece.isascii() else "".join([self.byte_level[b] for b in piece.encode()]))]
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[piece] = got
            ids += got
        return ids

    def encode(self, stretches: list[str]) -> list[list[int]]:
        out: list = [None] * len(stretches)
        rest = []
        for k, s in enumerate(stretches):
            if len(s) > LONG:
                out[k] = self.long(s)
            elif self.pieces and SIMPLE.fullmatch(s) and not (self.special and self.special.search(s)):
                out[k] = self.simple(s)
            else:
                rest.append(k)
        for k, e in zip(rest, self.whole.encode_batch_fast([stretches[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids, skip_special_tokens=False)


def _byte_level() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def encoder(path: str) -> Encoder:
    cache = worker_cache("bpe")
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def split(text: str) -> list[str]:
    """Stretches between white space; empty ones may stand at the ends."""
    return text.split() if not ODD_SPACE.search(text) else re.split(r"[ \t\n\r\f\v]+", text)


def encoded(texts: list[str], path: str) -> Iterator[tuple[str, str]]:
    """For each text its ids in decimal and its tokens, both joined by one space.

    The vocabulary file has no decoder, so the library's decoded text is the tokens joined by one space; a file that has
    one is decoded by the library instead.
    """
    enc = encoder(path)
    cache = worker_cache(f"bpe-stretches-{path}")
    names = worker_cache(f"bpe-names-{path}")
    if not names:
        names.update({k: str(k) for k in range(enc.whole.get_vocab_size())})
        names["token"] = [enc.token(k) for k in range(enc.whole.get_vocab_size())]
    token = names["token"]
    for text in texts:
        stretches = split(text)
        missing = list({s for s in stretches if s and s not in cache})
        if missing:
            if len(cache) + len(missing) > KEPT:
                cache.clear()
                missing = list({s for s in stretches if s})
            for s, ids in zip(missing, enc.encode(missing)):
                cache[s] = (" ".join([names[i] for i in ids]), " ".join([token[i] for i in ids]))
        got = [cache[s] for s in stretches if s]
        ids = " ".join([a for a, _ in got if a])
        yield ids, " ".join([b for _, b in got if b]) if enc.plain else enc.decode([int(i) for i in ids.split()])


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (decimal, joined by one space), n_tokens, decoded: of every whole text."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                got = list(encoded(part.column(1).to_pylist(), path))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([a for a, _ in got], pa.string()), pa.array([a.count(" ") + 1 if a else 0 for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return text_rows(documents).mapInArrow(rows, "doc_id long, ids string, n_tokens long, decoded string")


def digest_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests are taken where the tokens are, so that they needn't travel."""

    def rows(batches: Iterator[pa.RecordBatch]):
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                got = [(sha(a), sha(b), a.count(" ") + 1 if a else 0) for a, b in encoded(part.column(1).to_pylist(), path)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for *_, n in got], pa.int64()), pa.array([a for a, *_ in got], pa.string()), pa.array([b for _, b, _ in got], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_rows(documents).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array) of every whole text: what training reads.  Workers keep the ids of a stretch as bytes, and no names of tokens."""
    import numpy as np

    def rows(batches: Iterator[pa.RecordBatch]):
        enc, cache = encoder(path), worker_cache(f"bpe-ids-{path}")
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, got = batch.slice(k, 64), []
                for text in part.column(1).to_pylist():
                    stretches = split(text)
                    missing = list({s for s in stretches if s and s not in cache})
                    if missing:
                        if len(cache) + len(missing) > KEPT:
                            cache.clear()
                            missing = list({s for s in stretches if s})
                        for s, ids in zip(missing, enc.encode(missing)):
                            cache[s] = np.array(ids, dtype=np.int32).tobytes()
                    got.append(b"".join([cache[s] for s in stretches if s]))
                size = np.array([len(x) // 4 for x in got], dtype=np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(np.frombuffer(b"".join(got), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), ids], ["doc_id", "n_tokens", "ids"])

    return text_rows(documents).mapInArrow(lean(rows), "doc_id long, n_tokens long, ids array<int>")
