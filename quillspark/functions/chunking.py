"""Token-bounded chunking: folds over a text's segments, in pandas, document by document."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: Where to cut, best first: paragraph, line, sentence, blank.
SEPARATORS = ("\n\n", "\n", r"(?<=[.!?;,])\s", " ")


def count_tokens(text: str) -> int:
    """Words and marks: the offline stand-in for a model's tokenizer."""
    return len(re.findall(r"\w+|[^\w\s]", text))


def pieces(text: str, limit: int, count: Callable[[str], int] = count_tokens, level: int = 0) -> Iterator[str]:
    """Parts of at most limit tokens, cut at the best separators there are."""
    if count(text) <= limit:
        yield text
        return
    if level == len(SEPARATORS):
        step = max(1, len(text) * limit // max(1, count(text)))
        yield from (text[i : i + step] for i in range(0, len(text), step))
        return
    sep = SEPARATORS[level]
    parts = re.split(f"({sep})", text) if level == 2 else [x for p in text.split(sep) for x in (p, sep)][:-1]
    held, size = "", 0
    for part in parts:
        n = count(part)
        if held and size + n > limit:
            yield held
            held, size = "", 0
        if n > limit:
            yield from pieces(part, limit, count, level + 1)
        else:
            held, size = held + part, size + n
    if held:
        yield held


def merged(parts: list[str], target: int, least: int, cap: int, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Parts below `least` tokens join the neighbour with which they come nearest to the target, within the cap."""
    sizes, parts = [count(p) for p in parts], list(parts)
    i = 0
    while i < len(parts):
        if sizes[i] < least and len(parts) > 1:
            sides = [j for j in (i - 1, i) if 0 <= j < len(parts) - 1 and sizes[j] + sizes[j + 1] <= cap]
            if sides:
                j = min(sides, key=lambda j: abs(sizes[j] + sizes[j + 1] - target))
                parts[j : j + 2], sizes[j : j + 2] = [parts[j] + parts[j + 1]], [sizes[j] + sizes[j + 1]]
                i = max(0, j - 1)
                continue
        i += 1
    return parts


def chunked(docs: DataFrame, key: str, text: str, target: int = 600, least: int = 400, cap: int = 750) -> DataFrame:
    """key, chunk_index from 1, chunk_id (a hash of both), tokens, text."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, t in zip(pdf[key], pdf[text]):
                for i, part in enumerate(merged(list(pieces(t or "", target)), target, least, cap), 1):
                    out.append((k, i, count_tokens(part), part))
            yield pd.DataFrame(out, columns=[key, "chunk_index", "tokens", text])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInPandas(rows, f"{key} {kind}, chunk_index int, tokens int, {text} string").withColumn("chunk_id", F.sha2(F.concat_ws("/", F.col(key).cast("string"), F.col("chunk_index").cast("string")), 256))


@F.pandas_udf(T.StringType())
def uuid5(names: pd.Series) -> pd.Series:
    """UUID version 5 in the URL namespace."""
    return names.map(lambda n: None if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, n)))
