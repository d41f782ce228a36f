"""What needs a scan from character to character: lenient and partial JSON, fences, bounded chunks.  Arrow-batched."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F, types as T

from .text import REFERENCES

STRING = re.compile(r'"((?:[^"\\]|\\.)*)("?)', re.S)


def unescaped(raw: str) -> str:
    """The text of a JSON string's body, as far as its escapes are whole."""
    raw = re.sub(r"\\(?:u[0-9a-fA-F]{0,3})?\Z", "", raw) if len(re.search(r"\\*(?:u[0-9a-fA-F]{0,3})?\Z", raw)[0].split("u")[0]) % 2 else raw
    try:
        return json.loads(f'"{raw}"', strict=False)
    except ValueError:
        return raw


def partial_field(text: str, field: str) -> str | None:
    """The value, as far as it has come, of a string field of the outermost object; '' where no string has begun; null without the field."""
    text = text.lstrip()
    if not text.startswith("{"):
        return None
    depth = at = 0
    for_name = False
    while at < len(text):
        c = text[at]
        if c != '"':
            depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(c, 0)
            at += 1
            continue
        m = STRING.match(text, at)
        if not m[2]:
            return None
        at = m.end()
        colon = re.compile(r"\s*:\s*").match(text, at)
        for_name = depth == 1 and bool(colon)
        if for_name and unescaped(m[1]) == field:
            value = STRING.match(text, colon.end())
            return unescaped(value[1]) if value else ""
    return None


def balanced(text: str, start: int) -> int:
    """The place behind the brace that closes the one at start; -1: none."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return -1


def lenient(text: str | None):
    """The JSON value of a model's answer: the whole text, a fenced object, the first balanced one, the outermost braces; else null."""
    text = (text or "").strip()
    tries = [text, *re.findall(r"```json\s*(\{.*?\})\s*```", text, re.S)[:1], *re.findall(r"```\s*(\{.*?\})\s*```", text, re.S)[:1]]
    if (start := text.find("{")) >= 0:
        if (end := balanced(text, start)) > 0:
            tries.append(text[start:end])
        tries.append(text[start : text.rfind("}") + 1])
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


def cited(text: str) -> list[int]:
    """Reference numbers in a JSON answer of any of three forms, by pattern where it is no JSON."""
    body = re.sub(r"\n?```\s*\Z", "", re.sub(r"\A```(?:json)?\s*\n?", "", text.strip())) if text.strip().startswith("```") else text.strip()
    try:
        value = json.loads(body)
        if isinstance(value, list):
            found = [x["reference"]["number"] for x in value if isinstance(x, dict) and isinstance(x.get("reference"), dict) and "number" in x["reference"]]
        elif isinstance(value, dict) and isinstance(value.get("blocks"), list):
            lists = [b.get("citations") for b in value["blocks"] if isinstance(b, dict)]
            found = [c["id"] for cs in lists if isinstance(cs, list) for c in cs if isinstance(c, dict) and str(c.get("id", "")).lstrip("-").isdigit()]
        elif isinstance(value, dict):
            found = [c["reference"] for c in value.get("mentioned_contexts", []) if isinstance(c, dict) and "reference" in c]
        else:
            found = []
        return sorted({int(x) for x in found})
    except (ValueError, TypeError, KeyError):
        return sorted({int(n) for m in re.finditer(REFERENCES, text) for n in re.findall(r"\d+", m[0])})


def whole_bullets(text: str) -> list[str]:
    """The objects of a growing "bullets" array that are whole by now and have a point and a purpose, as JSON."""
    begin = re.search(r'"bullets"\s*:\s*\[', text)
    out, depth, start, at = [], 0, 0, begin.end() if begin else len(text)
    for m in re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', re.S).finditer(text, at):
        if m[0] == "{":
            start = m.start() if not depth else start
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                try:
                    value = json.loads(text[start : m.end()])
                except ValueError:
                    continue
                if "point" in value and "purpose" in value:
                    out.append(json.dumps(value, ensure_ascii=False))
    return out


def line_chunks(text: str, size: int = 2500) -> list[str]:
    """Whole lines up to a length; a longer line is a chunk of its own."""
    out: list[list[str]] = [[]]
    length = -1  # of the chunk's lines, one between two
    for line in text.splitlines():
        if length + 1 + len(line) <= size:
            out[-1].append(line)
            length += 1 + len(line)
        else:
            out.append([line])
            length = len(line)
    return ["\n".join(x) for x in out] if text.splitlines() else []


def short_merged(chunks: list[str], tokens, least: int = 50) -> list[str]:
    """A chunk of few tokens goes together with the one after it, pair by pair."""
    out, k = [], 0
    while k < len(chunks):
        step = 2 if k + 1 < len(chunks) and tokens(chunks[k]) < least else 1
        out.append("\n\n".join(chunks[k : k + step]))
        k += step
    return out


def fence_spans(text: str) -> list[list[int]]:
    """First and last line (from 0) of each fenced block; one that never ends runs to the last line."""
    at = [k for k, line in enumerate(text.split("\n")) if line.lstrip().startswith("```")]
    ends = at[1::2] + [text.count("\n")] * (len(at) % 2)
    return [[a, b] for a, b in zip(at[::2], ends)]


def fence_pieces(text: str, limit: int = 2400) -> list[str]:
    """Lines up to a length that cut no fenced block, nor before an indented line, unless the piece would pass 1.2 times the length."""
    lines, out, here, size, fenced = text.split("\n"), [], [], 0, False
    for k, line in enumerate(lines):
        whole = not fenced and not line.startswith((" ", "\t"))
        if here and (size + len(line) > limit and whole or size + len(line) > limit * 1.2):
            out.append("\n".join(here))
            here, size = [], 0
        here.append(line)
        size += len(line) + 1
        fenced ^= line.lstrip().startswith("```")
    return [*out, "\n".join(here)]


def arrays(function, kind) -> object:
    """A pandas UDF that gives function's list, or value, for each text."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else function(x)), kind)


def partial_of(field: str):
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else partial_field(x, field)), T.StringType())


lenient_json = F.pandas_udf(lambda s: s.map(lambda x: None if (v := lenient(x)) is None else json.dumps(v, ensure_ascii=False, sort_keys=True)), T.StringType())
citations_of = arrays(cited, T.ArrayType(T.IntegerType()))
bullets_of = arrays(whole_bullets, T.ArrayType(T.StringType()))
lines_bounded = arrays(line_chunks, T.ArrayType(T.StringType()))
pieces_of = arrays(fence_pieces, T.ArrayType(T.StringType()))


def folded(pdf: pd.DataFrame, total: int = 500 << 20, single: int = 100 << 20, most: int = 100, kinds: tuple[str, ...] = (".md", ".pdf")) -> pd.DataFrame:
    """Upload rows (batch, pos, name, size) with the first fault of each: only accepted files count towards the total."""
    out, used = [], 0
    for k, r in enumerate(pdf.sort_values("pos").itertuples()):
        dot = r.name.rfind(".")
        fault = None
        if k >= most:
            fault = "batch_limit"
        elif (r.name[dot:].lower() if dot > 0 else "") not in kinds:
            fault = "invalid_extension"
        elif r.size == r.size and r.size is not None:
            fault = "file_too_large" if r.size > single else "total_size_exceeded" if used + r.size > total else None
            used += r.size if fault is None else 0
        out.append((r.batch, r.pos, fault))
    return pd.DataFrame(out, columns=["batch", "pos", "fault"])
