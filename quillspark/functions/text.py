"""Scalar functions over titles, markdown, references, paths and transcripts: column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

C = F.col


def normal_title(x: Column) -> Column:
    """Lower case, single blanks, without trailing punctuation and dashes, without any quotes."""
    x = F.trim(F.regexp_replace(F.translate(F.lower(x), "‘’“”\"", "'''''"), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(x, r"[:.;,!?\-–— ]+$", ""), "'", "")


def file_title(name: Column) -> Column:
    """File name to title: no last extension, blanks for _ and -, words capitalised."""
    x = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[_\-]+", " ")
    return F.initcap(F.trim(F.regexp_replace(x, r"\s+", " ")))


def heading_level(line: Column) -> Column:
    return F.when(line.rlike(r"^#{1,6}\s"), F.length(F.regexp_extract(line, r"^(#+)", 1))).otherwise(0)


#: Patterns in the order in which markdown is stripped, and what stands in their place.
MARKDOWN = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?m)^#{1,6}\s+", "\n"),
    (r"!\[([^\]]*)\]\([^\)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"(?s)```.*?```", ""),
    (r"(?dm)^[-*_]{3,}$", ""),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]+", " "),
)


def plain_markdown(x: Column) -> Column:
    """Text without marks: images by their alternative text, links by theirs; lines stay."""
    for pattern, by in MARKDOWN:
        x = F.regexp_replace(x, pattern, by)
    return stripped(x)


def stripped(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+\z", "")


def reference_path(name: Column, headers: Column) -> Column:
    """name > first > last header; both or all where there are no more than two; empty ones dropped."""
    h = F.filter(headers, lambda x: x != "")
    short = F.when(F.size(h) > 2, F.array(F.element_at(h, 1), F.element_at(h, -1))).otherwise(h)
    return F.array_join(F.concat(F.array(name), short), " > ")


def page_id(course: Column, lecture: Column, number: Column) -> Column:
    return F.format_string("%s/%s/page_%03d", course, lecture, number)


def citations(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\[CITE:\s*([^\]]+?)\s*\]"), 1))


#: Fixed value: how a text names its references.
REFERENCES = r"(?i)\[Reference:\s*[\d,\s]+\]|\breference\s+\d+(?:(?:\s*,\s*|\s*(?:and|&)\s*)\d+)*"


def reference_numbers(x: Column) -> Column:
    """Distinct numbers in '[Reference: 1, 2]' and 'reference 1, 2 & 3', sorted."""
    found = F.regexp_extract_all(x, F.lit(REFERENCES), 0)
    digits = F.flatten(F.transform(found, lambda s: F.regexp_extract_all(s, F.lit(r"(\d+)"), 1)))
    return F.array_sort(F.array_distinct(F.transform(digits, lambda d: d.cast("int"))))


def paragraphs(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\n\s*\n"), lambda p: F.trim(p) != ""))


#: Words that tell the kind of a slide, the first kind that has one wins.
SLIDE_WORDS = {
    "chart": ["figure", "chart", "graph", "plot", "histogram", "bar", "pie", "line"],
    "table": ["table", "row", "column", "cell", "grid"],
    "diagram": ["diagram", "algorithm", "architecture", "flowchart", "uml", "schema"],
}


def slide_type(text: Column) -> Column:
    """chart, table or diagram by words between white space; other texts are text, blank ones unknown."""
    words, out = F.split(F.lower(text), r"\s+"), None
    for kind, keys in SLIDE_WORDS.items():
        test = F.arrays_overlap(words, F.array(*map(F.lit, keys)))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.when(text.rlike(r"\S"), "text").otherwise("unknown")


def sentences(x: Column) -> Column:
    """Cut after . ! ? where white space and a capital follow."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+(?=\p{Lu})"), lambda s: F.trim(s)), lambda s: s != "")


def shortened(x: Column, n: int = 180) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("…"))).otherwise(x)


def spoken(x: Column) -> Column:
    """For speech: no bracketed parts, line feeds as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)\[.*?\]", ""), r"\n", " "))


def final_channel(x: Column) -> Column:
    """What follows the thinking part, or all where there is none."""
    return F.when(x.contains("</think>"), F.regexp_extract(x, r"(?s)</think>(.*)$", 1)).otherwise(x)


def module_path(path: Column) -> Column:
    """The module of a file: four parts under 'practice' with at least five, three under 'study' and 'support' with at least four."""
    p = F.split(path, "/")
    kind = F.lower(F.element_at(p, 2))
    return F.when((kind == "practice") & (F.size(p) >= 5), F.array_join(F.slice(p, 1, 4), "/")).when(kind.isin("study", "support") & (F.size(p) >= 4), F.array_join(F.slice(p, 1, 3), "/"))


def breadcrumbs(path: Column) -> Column:
    """All leading paths of a path."""
    p = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.array_join(F.slice(p, F.lit(1), k), "/"))


def without_marked(x: Column, mark: str) -> Column:
    """Without the blocks between <!-- MARK_BEGIN --> and <!-- MARK_END -->."""
    return F.regexp_replace(x, rf"(?s)<!--\s*{mark}_BEGIN\s*-->.*?<!--\s*{mark}_END\s*-->", "")


def variant_text(ocr: Column, caption: Column, objects: Column, variant: int, cap: int = 32_000) -> Column:
    """v1: ocr; v2: and caption; v3: and objects; empty ones dropped, joined by line feeds."""
    parts = F.array(*[F.coalesce(p, F.lit("")) for p in (ocr, caption, objects)[:variant]])
    return F.substring(F.array_join(F.filter(parts, lambda s: F.trim(s) != ""), "\n"), 1, cap)
