"""Predicates, templates and small rules over texts and paths: column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .text import stripped

#: Markers of answers that are none.
UNANSWERED = ["not provided", "not mentioned", "not specified", "cannot be determined", "can't be determined", "unknown", "n/a"]
#: Question types that are taken, and the pairs of a page at most.
QUESTION_TYPES, PAIRS_A_PAGE = ["type_iii", "type_iv", "type_v"], 8
#: Words of the rules for forum posts.
SUBMISSION_WORDS = ["gradescope", "submi", "extension", "autograder", "slip day", "exception"]
FIRST_PERSON = [" i ", " i'", " me ", " my ", " mine "]
DATED_WORDS = ["submi", "post", "release", "due"]
#: Words of questions about pictures, variants by mode, the instruction of one model family.
VISUAL_WORDS = ["chart", "graph", "plot", "diagram", "figure", "image", "picture", "table", "illustration", "visual", "show"]
MODE_VARIANT = {"A1": "v1", "A2": "v2", "A3": "v3", "A4": "v3"}
QUERY_PREFIX = "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: "
PREFIXED_MODELS = ["qwen3-embedding", "qwen-embedding"]
#: Words that titles are compared without.
TITLE_NOISE = ["options", "section", "part", "chapter"]
LONGEST_TEXT = 32_000


def any_in(text: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the text."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def occurrences(text: Column, words: list[str]) -> Column:
    """How often the words stand in the text, without overlaps, summed up."""
    each = [(F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) for w in words]
    return sum(each[1:], each[0]).cast("int")


def blank(x: Column) -> Column:
    """Null or empty."""
    return x.isNull() | (x == "")


def grounded(answer: Column) -> Column:
    """Whether an answer holds none of the markers of a missing one."""
    return ~any_in(F.lower(stripped(F.coalesce(answer, F.lit("")))), UNANSWERED)


def loose(x: Column) -> Column:
    """Lower case, single blanks: what questions are compared by."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def title_words(title: Column) -> Column:
    """The words of a title without stars, punctuation and words that come and go."""
    words = F.split(F.trim(F.lower(F.regexp_replace(title, r"""[!-/:-@\[-`{-~]""", ""))), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(TITLE_NOISE))


def titles_match(a: Column, b: Column, share: float = 0.7) -> Column:
    """One title stands in the other, or enough words of the shorter one are in both; a and b are title_words."""
    x, y = F.array_join(a, " "), F.array_join(b, " ")
    words_a, words_b = F.array_distinct(a), F.array_distinct(b)
    common = F.size(F.array_intersect(words_a, words_b)) / F.least(F.size(words_a), F.size(words_b))
    return F.contains(x, y) | F.contains(y, x) | ((F.size(a) > 0) & (F.size(b) > 0) & (common >= share))


def post_fate(text: Column, private: Column) -> Column:
    """Why a forum post goes: private, personal, dated; null: it stays."""
    t = F.lower(text)
    personal = (F.contains(t, F.lit("waitlist")) | (occurrences(t, SUBMISSION_WORDS) > 1)) & (occurrences(t, FIRST_PERSON) > 2)
    dated = (F.contains(t, F.lit("when")) & any_in(t, DATED_WORDS)) | (F.contains(t, F.lit("publish")) & F.contains(t, F.lit(" be ")))
    short = F.size(F.split(t, " ")) < 10
    return F.when(private, "private").when(personal, "personal").when(dated | (short & F.contains(t, F.lit("release"))), "dated")


def valid_module(path: Column) -> Column:
    """practice/*/name, study/name or support/name, without a way out of the tree."""
    p = F.regexp_replace(F.trim(path), "/+$", "")
    return F.coalesce(p.rlike("^(?:practice/[^/]*/[^/]*|(?:study|support)/[^/]*)$") & ~F.contains(p, F.lit("..")), F.lit(False))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; * crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if close > 0:
            inside = pattern[i + 1 : close].replace("\\", r"\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", close
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def _any_like(parts: Column, pattern: str) -> Column:
    return F.exists(parts, lambda x: x.rlike(pattern))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a file's path meets an ignore pattern: `dir/` by any directory above it, others by the path, the name, or around one **."""
    parts = F.split(path, "/")
    name, above = F.element_at(parts, -1), F.slice(parts, F.lit(1), F.size(parts) - 1)
    tests = [F.lit(False)]
    for p in (p.removeprefix("!") for p in patterns):
        if p.endswith("/"):
            tests.append(_any_like(above, glob_regex(p.rstrip("/"))))
            continue
        tests += [path.rlike(glob_regex(p)), name.rlike(glob_regex(p))]
        if p.count("**") == 1:
            head, tail = p.split("**")
            tests.append(F.startswith(path, F.lit(head.rstrip("/"))) & F.endswith(path, F.lit(tail.lstrip("/"))))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def without_tutor_links(x: Column) -> Column:
    """Without comment lines that link to the code visualiser."""
    return F.array_join(F.filter(F.split(x, "\n"), lambda s: ~(F.startswith(F.trim(s), F.lit("#")) & F.contains(s, F.lit("pythontutor.com")))), "\n")


def marked_bodies(x: Column, mark: str) -> Column:
    """The trimmed bodies between the comments MARK_BEGIN and MARK_END."""
    return F.transform(F.regexp_extract_all(x, F.lit(rf"(?s)<!--\s*{mark}_BEGIN\s*-->(.*?)<!--\s*{mark}_END\s*-->"), 1), stripped)


def without_images(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)!\[.*?\]\(.*?\)", "")


def extracted_variant(x: Column, variant: int, blank_base: bool = False) -> Column:
    """v1: the whole text without image blocks and images; v2: and the captions; v3: and the notes; null for none.

    Blank parts are left out; blank_base: the text itself stays even so.
    """
    base = without_images(F.regexp_replace(x, r"(?s)<!--\s*TAI_VLM_BEGIN.*?TAI_VLM_END\s*-->", ""))
    if variant == 1:
        return base
    said = F.filter(F.concat(*[marked_bodies(x, m) for m in ("TAI_V2", "TAI_V3")[: variant - 1]]), lambda s: s.rlike(r"\S"))
    first = F.array(base) if blank_base else F.filter(F.array(base), lambda s: s.rlike(r"\S"))
    return F.when(x.isNotNull(), F.array_join(F.concat(first, said), "\n"))


def page_variant(text: Column, captions: Column, notes: Column, variant: int) -> Column:
    """The same for a page, whose captions and notes come as arrays; parts stand apart by blank lines."""
    parts = F.concat(F.array(stripped(F.regexp_replace(text, r"!\[.*?\]\(.*?\)", ""))), *[captions, notes][: variant - 1])
    return F.substring(F.array_join(F.filter(parts, lambda s: s != ""), "\n\n"), 1, LONGEST_TEXT)


def tidy_lines(x: Column) -> Column:
    """Without lines of hash marks alone, no more than one blank line in a row, one line feed at the end."""
    x = F.regexp_replace(F.regexp_replace(x, r"(?dm)^[ \t]*#+[ \t]*$", ""), r"\n{3,}", "\n\n")
    return F.concat(stripped(x), F.lit("\n"))


def title_path(titles: Column) -> Column:
    """Titles of a JSON list, joined by ' > '; anything else as it is."""
    return F.coalesce(F.array_join(F.from_json(titles, "array<string>"), " > "), titles)


def document_template(titles: Column, text: Column) -> Column:
    return F.concat(F.lit("document_hierarchy_path: "), title_path(titles), F.lit("\ndocument: "), text, F.lit("\n"))


def file_template(name: Column, course: Column, content: Column) -> Column:
    return F.concat(F.lit("File: "), name, F.lit("\nCourse: "), course, F.lit("\n\nContent:\n"), content)


def query_text(model: Column, query: Column) -> Column:
    """The query with the instruction that its model's family wants."""
    return F.when(any_in(F.lower(F.coalesce(model, F.lit(""))), PREFIXED_MODELS), F.concat(F.lit(QUERY_PREFIX), query)).otherwise(query)


def variant_of_mode(mode: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in MODE_VARIANT.items() for x in kv])[mode]


def reads_image(mode: Column, question: Column, top_score: Column, threshold: float = 0.3) -> Column:
    """Whether the picture itself is read: in mode A4, for words about pictures or a weak first page."""
    return (mode == "A4") & (any_in(F.lower(question), VISUAL_WORDS) | F.coalesce(top_score < threshold, F.lit(False)))


def message_text(x: Column) -> Column:
    """An assistant's message without the thinking block before it and the references after it."""
    has = F.contains(x, F.lit("<!--THINKING-BLOCK:")) & F.contains(x, F.lit("-->"))
    x = F.when(has, stripped(F.regexp_replace(x, r"(?s)^.*?-->", ""))).otherwise(x)
    return F.when(F.contains(x, F.lit("<!--REFERENCES:")), stripped(F.regexp_replace(x, r"(?s)<!--REFERENCES:(?!.*<!--REFERENCES:).*$", ""))).otherwise(x)


def tail(x: Column, n: int) -> Column:
    return F.right(x, F.lit(n))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("/"), F.lit("-")), r"[^A-Za-z0-9._-]+", "-")


def by_folder(path: Column, rules: dict[str, list[str]]) -> Column:
    """The first rule any of whose folders stands in the path."""
    out = None
    for name, folders in rules.items():
        out = F.when(any_in(path, folders), name) if out is None else out.when(any_in(path, folders), name)
    return out


def vector_of(raw: Column) -> Column:
    """A vector from its JSON text; null for anything that isn't a list of numbers."""
    return F.try_variant_get(F.try_parse_json(raw), "$", "array<double>")


def blob_fault(size: Column, widest: int = 16_384) -> Column:
    """What is wrong with a packed float32 vector of that many bytes; null: nothing."""
    return F.when(size % 4 != 0, "ragged").when(size == 0, "empty").when(size / 4 > widest, "too wide")


def spoken_roles(text: Column, roles: Column) -> Column:
    """Speaker names (keys of the map roles) by their roles, plain or bold, at the start of lines."""
    return F.aggregate(F.map_entries(roles), text, lambda acc, e: F.regexp_replace(acc, F.concat(F.lit(r"(?m)^(\*\*)?"), e["key"], F.lit(r"(\*\*)?:")), F.concat(F.lit("$1"), e["value"], F.lit("$2:"))))


def first_distinct(values: Column, n: int) -> Column:
    """The first n values that differ in lower case, trimmed, without blank ones."""
    kept = F.aggregate(F.transform(values, lambda v: F.trim(v)), F.array().cast("array<string>"), lambda acc, v: F.when((v == "") | F.exists(acc, lambda x: F.lower(x) == F.lower(v)), acc).otherwise(F.concat(acc, F.array(v))))
    return F.slice(kept, 1, n)
