"""Markdown made of structured content: answer blocks, titles, notebooks, threads, navigation.  Columns, but for what nests or counts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..operators.sequence import repaired_levels
from .parsing import arrays
from .rules import DATED_WORDS, FIRST_PERSON, SUBMISSION_WORDS

BLOCKS = "array<struct<type:string,markdown_content:string,language:string,level:int,unreadable:string,citations:array<struct<id:string,quote_text:string>>>>"
#: The two spellings of a transcript's fields, the later one first.
SEGMENT_FIELDS = {"start_time": ["start_time", "start time"], "end_time": ["end_time", "end time"], "speaker": ["speaker"], "text_content": ["text_content", "text content"]}
#: Words of questions, and the lines of a site's configuration that are read.
QUESTION_WORDS = [" can ", "could", "who", "what", "when", "where", "why", "how", "?"]
SITE_KEYS = ("repo_url:", "edit_uri:", "docs_dir:")


def _text(x: Column) -> Column:
    """Without white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"\A\s+|\s+\z", "")


def _fenced(language: Column, body: Column) -> Column:
    return F.concat(F.lit("```"), language, F.lit("\n"), body, F.lit("\n```"))


def block_markdown(block: Column, unreadable: bool = True) -> Column:
    """One block of an answer as markdown: headings (level 2 unless told), fenced code, other text; then its citations and what can't be read out."""
    kind, said, language = _text(block["type"]), _text(block["markdown_content"]), _text(block["language"])
    hidden = _text(block["unreadable"]) if unreadable else F.lit("")
    shown = F.when(kind == "code_block", _fenced(language, hidden)).when(kind == "math", F.concat(F.lit("$$\n"), hidden, F.lit("\n$$"))).otherwise(_fenced(F.lit(""), hidden))
    level = F.when(block["level"].between(1, 6), block["level"]).otherwise(2)
    heading = F.when(said.startswith("#"), said).otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), said))
    code = F.when(said.startswith("```"), said).otherwise(_fenced(language, F.regexp_replace(block["markdown_content"], r"\n+\z", "")))
    body = F.when(kind == "heading", heading).when(kind == "code_block", code).otherwise(said)
    cited = F.filter(F.coalesce(block["citations"], F.array().cast("array<struct<id:string,quote_text:string>>")), lambda c: c["id"].try_cast("int").isNotNull())
    number = lambda c: c["id"].cast("int").cast("string")
    quote = lambda c: _text(c["quote_text"])
    marks = F.transform(cited, lambda c: F.when(quote(c) != "", F.concat(F.lit(" [Reference "), number(c), F.lit(': "'), quote(c), F.lit('"]'))).otherwise(F.concat(F.lit(" [Reference: "), number(c), F.lit("]"))))
    whole = F.concat(body, F.array_join(marks, ""), F.when(hidden != "", F.concat(F.lit("\n"), shown)).otherwise(""))
    return F.when(said != "", whole).when(hidden != "", shown).otherwise("")


def answer_markdown(blocks: Column, unreadable: bool = True) -> Column:
    """All blocks that say something, a blank line after each but the last block."""
    parts = F.transform(blocks, lambda b: block_markdown(b, unreadable))
    return F.array_join(F.transform(parts, lambda p, i: F.when((p != "") & (i < F.size(parts) - 1), F.concat(p, F.lit("\n\n"))).otherwise(p)), "")


def transcript_segments(raw: Column) -> Column:
    """Segments of a JSON transcript under one spelling of their fields; those without all four go, what is no list is empty."""
    parsed = F.from_json(raw, "array<map<string,string>>")
    fields = lambda m: {n: F.coalesce(*(F.try_element_at(m, F.lit(s)) for s in spelt)) for n, spelt in SEGMENT_FIELDS.items()}
    made = F.transform(parsed, lambda m: F.struct(*(v.cast("double").alias(n) if n.endswith("time") else v.alias(n) for n, v in fields(m).items())))
    whole = F.filter(made, lambda s: s["start_time"].isNotNull() & s["end_time"].isNotNull() & s["speaker"].isNotNull() & s["text_content"].isNotNull())
    return F.coalesce(whole, F.array().cast("array<struct<start_time:double,end_time:double,speaker:string,text_content:string>>"))


def without_own_title(markdown: Column, name: Column) -> Column:
    """Without a first heading that repeats the file's name; the headings below it move up by one where they have several levels."""
    first, rest = F.substring_index(markdown, "\n", 1), F.regexp_replace(markdown, r"\A[^\n]*\n?", "")
    repeats = first.startswith("# ") & (F.lower(F.translate(name, "-_", "  ")) == F.lower(_text(F.regexp_replace(first, r"\A[# ]+", ""))))
    rest = F.regexp_replace(rest, r"\A(?:[^\S\n]*(?:\n|\z))+", "")
    depths = F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(r"(?m)^[^\S\n]*(#+)"), 1), F.length))
    risen = F.when(F.size(depths) > 1, F.regexp_replace(rest, r"(?m)^([^\S\n]*)##", "$1#")).otherwise(rest)
    return F.when(repeats, risen).otherwise(markdown)


def titled_paragraphs(markdown: Column, paragraphs: Column, sections: Column) -> Column:
    """Text without titles under given ones: paragraphs (paragraph_index from 1, title), sections (start_paragraph_index, section_title) above them."""
    own = F.filter(F.transform(F.split(markdown, "\n\n"), _text), lambda p: p != "")
    depth = F.when(F.size(sections) > 0, "## ").otherwise("# ")

    def part(p: Column) -> Column:
        above = F.transform(F.filter(sections, lambda s: s["start_paragraph_index"] == p["paragraph_index"]), lambda s: F.concat(F.lit("# "), _text(s["section_title"]), F.lit("\n\n")))
        body = F.coalesce(F.concat(F.get(own, p["paragraph_index"] - 1), F.lit("\n\n")), F.lit(""))
        return F.concat(F.coalesce(F.try_element_at(above, F.lit(-1)), F.lit("")), depth, _text(p["title"]), F.lit("\n\n"), body)

    return F.array_join(F.transform(F.array_sort(paragraphs), part), "")


def releveled(markdown: str, titles: list, normal=None) -> str:
    """Headings whose title is in the list (title, level) get its repaired level; as many at most as the list is long."""
    normal = normal or (lambda t: re.sub(r"\s+", " ", t).strip().lower())
    levels = repaired_levels([level for _, level in titles])
    wanted = {normal(title): level for (title, _), level in zip(titles, levels) if title}
    left, out = len(titles), []
    for line in markdown.split("\n"):
        heading = re.match(r"#{1,6}\s+(\S.*)$", line.strip())
        if heading and left and (level := wanted.get(normal(heading[1].strip()))):
            left, line = left - 1, f"{'#' * level} {heading[1].strip()}"
        out.append(line)
    return "\n".join(out)


def headings_repaired(markdown: str) -> str:
    """Headings without jumps of more than one level."""
    lines = markdown.split("\n")
    at = [i for i, line in enumerate(lines) if re.match(r"#{1,6}\s+\S", line)]
    for i, level in zip(at, repaired_levels([len(lines[i]) - len(lines[i].lstrip("#")) for i in at])):
        lines[i] = "#" * level + lines[i].lstrip("#")
    return "\n".join(lines)


def notebook_markdown(raw: Column) -> Column:
    """An exported notebook without its first line: the second line after it is the title, other headings go down by one, then jumps are repaired."""
    lines = F.slice(F.split(raw, "\n"), 2, 1 << 30)
    made = F.transform(lines, lambda x, i: F.when(i == 1, F.concat(F.lit("# "), _text(F.regexp_replace(x, "^#+", "")))).when(x.startswith("#"), F.concat(F.lit("#"), _text(x))).otherwise(_text(x)))
    return repaired_headings(F.array_join(made, "\n"))


def _entry(post: dict, name: str = "User") -> str:
    return f"**{name}:** {post['user']['name']}\n**Role:** {post['user']['role']}\n**URL:** {post['url']}\n"


def thread_markdown(raw: str) -> str:
    """Posts of a forum (JSON) with their comments and answers, at any depth; a reply with replies of its own ends in a blank line."""

    def replies(below: list) -> Iterator[str]:
        todo = [*reversed(below)]  # a stack, not recursion: threads may be deep
        while todo:
            reply = todo.pop()
            if isinstance(reply, str):
                yield reply
                continue
            yield _entry(reply) + f"{reply['text']}\n"
            if inner := reply.get("comments"):
                todo += ["\n", *reversed(inner)]

    out = []
    for post in json.loads(raw):
        out.append(f"# {post['title']}\n" + _entry(post) + f" {post['text']}\n")
        for field, head, name in (("comments", "### Comment\n", "User"), ("answers", "### Answer \n", "Name")):
            for reply in post.get(field) or []:
                out += [head, _entry(reply, name), f"{reply['text']}\n", *replies(reply.get("comments") or [])]
    return "".join(out)


def comment_fate(comment: dict) -> str:
    """stays, goes, or asks: a question that stays once for each of its replies that is to the point."""
    text, below = comment["text"].lower(), comment["comments"]
    count = lambda words: sum(text.count(w) for w in words)
    if comment["user"]["role"] == "admin":
        return "stays"
    popular = comment["votes"] > 0 or any(r["user"]["role"] == "student" for r in below)
    dated = ("when" in text and any(w in text for w in DATED_WORDS)) or ("publish" in text and " be" in text) or (len(text.split(" ")) < 15 and "release" in text)
    if (not popular and (not below or count(FIRST_PERSON) > 2)) or count(SUBMISSION_WORDS) > 1 or dated:
        return "goes"
    return "asks" if any(w in text for w in QUESTION_WORDS) else "stays"


def comments_kept(comments: list[dict]) -> list[dict]:
    """The comments that stay, with the replies that stay; a new tree."""
    out = []
    for c in comments:
        fate = comment_fate(c)
        if fate == "stays":
            out.append(c | {"comments": comments_kept(c["comments"])})
        elif fate == "asks":
            answered = any(r["user"]["role"] == "admin" for r in c["comments"])
            beside = [answered and not r["comments"] and not r["votes"] and r["user"]["role"] != "admin" for r in c["comments"]]
            whole = c | {"comments": [r | {"comments": comments_kept(r["comments"])} for r in c["comments"]]}
            out += [whole] * beside.count(False)
    return out


def toctree(text: str) -> list[str]:
    """Entries of the .. toctree:: blocks of a page: the target in <>, or the line itself."""
    out, lines = [], text.split("\n")
    for i, line in enumerate(lines):
        if line.startswith(".. toctree::"):
            blanks = [j for j in range(i + 1, len(lines)) if not lines[j].strip()]
            begin = blanks[0] + 1 if blanks else len(lines)
            end = next((j for j in blanks if j >= begin), len(lines))
            out += [m[1].strip() if (m := re.search(r"<(.*?)>", x)) else x.strip() for x in lines[begin:end]]
    return out


def site_navigation(text: str) -> str:
    """The repository keys of a site's configuration and its navigation list, as they stand."""
    out, lines = [], text.split("\n")
    for i, line in enumerate(lines):
        if line.strip().startswith(SITE_KEYS):
            out.append(line)
        elif line.strip().startswith("nav:"):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() and lines[j].strip()[0] not in "-#"), len(lines))
            return "\n".join([*out, *lines[i:end]])
    return "\n".join(out)


repaired_headings = arrays(headings_repaired, T.StringType())
threads_rendered = arrays(thread_markdown, T.StringType())
comments_filtered = arrays(lambda raw: json.dumps(comments_kept(json.loads(raw)), ensure_ascii=False), T.StringType())
toctree_of = arrays(toctree, T.ArrayType(T.StringType()))
navigation_of = arrays(site_navigation, T.StringType())


class _Markdown(HTMLParser):
    """Markdown of a page, or of its parts that a (tag, class) pair names: headings, lists, links, emphasis, code, tables as rows of cells."""

    MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
    BLOCKS = {"p", "div", "section", "article", "main", "table", "blockquote", "pre", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6"}
    HIDDEN = {"script", "style", "head", "template"}
    #: Tags without an end.
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, parts: list[tuple[str, str]]):
        super().__init__(convert_charrefs=True)
        self.parts, self.out, self.open = parts, [], []
        self.lists, self.links, self.deep, self.hidden, self.inside = [], [], 0, 0, 0

    def handle_starttag(self, tag, attrs):
        here = dict(attrs)
        if tag in self.VOID:
            if self.shown and tag in ("br", "hr"):
                self.out.append("  \n" if tag == "br" else "\n\n---\n\n")
            elif self.shown and tag == "img" and here.get("src"):
                self.out.append(f"![{here.get('alt') or ''}]({here['src']})")
            return
        chosen = any(tag == t and c in (here.get("class") or "").split() for t, c in self.parts)
        if chosen and not self.inside:
            self.out.append("\n\n")
        self.inside += chosen
        self.hidden += tag in self.HIDDEN
        self.open.append((tag, chosen))
        if not self.shown:
            return
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        if tag == "pre":
            self.deep += 1
            self.out.append("\n\n```\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("* " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "a":
            self.links.append(here.get("href"))
            self.out.append("[" if here.get("href") else "")
        elif tag in self.MARKS and not self.deep:
            self.out.append(self.MARKS[tag])
        elif tag in ("tr", "td", "th"):
            self.out.append("\n" if tag == "tr" else "| ")
        elif tag in self.BLOCKS and not (tag in ("ul", "ol") and len(self.lists) > 1):
            self.out.append("\n\n" + ("#" * int(tag[1]) + " " if tag[0] == "h" else ""))

    def handle_endtag(self, tag):
        if tag not in (t for t, _ in self.open):
            return
        while self.open:  # what stands open within it ends with it
            name, chosen = self.open.pop()
            if self.shown:
                self.finish(name)
            self.inside -= chosen
            self.hidden -= name in self.HIDDEN
            if name == tag:
                return

    def finish(self, tag):
        if tag == "pre":
            self.deep -= 1
            self.out.append("\n```\n\n")
        elif tag == "a" and self.links:
            target = self.links.pop()
            self.out.append(f"]({target})" if target else "")
        elif tag in self.MARKS and not self.deep:
            self.out.append(self.MARKS[tag])
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag in self.BLOCKS:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.out.append("" if self.lists else "\n\n")

    def handle_data(self, data):
        if self.shown:
            self.out.append(data if self.deep else re.sub(r"\s+", " ", data))

    @property
    def shown(self) -> bool:
        return not self.hidden and (bool(self.inside) or not self.parts)


def html_markdown(html: str, parts: list[tuple[str, str]] = ()) -> str:
    """A page as markdown: only the parts named by (tag, class), or all of it; blocks stand a blank line apart, fences on lines of their own.

    An unfinished tag at the end is text, as the standard parser has it.
    """
    parser = _Markdown(list(parts))
    parser.feed(html.replace("\xa0", " "))
    parser.close()
    out, fenced = [], False
    for line in "".join(parser.out).split("\n"):
        fence = line.startswith("```")
        if not fenced and not fence:
            line = re.sub(r"(?<=\S) {2,}(?=\S)", " ", line.rstrip() if line.strip() else "")
            line = line if re.match(r"\s*(?:\*|\d+\.) ", line) else line.lstrip()
            if not line and (not out or not out[-1]):
                continue
        fenced ^= fence
        out.append(line)
    return "\n".join(out).strip("\n")


def page_markdown(html: Column, url: Column, parts: dict[str, list[tuple[str, str]]]) -> Column:
    """html_markdown with the parts of the first site (host and beginning of the path) that the page belongs to."""
    sites = [(*re.match(r"[a-z]+://([^/?#]*)([^?#]*)", key).groups(), chosen) for key, chosen in parts.items()]

    @F.pandas_udf(T.StringType())
    def convert(pages: pd.Series, urls: pd.Series) -> pd.Series:
        out = []
        for page, address in zip(pages, urls):
            found = re.match(r"[A-Za-z]+://([^/?#]*)([^?#]*)", address or "")
            chosen = next((c for host, path, c in sites if found and found[1] == host and found[2].startswith(path)), [])
            out.append(None if page is None else html_markdown(page, chosen))
        return pd.Series(out, dtype=object)

    return convert(html, url)
