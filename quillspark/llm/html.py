"""Main text of web pages by the distribution of text over lines.

The page is read once, tag by tag, into lines: one for each block, with its text, how much of it stands in links, and
what its containers say.  Lengths of text outside links and outside boilerplate containers are summed over sliding windows
of lines.  A surge point is a line whose window rises to the page's threshold, a dive point one where it falls below; what
stands between a surge and its dive is a stretch, near stretches joined.  The largest ``article`` or ``main`` element and the lines
outside of any are two candidates, and the one whose stretches have more text is taken, with all stretches of its main container:
the article, or else the smallest element with most of the text.  In an article short lines end no stretch, only runs of links do.

Names of boilerplate count as whole names (``sidebar``, ``site-footer``; not ``has-sidebar``).  A form, a header or a container of
such a name is none where it holds an article or most of the page's text; comments, notices and advertisements (``OTHERS``) only where nothing else is left, or an article is in them.

Defined cases: null and empty pages give an empty text; pages without any text outside boilerplate give an empty text;
broken markup is read as far as it goes; texts of any length are kept whole; repeated rows and other columns change nothing.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW = frozenset("script style textarea title noscript template iframe object svg math canvas audio video noembed noframes xmp".split())
#: Boilerplate whatever they hold, and elements that are boilerplate unless most of the page or an article is in them.
DROPPED = frozenset("nav footer aside select button menu dialog head datalist label input option".split())
LOOSE = frozenset("form fieldset header".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark a container as boilerplate, where a whole name consists of them and of words that say nothing.
HINTS = frozenset(
    "nav navbar navigation menu menubar header masthead topbar footer sidebar side aside complementary contentinfo banner notice alert popup modal overlay signup login search form share sharing social widget toolbar tags legal skip hidden".split()
)
#: The same for comments, notices and advertisements: often most of a short page, yet its main text only where there is no other.
OTHERS = frozenset("comment commentlist disqus reply replies respond discussion cookie consent gdpr ad adv advert advertisement sponsor sponsored promo promoted newsletter subscribe subscription copyright disclaimer related recommended breadcrumb pagination pager".split())
PLAIN = frozenset("site page global main top bottom left right primary secondary box block container wrapper wrap inner list item section area body bar links".split())
SPACE = re.compile(r"\s+")
WINDOW, FULL = 3, 80
#: Share of the text that the main container of a page without an article has at least.
MOST = 0.9
#: How surely an element is boilerplate.
NO, LIKELY, OTHER, SURE = range(4)


def hint(names: str) -> int:
    """NO, LIKELY or OTHER, by the names in a class, id or role."""
    worst = NO
    for name in names.lower().split():
        parts = [p for p in (re.sub(r"\d+$", "", x) for x in re.split(r"[-_]+", name)) if p]
        known = [OTHER if OTHERS & {p, p.removesuffix("s")} else LIKELY if HINTS & {p, p.removesuffix("s")} else NO if p in PLAIN else None for p in parts]
        if known and None not in known:
            worst = max(worst, *known)
    return worst


class Scanner:
    """Tags of a page, one by one, in time linear in its length whatever the markup."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.quotes = True  # until one of a tag swallows the rest of the page
        self.raw: dict[str, re.Pattern] = {}

    def end_of_tag(self, at: int) -> int:
        """The place of the > that ends the tag, outside quotes; -1: none."""
        page, first = self.page, self.page.find(">", at)
        if first < 0 or not self.quotes:
            return first
        while m := MARK.search(page, at):
            if m[0] == ">":
                return m.start()
            close = page.find(m[0], m.end())
            at = m.end() if close < 0 else close + 1  # a quote that never ends is none
        self.quotes = False
        return first

    def tags(self) -> Iterator[tuple[str, str, str, str]]:
        """(text before, kind: open, close, cdata or none, name, attributes) up to the last tag; what is left begins at `at`."""
        page, size, look = self.page, len(self.page), 0
        while (lt := page.find("<", look)) >= 0:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                after, kind, name, said = (size if end < 0 else end + 3), "none", "", ""
            elif page.startswith("<![CDATA[", lt) and (end := page.find("]]>", lt)) >= 0:
                after, kind, name, said = end + 3, "cdata", "", page[lt + 9 : end]
            elif page[lt + 1 : lt + 2] in ("!", "?"):
                if (end := page.find(">", lt)) < 0:
                    break
                after, kind, name, said = end + 1, "none", "", ""
            elif m := NAME.match(page, lt + 1):
                if (end := self.end_of_tag(m.end())) < 0:
                    break
                after, kind, name, said = end + 1, "close" if m[1] else "open", m[2].lower(), page[m.end() : end]
            else:
                look = lt + 1
                continue
            before, self.at = page[self.at : lt], after
            yield before, kind, name, said
            look = self.at  # skip() may have moved it on

    def skip(self, name: str) -> None:
        """Past the closing tag of an element whose content is no markup."""
        if name not in self.raw:
            self.raw[name] = re.compile(rf"</{re.escape(name)}\b", re.I)
        close = self.raw[name].search(self.page, self.at)
        end = self.page.find(">", close.end()) if close else -1
        self.at = len(self.page) if end < 0 else end + 1


class Stack:
    """Open elements; any of them is found by name at once."""

    def __init__(self):
        self.open: list[tuple[str, int]] = []  # name, number
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def top(self) -> tuple[str, int]:
        return self.open[-1] if self.open else ("", 0)

    def push(self, name: str, number: int) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        if name in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((name, number))

    def pop(self) -> None:
        name, _ = self.open.pop()
        self.places[name].pop()
        if name in BLOCKS:
            self.blocks.pop()

    def close(self, name: str) -> bool:
        """Ends the innermost element of that name; inline ones only where no block stands between."""
        places = self.places.get(name)
        if not places or name not in BLOCKS and self.blocks and self.blocks[-1] > places[-1]:
            return False
        at = places[-1]
        while len(self.open) > at:
            self.pop()
        return True


def read(page: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, bool, int, bool]]]:
    """(text, characters in links, element) of each block with text, and (parent, article or main, boilerplate, header) of each element; in page order."""
    out: list[tuple[str, int, int]] = []
    elements = [(0, False, NO, False)]
    text: list[str] = []
    links = link_depth = state = 0
    stack, scanner = Stack(), Scanner(page)

    def end_block() -> None:
        nonlocal links
        if text:
            joined = SPACE.sub(" ", "".join(text)).strip()
            if joined:
                out.append((joined, min(links, len(joined)), state))
            text.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        if raw:
            plain = entities.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if link_depth:
                links += len(plain.strip())

    for before, kind, name, said_raw in scanner.tags():
        say(before)
        if kind == "none":
            continue
        if kind == "cdata":
            text.append(said_raw)
            continue
        if kind == "close":
            if name == "a":
                link_depth = max(0, link_depth - 1)
            if name in BLOCKS or name in DROPPED or name in LOOSE:
                end_block()
            if stack.close(name):
                state = stack.top()[1]
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS or name in DROPPED or name in LOOSE:
            end_block()
        if name in VOID or said_raw.rstrip().endswith("/") and name in ("path", "svg"):
            continue
        if name in RAW:
            scanner.skip(name)
            continue
        if name == "a":
            link_depth += 1
        bad = SURE if name in DROPPED else LIKELY if name in LOOSE else NO
        if said_raw and bad < SURE and name not in ("html", "body", "main"):
            said = {a.lower(): (v or "").strip("\"'") for a, v in ATTRIBUTE.findall(said_raw)}
            if "hidden" in said or said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", said.get("style", "")):
                bad = SURE
            else:
                bad = max(bad, *(hint(said.get(a, "")) for a in ("class", "id", "role")))
        if name in ("p", "li") and stack.top()[0] == name:
            stack.pop()  # these end by themselves
        elements.append((stack.top()[1], name in ("article", "main"), bad, name == "header"))
        state = len(elements) - 1
        stack.push(name, state)
    rest = page[scanner.at :]
    say(rest if not re.match(r"<[a-zA-Z/!]", rest) else re.sub(r"<[^<>]*\Z", "", rest))
    end_block()
    return out, elements


Line = tuple[str, int, bool, int, int]


def lines(page: str) -> tuple[list[Line], list[int]]:
    """(text, characters in links, boilerplate, its outermost article or 0, element) of each block with text, and each element's parent."""
    out, elements = read(page)
    n = len(elements)
    own, holds, sure = [0] * n, [False] * n, [False] * n
    for i in range(1, n):
        sure[i] = elements[i][2] == SURE or sure[elements[i][0]]
    for text, linked, e in out:
        if not sure[e]:
            own[e] += len(text) - linked
    full = [False] * n  # with any text
    for _, _, e in out:
        full[e] = not sure[e]
    for i in range(n - 1, 0, -1):
        parent, article, bad, _ = elements[i]
        own[parent] += own[i]
        full[parent] |= full[i]
        holds[parent] |= full[i] and (holds[i] or article and bad == NO)
    for spared in (LIKELY, OTHER):
        off, article_of = [False] * n, [0] * n
        for i in range(1, n):
            parent, article, bad, header = elements[i]
            if off[parent] or bad == SURE:
                off[i] = True
            elif bad and not (header and bad == LIKELY and article_of[parent]):
                off[i] = not (holds[i] or bad <= spared and own[i] * 2 > own[0])
            article_of[i] = article_of[parent] or (i if article and not off[i] else 0)
        if any(not off[e] for _, _, e in out):
            break
    return [(text, linked, off[e], article_of[e], e) for text, linked, e in out], [x[0] for x in elements]


def surges(kept: list[Line], article: bool) -> list[list[int]]:
    """The stretches of lines from surge to dive."""
    weight = [max(0, len(x[0]) - 2 * x[1]) for x in kept]
    if article and not any(weight):
        weight = [len(x[0]) for x in kept]  # an article of links alone
    laden = [not w for w in weight]
    sums = [sum(weight[max(0, i - WINDOW // 2) : i + WINDOW // 2 + 1]) for i in range(len(kept))]
    surge = min(FULL, max(sums, default=0) * 0.5) or 1
    out: list[list[int]] = []  # windows above a quarter of the threshold, one of them above it
    for i, s in enumerate(sums):
        # in an article short lines end no stretch, only lines of links do
        if s >= surge / 4 or article and not laden[i]:
            if out and i - out[-1][1] < WINDOW:
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1])
    out = [x for x in out if max(sums[x[0] : x[1]]) >= surge]
    for x in out:
        while laden[x[0]]:
            x[0] += 1
        while laden[x[1] - 1]:
            x[1] -= 1
    return out


def amount(part: list[Line]) -> int:
    return sum(max(0, len(x[0]) - 2 * x[1]) for x in part)


def of_container(stretches: list[list[Line]], parents: list[int]) -> list[list[Line]]:
    """The stretches with lines in the smallest element that holds MOST of their text."""
    held = [0] * len(parents)
    for part in stretches:
        for x in part:
            held[x[4]] += amount([x])
    for i in range(len(parents) - 1, 0, -1):
        held[parents[i]] += held[i]
    main = max(i for i, x in enumerate(held) if x >= MOST * held[0])
    inside = [i == main for i in range(len(parents))]
    for i in range(1, len(parents)):
        inside[i] |= inside[parents[i]]
    return [part for part in stretches if any(inside[x[4]] for x in part)]


def extract(page: str | None) -> str:
    """The main text of a page; its blocks joined by line feeds."""
    got, parents = lines(page or "")
    got = [x for x in got if not x[2]]
    size: dict[int, int] = {}
    for x in got:
        if x[3]:
            size[x[3]] = size.get(x[3], 0) + len(x[0])
    largest = max(size, key=lambda k: (size[k], -k), default=0)
    article, rest = [x for x in got if x[3] and x[3] == largest], [x for x in got if not x[3]]
    inside, outside = ([part[a:b] for a, b in surges(part, part is article)] for part in (article, rest))
    if outside:
        outside = of_container(outside, parents)
    if inside and sum(map(amount, inside)) >= sum(map(amount, outside)):
        return "\n".join(x[0] for part in inside for x in part)
    return "\n".join(x[0] for part in outside for x in part if x[1] * 2 < len(x[0]))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(rows, "page_id long, url string, text string, n_chars long")
