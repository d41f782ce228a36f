"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and Python closures are
generated that render conversations.  Rendering streams: a loop holds one message and the next, so that a conversation
of any length needs the memory of two turns.  Text between ``generation`` marks is under the loss mask.

The language: ``{{ expression }}``, ``{% for x in xs %} .. {% endfor %}``, ``{% if %} .. {% elif %} .. {% else %} .. {% endif %}``,
``{% set name = expression %}``, ``{% generation %} .. {% endgeneration %}``, ``{# comment #}``; expressions of literals, names,
``a.b``, ``a['b']``, ``not``, ``and``, ``or``, ``== != < > <= >=``, ``in``, ``+``, ``~``, ``x if c else y`` and the filters below.
There are no calls and no attributes of Python objects: only keys of the values given.

Defined cases: null text and null role are empty; rows of one turn number come in order of role and text; repeated rows are
turns of their own; rows with null conv_id form one conversation, null turns come last; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CHATML = "{% for message in messages %}<|im_start|>{{ message.role | escape_role }}\n{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"


def escape(text: str) -> str:
    """Adds a backslash between each ``<`` and ``|`` (whatever backslashes are there), so no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


FILTERS: dict[str, Callable] = {"escape": escape, "escape_role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


class TemplateError(ValueError):
    pass


# Expressions are ("const", value), ("name", n), ("get", e, e), ("filter", name, e), ("not", e), ("bin", op, e, e), ("if", c, a, b).
# Statements are ("text", s), ("out", e), ("for", name, e, body), ("case", [(e, body)], body), ("set", name, e), ("gen", body).

TOKEN = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|<=|>=|[<>+~.|()\[\]]))")
OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: f"{a}{b}",
}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class Expressions:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *words: str) -> bool:
        if self.peek() in words:
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise TemplateError(f"expected {word!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def done(self, tree):
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return ("if", test, value, self.choice())
        return value

    def either(self):
        left = self.both()
        while self.take("or"):
            left = ("bin", "or", left, self.both())
        return left

    def both(self):
        left = self.inverse()
        while self.take("and"):
            left = ("bin", "and", left, self.inverse())
        return left

    def inverse(self):
        return ("not", self.inverse()) if self.take("not") else self.compare()

    def compare(self):
        left = self.add()
        while (op := self.peek()) in ("==", "!=", "<", ">", "<=", ">=", "in"):
            self.at += 1
            left = ("bin", op, left, self.add())
        return left

    def add(self):
        left = self.unary()
        while (op := self.peek()) in ("+", "~"):
            self.at += 1
            left = ("bin", op, left, self.unary())
        return left

    def unary(self):
        value = self.atom()
        while True:
            if self.take("."):
                value = ("get", value, ("const", self.name()))
            elif self.take("["):
                value = ("get", value, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                value = ("filter", name, value)
            else:
                return value

    def atom(self):
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("const", int(text))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list:
    """The syntax tree of a template."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", source, flags=re.S)
    at = 0

    def block(*ends: str) -> tuple[list, str, str]:
        nonlocal at
        body: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{#") or not part:
                continue
            if part.startswith("{{"):
                e = Expressions(part[2:-2])
                body.append(("out", e.done(e.choice())))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return body, word, rest
                body.append(statement(word, rest))
            else:
                body.append(("text", part))
        if ends:
            raise TemplateError(f"missing {ends[0]}")
        return body, "", ""

    def statement(word: str, rest: str):
        e = Expressions(rest if word in ("for", "if") else "")
        if word == "for":
            name = e.name()
            e.need("in")
            over = e.done(e.choice())
            return ("for", name, over, block("endfor")[0])
        if word == "if":
            cases, test = [], e.done(e.choice())
            while True:
                body, end, more = block("elif", "else", "endif")
                cases.append((test, body))
                if end == "elif":
                    f = Expressions(more)
                    test = f.done(f.choice())
                else:
                    return ("case", cases, block("endif")[0] if end == "else" else [])
        if word == "set":
            m = re.fullmatch(r"\s*([A-Za-z]\w*)\s*=\s*(.*)", rest, flags=re.S)
            if not m:
                raise TemplateError("expected: set name = expression")
            f = Expressions(m[2])
            return ("set", m[1], f.done(f.choice()))
        if word == "generation":
            return ("gen", block("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


def fold(e):
    """Constant expressions become their values."""
    kind = e[0]
    if kind == "get":
        return ("get", fold(e[1]), fold(e[2]))
    if kind == "filter":
        x = fold(e[2])
        return ("const", FILTERS[e[1]](x[1])) if x[0] == "const" else ("filter", e[1], x)
    if kind == "not":
        x = fold(e[1])
        return ("const", not x[1]) if x[0] == "const" else ("not", x)
    if kind == "bin":
        a, b = fold(e[2]), fold(e[3])
        if e[1] in ("and", "or"):
            return (b if bool(a[1]) == (e[1] == "and") else a) if a[0] == "const" else ("bin", e[1], a, b)
        return ("const", OPERATORS[e[1]](a[1], b[1])) if a[0] == b[0] == "const" else ("bin", e[1], a, b)
    if kind == "if":
        c = fold(e[1])
        return fold(e[2] if c[1] else e[3]) if c[0] == "const" else ("if", c, fold(e[2]), fold(e[3]))
    return e


def fold_body(body: list) -> list:
    """Folded statements; decided branches are taken, and adjacent text is joined."""
    out: list = []

    def add(s):
        if s[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + s[1])
        elif s != ("text", ""):
            out.append(s)

    for s in body:
        if s[0] == "out":
            e = fold(s[1])
            add(("text", shown(e[1])) if e[0] == "const" else ("out", e))
        elif s[0] == "for":
            add(("for", s[1], fold(s[2]), fold_body(s[3])))
        elif s[0] == "case":
            cases, rest = [], fold_body(s[2])
            for test, inner in s[1]:
                test = fold(test)
                if test[0] != "const":
                    cases.append((test, fold_body(inner)))
                elif test[1]:
                    rest = fold_body(inner)
                    break
            for x in rest if not cases else [("case", cases, rest)]:
                add(x)
        elif s[0] == "set":
            add(("set", s[1], fold(s[2])))
        elif s[0] == "gen":
            add(("gen", fold_body(s[1])))
        else:
            add(s)
    return out


def shown(value) -> str:
    return "" if value is None else str(value)


def value_of(e) -> Callable[[dict], object]:
    """A closure that evaluates an expression."""
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    if kind == "get":
        a, b = value_of(e[1]), value_of(e[2])

        def get(env):
            x = a(env)
            if isinstance(x, dict):
                return x.get(b(env))
            if isinstance(x, (list, tuple, str)) and isinstance(k := b(env), int):
                return x[k] if k < len(x) else None
            return None

        return get
    if kind == "filter":
        return lambda env, f=FILTERS[e[1]], a=value_of(e[2]): f(a(env))
    if kind == "not":
        return lambda env, a=value_of(e[1]): not a(env)
    if kind == "if":
        return lambda env, c=value_of(e[1]), a=value_of(e[2]), b=value_of(e[3]): a(env) if c(env) else b(env)
    a, b = value_of(e[2]), value_of(e[3])
    if e[1] == "and":
        return lambda env: a(env) and b(env)
    if e[1] == "or":
        return lambda env: a(env) or b(env)
    return lambda env, f=OPERATORS[e[1]]: f(a(env), b(env))


def generate(body: list) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    """A closure that yields (text, under the loss mask) of the statements."""
    steps: list[Callable] = []
    for s in body:
        if s[0] == "text":
            steps.append(lambda env, mask, t=s[1]: ((t, mask),))
        elif s[0] == "out":
            steps.append(lambda env, mask, f=value_of(s[1]): ((shown(f(env)), mask),))
        elif s[0] == "set":

            def assign(env, mask, n=s[1], f=value_of(s[2])):
                env[n] = f(env)
                return ()

            steps.append(assign)
        elif s[0] == "gen":
            steps.append(lambda env, mask, f=generate(s[1]): f(env, True))
        elif s[0] == "for":

            def loop(env, mask, n=s[1], over=value_of(s[2]), f=generate(s[3])):
                items, k = iter(over(env) or ()), 0
                item = next(items, loop)
                while item is not loop:
                    after = next(items, loop)
                    inner = env | {n: item, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": after is loop}}
                    yield from f(inner, mask)
                    item, k = after, k + 1

            steps.append(loop)
        else:

            def case(env, mask, cases=[(value_of(t), generate(b)) for t, b in s[1]], rest=generate(s[2])):
                for test, f in cases:
                    if test(env):
                        return f(env, mask)
                return rest(env, mask)

            steps.append(case)

    def run(env: dict, mask: bool = False):
        for step in steps:
            yield from step(env, mask)

    return run


class Template:
    def __init__(self, source: str = CHATML):
        self.tree = fold_body(parse(source))
        self.run = generate(self.tree)

    def stream(self, messages: Iterable[dict], **names) -> Iterator[tuple[str, bool]]:
        """(text, under the loss mask), piece by piece; messages may be any iterator."""
        return self.run({"messages": messages, **names})

    def render(self, messages: Iterable[dict], **names) -> tuple[str, list[tuple[int, int]]]:
        """The whole text, and the spans of code points under the loss mask."""
        out, masked, at = [], [], 0
        for text, mask in self.stream(messages, **names):
            if mask and text:
                if masked and masked[-1][1] == at:
                    masked[-1] = (masked[-1][0], at + len(text))
                else:
                    masked.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), masked


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    return [(unescape_role(r), unescape(t)) for r, t in re.findall(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE) + "\n", text, flags=re.S)]


def digest(pieces: Iterable[tuple[str, bool]]) -> tuple[int, str, int, str, int]:
    """n_turns, turns digest, loss characters, loss digest, formatted characters: read back turn by turn from the output."""
    turns, turns_sha, loss, loss_sha, chars, buffer = 0, hashlib.sha256(), 0, hashlib.sha256(), 0, ""
    for text, mask in pieces:
        chars += len(text)
        buffer += text
        if mask:
            plain = unescape(text)
            loss += len(plain)
            loss_sha.update(plain.encode("utf-8", "surrogatepass"))
        if CLOSE in text:
            while (end := buffer.find(CLOSE + "\n")) >= 0:
                for role, said in read_back(buffer[: end + len(CLOSE) + 1]):
                    turns += 1
                    turns_sha.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                buffer = buffer[end + len(CLOSE) + 1 :]
    return turns, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars


def in_order(conversations: DataFrame) -> DataFrame:
    """Rows dealt by conversation and sorted by turn, nulls last."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_last("turn"), "role", "text")


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, its messages) of sorted rows; messages come lazily and have to be used up before the next."""
    import itertools

    rows = ((c, {"role": r, "text": t}) for b in batches for k in range(0, b.num_rows, 256) for c, r, t in zip(*(b.column(i).slice(k, 256).to_pylist() for i in (0, 2, 3))))
    for key, group in itertools.groupby(rows, key=lambda x: x[0]):
        yield key, (m for _, m in group)


def format_conversations(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """conv_id, formatted, loss_starts, loss_ends: the training text of each conversation and the spans under the mask."""

    def rows(batches):
        compiled = Template(template)
        for key, messages in conversations_of(batches):
            text, masked = compiled.render(messages)
            yield pa.RecordBatch.from_pydict({"conv_id": [key], "formatted": [text], "loss_starts": [[a for a, _ in masked]], "loss_ends": [[b for _, b in masked]]}, schema=pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))]))

    return in_order(conversations).mapInArrow(rows, "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>")


def digest_conversations(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """conv_id and the digests read back from the formatted text, which streams and is never held whole."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows(batches):
        compiled, kept = Template(template), []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), types)], names)
        for key, messages in conversations_of(batches):
            kept.append((key, *digest(compiled.stream(messages))))
            if len(kept) == 1000:
                yield flush()
                kept.clear()
        if kept:
            yield flush()

    return in_order(conversations).mapInArrow(rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
