"""The training-data operators: corner cases, brute force, exact round trips, held-out accuracy."""

import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, decontaminate, html, jaccard, katz, language, quality, queries as Q, substrings, vectors
from quillspark.llm.common import table

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(30_000))
#: Nulls, empties, ties, repeated rows, a very long text, and columns whose names the operators use themselves.
ROWS = [(1, "alpha beta gamma delta epsilon zeta", "en"), (1, "alpha beta gamma delta epsilon zeta", "en"), (2, "Alpha beta gamma delta epsilon zeta", "en"), (3, None, None), (4, "", "de"), (5, "?? 12 é", "de"), (None, "no id at all", "en"), (6, LONG, "en"), (7, LONG + " end", None), (8, " \n\t ", "de")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("x") for c in ("node", "size", "kind", "block", "words", "score", "component", "n_chars", "bits")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


LABELS = "doc_id long, quality int, toxic int"


def test_quality_cases(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, None, 0), (4, 0, 0), (5, 0, 1), (6, 1, 0)], LABELS)
    got = quality.score_documents(odd, labels).toPandas()
    assert len(got) == len(ROWS) and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    assert quality.score_documents(none, labels).count() == 0
    assert set(quality.score_documents(odd, labels.where("false")).toPandas().score) == {0.5}


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = Q.op1_quality_classifier(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97


def test_isotonic():
    assert np.allclose(quality.pool_adjacent(np.ones(4), np.array([1.0, 3.0, 2.0, 4.0])), [1, 2.5, 2.5, 4])


def test_katz_cases(spark, odd, none):
    got = katz.score(odd, F.col("doc_id") == 2).toPandas()
    assert len(got) == len(ROWS) and np.isfinite(got.score).all() and (got[got.doc_id == 3].n_tokens == 1).all()
    assert katz.score(none, F.lit(False)).count() == 0
    untrained = katz.score(odd, F.lit(True)).toPandas()
    assert set(untrained.train_tokens) == {0} and np.allclose(untrained.score, untrained.n_tokens * np.log10(0.5))


def test_katz_normalised(spark):
    """Probabilities of all words after a context, the unseen class with them, sum to one."""
    vocabulary = list("abcdefgh")
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(vocabulary, p=np.arange(8, 0, -1) / 36, size=9)) for _ in range(40)]
    asks = [f"a {w}" for w in [*vocabulary, "unseen"]] + ["a"]
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)] + [(1000 + i, t, True) for i, t in enumerate(asks)], "doc_id long, text string, h boolean")
    got = {r.doc_id: r.score for r in katz.score(df, F.col("h"), order=2).collect()}
    one = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)] + [(1, "a", True)], "doc_id long, text string, h boolean")
    # P(a | start) and P(end | w) are divided out with the texts "w" scored alone
    end = {w: katz_end(texts, w) for w in [*vocabulary, "unseen"]}
    first = got[1000 + len(asks) - 1] - np.log10(katz_end(texts, "a"))
    total = sum(10 ** (got[1000 + i] - first) / end[w] for i, w in enumerate([*vocabulary, "unseen"])) + katz_end(texts, "a")
    assert one.count() and abs(total - 1) < 1e-9


def katz_end(texts: list[str], word: str) -> float:
    """P(end | word), from scratch."""
    from collections import Counter

    uni, bi = Counter(), Counter()
    for t in texts:
        w = ["<s>", *t.split(), "</s>"]
        uni.update(w[1:])
        bi.update(zip(w, w[1:]))
    n = lambda c: np.array([sum(v == r for v in c.values()) for r in range(katz.K + 2)])
    low, d = katz.Lowest(n(uni), sum(uni.values()), len(uni)), katz.discounts(n(bi))
    p = lambda w: float(low.p(np.array([uni.get(w, 0)]))[0])
    seen = {b: c for (a, b), c in bi.items() if a == word}
    total = sum(seen.values())
    if not total:
        return p("</s>")
    given = sum(d[min(c, katz.K + 1)] * c for c in seen.values())
    wide = total if given < total - 1e-9 else total + 1
    if c := seen.get("</s>"):
        return d[min(c, katz.K + 1)] * c / wide
    return (1 - given / wide) / (1 - sum(map(p, seen))) * p("</s>")


def plain_katz(texts: list[str], order: int):
    """P(word | context) of a plain recursive Katz model in dictionaries, and its words."""
    from collections import Counter

    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        w = ["<s>"] * (order - 1) + t.split() + ["</s>"]
        for i in range(order - 1, len(w)):
            for n in range(1, order + 1):
                grams[n][tuple(w[i - n + 1 : i + 1])] += 1

    def discount(n: int) -> dict[int, float]:
        times = Counter(grams[n].values())
        common, out = 6 * times[6] / times[1] if times[1] else 1.0, {}
        for r in range(1, 6):
            if times[r] and common < 1:
                d = ((r + 1) * times[r + 1] / (times[r] * r) - common) / (1 - common)
                if 0 < d <= 1:
                    out[r] = d
        return out

    d = [None, *(discount(n) for n in range(1, order + 1))]
    total = sum(grams[1].values())

    def p(context: tuple, word: str) -> float:
        n = len(context) + 1
        if n == 1:
            kept = sum(d[1].get(c, 1) * c for c in grams[1].values())
            scale = 1 if kept < total else total / (total + 1)
            c = grams[1][(word,)]
            return d[1].get(c, 1) * c / total * scale if c else 1 - kept / total * scale
        after = {g[-1]: c for g, c in grams[n].items() if g[:-1] == context}
        if not after:
            return p(context[1:], word)
        kept, size = sum(d[n].get(c, 1) * c for c in after.values()), sum(after.values())
        whole = size if any(c in d[n] and d[n][c] < 1 for c in after.values()) else size + 1
        if word in after:
            return d[n].get(after[word], 1) * after[word] / whole
        return (1 - kept / whole) / (1 - sum(p(context[1:], x) for x in after)) * p(context[1:], word)

    return p, [g[0] for g in grams[1]]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_is_a_plain_model(spark, order, monkeypatch):
    """Scores of every order are those of dictionaries, whose probabilities sum to one; several blocks, repeated and held-out rows."""
    rng = np.random.default_rng(order)
    weight = 1 / np.arange(1, 31)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(30)], p=weight / weight.sum(), size=int(rng.integers(0, 14)))) for _ in range(120)]
    asked = texts[:20] + ["w0 new w1", "new new", "", "w29 w28 w27 w26 w25", "w0 w1 w2 w3 w0 w1"]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(1000 + i, t, True) for i, t in enumerate(asked)]
    got = {r.doc_id: r for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string, h boolean").repartition(5), F.col("h"), order=order).collect()}
    p, words = plain_katz(texts, order)
    for key, t, _ in rows:
        w = ["<s>"] * (order - 1) + t.split() + ["</s>"]
        want = sum(np.log10(p(tuple(w[i - order + 1 : i]), w[i])) for i in range(order - 1, len(w)))
        assert abs(got[key].score - want) < 1e-8, (key, t)
        assert got[key].n_known == sum(x in words for x in w[order - 1 :])
    for context in [("<s>",), ("w0",), ("w3", "w1"), ("w0", "w0", "w1")]:
        c = ("<s>",) * (order - 1 - len(context)) + context[max(0, len(context) - order + 1) :] if order > 1 else ()
        assert abs(sum(p(c, x) for x in [*words, "new"]) - 1) < 1e-9


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab'é ", min_size=200, max_size=900), st.sampled_from(["<|endoftext|>x", "a<|startoftext|>", "I'M İ Σ. ŉ \x1c \x85"])))
def test_bpe_is_the_library(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.vocabulary())
    ids = tok.encode(text, add_special_tokens=False).ids
    assert list(bpe.encoded([text], Q.vocabulary())) == [(" ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False))]


def test_bpe_tree_and_cases(odd, none):
    e = bpe.Encoder(Q.vocabulary())
    for s in ("a" * 3000, "theing" * 700, "日本" * 400, "!?" * 900 + "</w>"):
        assert e.long(s) == e.whole.encode(s, add_special_tokens=False).ids
    got = bpe.digest_documents(odd, Q.vocabulary()).toPandas()
    assert len(got) == len(ROWS) and (got[got.doc_id == 4].ids_sha256 == hashlib.sha256(b"").hexdigest()).all()
    assert bpe.digest_documents(none, Q.vocabulary()).count() == 0


def test_language_cases(odd, none):
    model = language.fit(odd)
    got = language.predict(odd, model).toPandas().set_index("doc_id")
    assert got.loc[3].lang_pred == "und" and got.loc[8].lang_pred == "und" and got.loc[6].lang_pred == "en"
    assert set(language.predict(odd, None).toPandas().lang_pred) == {"und"}
    assert language.identify(none).count() == 0
    assert len({tuple(w) for w in language.codewords(9)}) == 9


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = Q.op4_language_id(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_template_compiler():
    t = chat.Template("{# c #}{% set n = 1 + 2 %}{{ n }}{% for m in messages %}{% if loop.first %}[{% elif 1 == 2 %}never{% else %},{% endif %}{{ m.x | upper if not loop.last else 'end' }}{% endfor %}]")
    assert t.render([{"x": "a"}, {"x": "b"}])[0] == "3[A,end]"
    assert chat.fold(("bin", "+", ("const", 1), ("const", 2))) == ("const", 3)
    for bad in ("{% if x %}", "{{ a b }}", "{{ x | nope }}", "{% frob %}", "{{ ( }}", "{{ messages.__class__ }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    assert chat.Template("{{ messages['__class__'] }}").render([])[0] == ""


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\n\\n"]), st.text(alphabet="<|\\im_startend>\n ok", max_size=40)), max_size=6))
def test_chat_round_trip(turns):
    text, spans = chat.Template().render([{"role": r, "text": x} for r, x in turns])
    assert chat.read_back(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(x for r, x in turns if r == "assistant")


def test_chat_cases(spark):
    df = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, None, "x"), (None, 0, "user", "y"), (1, 1, "assistant", None), (2, None, "user", "z")], "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.digest_conversations(df).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, 2: 1, None: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"\nx\nassistant\n\nassistant\n\n").hexdigest()
    assert chat.digest_conversations(df.where("false")).count() == 0 and chat.format_conversations(df).count() == 3


def test_html_cases(spark):
    page = "<body><div id=menu><a href=1>Home</a></div><div class='content'><h2>A &amp; B</h2><p>Long text that goes on and on, enough to be a surge in the window.</p><p>Short.</p><p>Another long  paragraph<br>of text, with a bit more to say about it.</p></div><div class='comments'><p>I like this a lot, what a great article my friend</p></div><footer>c</footer>"
    assert html.extract(page) == "A & B\nLong text that goes on and on, enough to be a surge in the window.\nShort.\nAnother long paragraph of text, with a bit more to say about it."
    assert html.extract(None) == html.extract("") == html.extract("<nav>x</nav>") == ""
    assert html.extract("<article><header><h1>T</h1></header><p>x<script>var a='</p>';</script></p><aside>no</aside><form>no</form><p>" + "y" * 200_000) == "T\nx\n" + "y" * 200_000
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>hello world</p>")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert {r.page_id: r.n_chars for r in html.extract_pages(df).collect()} == {1: 0, None: 11}


def test_html_article_by_surge_and_dive():
    long, links = "Long text that goes on and on, enough to be a surge in the window, and then some more of it.", "".join(f"<li><a href={i}>Another story {i}</a></li>" for i in range(8))
    page = f"<article><h1>T</h1><p>1 May</p><p>{long}</p><table><tr><td>1<td>2<td>3<td>4<td>5<td>6<td>7</table><ul>{links}</ul><p>{long}</p><p><a href=x>Read on</a></p><p>The end.</p><ul>{links}</ul></article>"
    assert html.extract(page) == "\n".join(["T", "1 May", long, *"1234567", long, "Read on", "The end."])
    assert html.extract(f"<article><ul>{links}</ul></article>") == "\n".join(f"Another story {i}" for i in range(8))


def test_html_loose_boilerplate():
    a, b = "Long text that goes on and on, enough to be a surge in the window, and then some more of it.", "Another long text of this page that says what the first one has left out, and more than that."
    links, said = "".join(f"<li><a href={i}>Another story {i}</a></li>" for i in range(8)), "I like this a lot, what a great text, my friend, and how well it is put."
    both, side = f"<p>{a}</p><p>{b}</p>", "<div class='sidebar'><p>Some words that stand beside the text</p></div>"
    for page in (
        f"<div class='content-sidebar-wrap'>{both}</div>{side}",
        f"<div class='has-sidebar'><main>{both}</main></div>{side}",
        f"<article class='post category-legal tag-social'>{both}</article>{side}",
        f"<div class='widget'><article>{both}</article></div>{side}",
        f"<body><form>{both}</form>{side}",
        f"<article><p>A teaser of few words</p></article><div>{both}</div><article><p>Another teaser</p></article>",
        f"<div class=content>{both}</div><div class='comments-area'>{''.join(f'<article class=comment-body><p>{said}</p></article>' for _ in range(9))}</div>",
        f"<div class=content><p>{a}</p><ul>{links}</ul><p>{b}</p></div>",
        f"<div class=content><section><p>{a}</p></section><ul>{links}</ul><section><p>{b}</p></section></div><ul>{links}</ul><div>c</div>",
    ):
        assert html.extract(page) == f"{a}\n{b}"
    assert html.extract(f"<article><header class='entry-header'><h1>T</h1></header>{both}</article>") == f"T\n{a}\n{b}"
    assert html.extract(f"<div class='site-footer'>{said}</div><div class='cookie-banner'>{said * 9}</div>{both}") == f"{a}\n{b}"
    assert html.extract(f"<div class=ad>{said}</div><article><p>Few words</p></article>") == "Few words"
    assert html.extract(f"<div class=comments><p>{said}</p></div>") == said
    assert html.extract("<div>" * 20_000 + both) == f"{a}\n{b}"


def test_decontaminate_cases(spark, odd, none):
    bench = spark.createDataFrame([(1, "alpha BETA gamma"), (2, "epsilon zeta"), (3, None), (4, "??"), (5, " ".join(f"word{i}" for i in range(50, 70)))], "item_id long, text string").withColumn("h", F.lit(0))
    got = decontaminate.report(odd, bench).toPandas()
    by = {k: g.iloc[0] for k, g in got.groupby("doc_id", dropna=False)}
    assert len(got) == len(ROWS) and by[1].n_items == 2 and by[1].n_hit == 5 and by[1].contaminated and by[6].n_hit == 20 and not by[6].contaminated
    assert sorted(r.doc_id or 0 for r in decontaminate.decontaminate(odd, bench).collect()) == [0, 3, 4, 5, 6, 7, 8]
    assert decontaminate.report(none, bench).count() == 0 and decontaminate.report(odd, bench.where("false")).where("n_hit > 0").count() == 0


def test_decontaminate_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = Q.op7_decontaminate(spark, DATA).toPandas()
    cols = sorted(got.columns)
    key = lambda df: sorted(map(str, df[cols].values.tolist()))
    assert key(got) == key(con.execute(Q.oracle_sql()["op7_decontaminate"]).df())


def brute_dedup(rows, shortest=substrings.SHORTEST):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = text.encode()
        ends, _ = substrings.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        again, parts, last = [], [], 0
        for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            if raw[a:b] in seen:
                again.append(k)
            seen.add(raw[a:b])
        for a, b in substrings.repeated_spans(ends, np.array(again, dtype=int), shortest):
            parts.append(raw[last:a])
            last = b
        out[doc] = (b"".join(parts) + raw[last:]).decode()
    return out


def test_substrings_brute_force(spark, odd, none):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefé"), size=6))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(50)) + (" " + passage + " " if i % 3 == 0 else " ") + " ".join(word() for _ in range(50))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in substrings.deduplicate(df).collect()}
    assert {k: r.text for k, r in got.items()} == brute_dedup(rows)
    assert [k for k, r in sorted(got.items()) if r.n_spans] == list(range(3, 30, 3))
    cases = substrings.deduplicate(odd).toPandas()
    assert len(cases) == len(ROWS) and cases[cases.doc_id == 3].text.isna().all() and list(cases.columns)[: len(odd.columns)] == odd.columns
    assert not (cases[cases.doc_id == 1].n_spans > 0).any() and (cases[cases.doc_id == 7].n_spans > 0).all()
    assert substrings.deduplicate(none).count() == 0


def test_substrings_rows_that_stand_often(spark):
    text, other = (" ".join(f"{w}{i}" for i in range(80)) for w in ("word", "term"))
    df = spark.createDataFrame([(1, text)] * 5 + [(2, text)] * 3 + [(None, other)] * 4, "doc_id long, text string")
    for parts in (1, 3):
        got = sorted((r.doc_id or 0, r.n_spans, r.text) for r in substrings.deduplicate(df.repartition(parts)).collect())
        assert got == [(0, 0, other)] * 4 + [(1, 0, text)] * 5 + [(2, 1, "")] * 3


def test_substrings_short_passages_are_found():
    rng = np.random.default_rng(9)
    some = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), size=5)) for _ in range(n))
    missed = 0
    for _ in range(400):
        passage = some(46)  # 275 bytes
        missed += brute_dedup([(1, f"{some(9)} {passage} {some(9)}"), (2, other := f"{some(9)} {passage} {some(9)}")])[2] == other
    assert missed < 400 * 0.03


def brute_clusters(rows):
    def shingles(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()

    sets = [(d, shingles(t)) for d, t in rows]
    best = {d: d for d, _ in rows}
    while True:
        old = dict(best)
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    best[a] = best[b] = min(best[a], best[b])
        if old == best:
            return {d: (len(s), best[d]) for d, s in sets}


def test_jaccard_brute_force(spark, odd, none):
    rng = np.random.default_rng(6)
    base = [[f"w{rng.integers(60)}" for _ in range(rng.integers(3, 90))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = list(base[i % 12])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = f"x{rng.integers(5)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_clusters(rows)
    cases = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.cluster(odd).collect()}
    assert cases[2] == (2, 1) and cases[3] == (0, 3) and cases[4] == (0, 4) and cases[7][1] == 6 and cases[8] == (0, 8)
    assert jaccard.cluster(none).count() == 0


def test_bpe_ids_workers_keep_ids_alone(spark, odd, tmp_path):
    """encode_ids gives the library's ids; its workers keep no names of tokens, which only the decoded text needs."""
    import shutil

    from tokenizers import Tokenizer

    path = shutil.copy(Q.vocabulary(), tmp_path / "own.json")  # a path that no other test has
    got = bpe.encode_ids(odd.repartition(8), str(path)).collect()
    whole = Tokenizer.from_file(str(path))
    want = [(i, whole.encode(t or "", add_special_tokens=False).ids) for i, t, _ in ROWS]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), ids) for i, ids in want) and all(r.n_tokens == len(r.ids) for r in got)

    def held(batches):
        import sys

        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([k for k in vars(sys.modules.get("_quillspark_worker", object))], pa.string())], ["k"])

    keys = {r.k for r in spark.range(64).repartition(8).mapInArrow(held, "k string").collect()}
    assert not {k for k in keys if "own.json" in k and "names" in k} and f"bpe-ids-{path}" in keys


def test_jaccard_places():
    """Postings without a partner that sizes and places let link go; for every two sets that link the first shingle they share stays."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 60)).astype(np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate((s[: len(s) - 2], rng.integers(0, 60, 3).astype(np.uint64)))) for s in sets]
    none = np.zeros(0, np.uint64)
    rows = np.concatenate([np.array([(h, i, len(s), k) for k, h in enumerate(jaccard.prefix(s, none, none, 80))], dtype=jaccard.POSTING) for i, s in enumerate(sets)])
    rows = rows[np.lexsort((rows["node"], rows["size"], rows["h"]))]
    assert (jaccard.unpacked(jaccard.packed(rows), jaccard.POSTING) == rows).all()
    old, jaccard.NEAR = jaccard.NEAR, 200
    try:
        kept = {(int(r["h"]), int(r["node"])) for r in rows[jaccard.paired(rows, 80)]}
        jaccard.NEAR = 1
        assert kept <= {(int(r["h"]), int(r["node"])) for r in rows[jaccard.paired(rows, 80)]}
    finally:
        jaccard.NEAR = old
    want, linked = set(), 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = np.intersect1d(x, y)
            link = len(both) >= jaccard.needed(len(x), len(y), 80)
            linked += link
            assert not link or {(int(both[0]), i), (int(both[0]), j)} <= kept
            for h in set(x[: len(jaccard.prefix(x, none, none, 80))].tolist()) & set(y[: len(jaccard.prefix(y, none, none, 80))].tolist()):
                if min(len(x) - (x < h).sum(), len(y) - (y < h).sum()) >= jaccard.needed(len(x), len(y), 80):
                    want |= {(h, i), (h, j)}
    assert linked and kept == want and len(kept) < len(rows)


def test_jaccard_representatives_without_ids(spark, odd, none):
    w = [f"w{i}" for i in range(40)]
    a, near, b = " ".join(w), " ".join(w[:-1] + ["x"]), " ".join(f"v{i}" for i in range(40))
    rows = [(1, a), (2, near), (None, a), (None, near), (None, b), (None, b), (None, "one of its own"), (None, ""), (None, " "), (None, None), (None, None), (3, ""), (4, None)]
    got = [tuple(r) for r in jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [rows[0], rows[4], *rows[6:]]))
    cases = jaccard.representatives(odd)
    assert cases.columns == odd.columns and sorted(map(str, (r.doc_id for r in cases.collect()))) == sorted(map(str, (1, 1, 3, 4, 5, None, 6, 8)))
    assert jaccard.representatives(none).count() == 0


def test_vectors_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(20, 16))
    x = [base[i % 20] + rng.normal(size=16) * rng.choice([0, 0.1, 0.25]) for i in range(200)]
    rows = [(i, [float(v) for v in np.float32(x[i])], int(i % 2)) for i in range(200)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, rows[0][1], None), (204, [1.0, None], 1), (205, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("block", F.lit(1)).repartition(4)
    v = np.array([r[1] for r in rows[:200]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.93) & (np.arange(200)[:, None] % 2 == np.arange(200) % 2)
    np.fill_diagonal(near, False)
    best = np.arange(200)
    for _ in range(200):
        best = np.minimum(best, np.where(near, best[None, :], 10**9).min(1))
    old, vectors.BLOCK = vectors.BLOCK, 16
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    finally:
        vectors.BLOCK = old
    assert near.sum() and got == {i: (int(near[i].sum()), int(best[i])) for i in range(200)} | {i: (0, i) for i in range(200, 206)}
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_vectors_odd_ids_and_many_dimensions(spark):
    """Repeated and null vec_ids; 2500 dimensions, of which a float32 product alone would not be exact."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=2500), rng.normal(size=2500)
    near = a + rng.normal(size=2500) * 0.3946  # cosine about 0.93
    v = [a, near, a * 3, b, a + rng.normal(size=2500) * 0.05]
    rows = [(5, v[0], 1), (2, v[1], 1), (None, v[2], 1), (None, v[3], 1), (5, v[0], 1), (9, v[4], 1), (9, v[3], 2)]
    df = spark.createDataFrame([(i, [float(f) for f in x], l) for i, x, l in rows], "vec_id long, embedding array<double>, label int")
    u = np.array([x / np.linalg.norm(x) for _, x, _ in rows])
    link = (u @ u.T >= 0.93) & (np.array([l for *_, l in rows])[:, None] == np.array([l for *_, l in rows]))
    np.fill_diagonal(link, False)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in vectors.near_duplicates(df).collect())
    low = 2 if link[0, 1] or link[4, 1] or link[5, 1] else 5
    assert [x[:2] for x in got if x[0] != "9"] == sorted((str(i), int(n)) for (i, *_), n in zip(rows, link.sum(1)) if i != 9)
    assert {x[2] for x in got if x[0] == "5"} == {str(low)} and ("None", 0, "None", True) in got


def plain_words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items):
    """Items of which a window of 8 words (all words, where fewer) stands in the text, by comparing word lists."""
    words = plain_words(text)
    at = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    out = set()
    for item, theirs in items:
        size = min(8, len(theirs))
        for k in range(len(theirs) - size + 1 if size else 0):
            if any(words[i : i + size] == theirs[k : k + size] for i in at.get(theirs[k], [])):
                out.add(item)
                break
    return out


@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_pipeline_decontaminates(spark, data):
    """The stage drops every document with a passage of the benchmark and no other."""
    import corpus_pipeline as P

    docs = table(spark, data, "documents")
    items = [(r.item_id, plain_words(r.text)) for r in table(spark, data, "benchmark").collect()]
    want = sorted(r.doc_id for r in docs.collect() if not plain_hits(r.text, items))
    assert sorted(r.doc_id for r in P.keep_uncontaminated(spark, docs, data).collect()) == want and len(want) < docs.count()


def test_pipeline_stage_cases(spark, odd, none):
    """Nulls, repeated rows, no rows, columns of names that stages use themselves: rows pass or go, columns stay."""
    import corpus_pipeline as P

    clash = odd.withColumns({c: F.lit("x") for c in ("text_key", "h", "size", "n_spans", "removed_chars", "repeats", "__id", "at", "leader", "tile", "main")})
    for stage in (P.keep_one_of_each_group, P.take_out_repeats, P.keep_uncontaminated):
        for docs in (clash, none, spark.createDataFrame([], "doc_id long, text string")):
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns and out.count() <= docs.count() and (out.count() > 0) == (docs is clash)
    kept = P.keep_quality(spark, clash, DATA)
    assert kept.columns == clash.columns and P.keep_quality(spark, none, DATA).count() == 0
    ids = {r.doc_id: r.n_tokens for r in P.encode(spark, clash, DATA).collect()}
    assert ids[3] == 0 and ids[4] == 0 and ids[1] > 0 and P.encode(spark, none, DATA).count() == 0


def test_pipeline_brute_force(spark):
    """After the classifier, whose scores are its own test, every stage against a plain version."""
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    docs = table(spark, DATA, "documents")
    first = P.keep_quality(spark, docs, DATA).toPandas()
    scored = Q.op1_quality_classifier(spark, DATA).toPandas()
    assert set(first.doc_id) == set(scored[scored.predicted == 1].doc_id)
    clusters = brute_clusters(list(zip(first.doc_id, first.text)))
    kept = [(d, t) for d, t in zip(first.doc_id, first.text) if clusters[d][1] == d]
    texts = brute_dedup(kept)
    items = [(r.item_id, plain_words(r.text)) for r in table(spark, DATA, "benchmark").collect()]
    tok = Tokenizer.from_file(Q.vocabulary())
    tok.no_truncation()
    tok.no_padding()
    want = {int(d): tok.encode(t, add_special_tokens=False).ids for d, t in texts.items() if not plain_hits(t, items)}
    assert {r.doc_id: list(r.ids) for r in P.run(spark, DATA).collect()} == want


def test_html_hostile_markup():
    """A megabyte of broken markup is read in time linear in its length; what is no tag stays text."""
    import time

    for page in ("<p " * 350_000, '<a "' * 250_000, '<a ">"' * 160_000, "</div>" * 160_000, "<div>" * 90_000 + "</b>" * 90_000, "<b>" + "<div>" * 90_000 + "</b>" * 90_000, "<script>" + "</script" * 120_000, "<![CDATA[" * 100_000, "<!--" * 200_000, "<" * 1_000_000, "<a " + "x='" * 300_000 + ">"):
        began = time.time()
        html.extract(page)
        assert time.time() - began < 30
    assert html.extract("<p>a < b and c</p><p title='x > y'>more <b</p>") == "a < b and c\nmore"


def test_workers_need_no_package(tmp_path):
    """All queries run where only the driver can import the package."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path += [{repo!r}, *{[p for p in sys.path if "tokenizers" in p]!r}]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
from quillspark.llm import queries
for name, query in queries.queries().items():
    if name != "pipeline":
        print(name, len(query(spark, {DATA!r}).collect()))
import corpus_pipeline
from quillspark.llm.common import table
print("stage", corpus_pipeline.keep_quality(spark, table(spark, {DATA!r}, "documents"), {DATA!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and done.stdout.count("op") >= 10, done.stderr[-2000:]
