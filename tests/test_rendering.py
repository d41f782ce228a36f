"""Rendering of blocks, titles, threads and navigation, model stages and streams, on small inputs."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.functions import rendering as R
from quillspark.operators import catalog as C, models as M, store as S
from quillspark.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_blocks(spark):
    blocks = [
        ("heading", " Title ", None, 9, None, None),
        ("heading", "# own", None, 1, None, None),
        ("code_block", "x = 1\n\n", "py", None, None, [("2", " said "), ("x", None), ("3", None)]),
        ("text", "", None, None, "y", None),
        ("math", "so", None, None, "a+b", []),
        (None, "  ", None, None, None, None),
    ]
    df = spark.createDataFrame([(blocks,)], f"b {R.BLOCKS}")
    got = [r[0] for r in df.select(F.explode("b").alias("x")).select(R.block_markdown(F.col("x"))).collect()]
    assert got == ["## Title", "# own", '```py\nx = 1\n``` [Reference 2: "said"] [Reference: 3]', "```\ny\n```", "so\n$$\na+b\n$$", ""]
    assert df.select(R.answer_markdown(F.col("b"))).first()[0] == "\n\n".join(got)  # the last block says nothing: what stands before it keeps its blank line
    assert df.select(R.answer_markdown(F.col("b"), unreadable=False)).first()[0] == "\n\n".join([*got[:3], "so"]) + "\n\n"


def test_transcripts(spark):
    raw = json.dumps([{"start time": 1, "end_time": 2.5, "speaker": "a", "text content": "x"}, {"start_time": 3, "speaker": "b"}, {"start_time": 1, "start time": 9, "end time": 2, "speaker": "c", "text_content": ""}])
    assert [tuple(s) for s in one(spark, R.transcript_segments(F.lit(raw)))] == [(1.0, 2.5, "a", "x"), (1.0, 2.0, "c", "")]
    for broken in ("", "{", '{"a": 1}', "7", None):
        assert one(spark, R.transcript_segments(F.lit(broken).cast("string"))) == []


def test_titles(spark):
    own = lambda text, name: one(spark, R.without_own_title(F.lit(text), F.lit(name)))
    assert own("# My File\n\n \n## a\n### b\nx # y\n  ## c", "my-file") == "# a\n## b\nx # y\n  # c"
    assert own("# My File\n## a\n## b", "my_file") == "## a\n## b" and own("# Other\nx", "my_file") == "# Other\nx"
    assert own("# my file", "my_file") == "" and own("", "a") == "" and own("#my file\nx", "my_file") == "#my file\nx"
    assert R.releveled("# A\ntext\n## B\n# C\n# A", [("a", 1), ("B ", 3), ("", 2)]) == "# A\ntext\n## B\n# C\n# A"
    assert R.releveled("### A", []) == "### A"
    empty = F.expr("CAST(array() AS array<struct<start_paragraph_index:int,section_title:string>>)")
    paragraphs = F.array(F.struct(F.lit(5).alias("paragraph_index"), F.lit("far").alias("title")), F.struct(F.lit(1).alias("paragraph_index"), F.lit("near").alias("title")))
    assert one(spark, R.titled_paragraphs(F.lit("p1\n\n\n\np2"), paragraphs, empty)) == "# near\n\np1\n\n# far\n\n"
    assert one(spark, R.notebook_markdown(F.lit("t\n\n## Lecture\n# A\n#### B"))) == "\n# Lecture\n## A\n### B"


def comment(text, role="student", votes=0, below=()):
    return {"user": {"name": "n", "role": role}, "url": "u", "text": text, "votes": votes, "comments": list(below)}


def test_threads():
    admin, plain = comment("Yes", "admin"), comment("thanks")
    texts = lambda cs: [c["text"] for c in R.comments_kept(cs)]
    assert texts([plain, admin, comment("fine", votes=1)]) == ["Yes", "fine"]
    assert texts([comment("submit the extension", votes=1), comment("due, when", votes=1), comment("the release", votes=1)]) == []
    # a question stays once for each reply to the point; beside an admin's reply unpopular ones are not
    assert texts([comment("why", votes=1, below=[admin, plain, comment("mine", votes=2)])]) == ["why", "why"]
    assert texts([comment("why", votes=1)]) == [] and texts([comment("why", below=[plain, plain])]) == ["why", "why"]
    assert R.comments_kept([comment("ok", votes=1, below=[plain, admin])])[0]["comments"] == [admin]
    assert texts([comment("i me " + " my  mine  me ", below=[admin])]) == []
    post = comment("body") | {"title": "T", "answers": [comment("a")], "comments": [comment("c", below=[comment("d", below=[comment("e")]), comment("f")])]}
    who = "**User:** n\n**Role:** student\n**URL:** u\n"
    assert R.thread_markdown(json.dumps([post])) == f"# T\n{who} body\n### Comment\n{who}c\n{who}d\n{who}e\n\n{who}f\n### Answer \n{who.replace('User', 'Name')}a\n"
    deep = comment("bottom")
    for _ in range(300):
        deep = comment("x", below=[deep])
    assert "bottom" in R.thread_markdown(json.dumps([comment("p") | {"title": "T", "comments": [deep]}]))


def test_navigation():
    assert R.toctree(".. toctree::\n   :maxdepth: 1\n\n   a\n   B <c>\n\nx\n.. toctree::\n\n  d") == ["a", "c", "d"]
    assert R.toctree("none") == [] and R.toctree(".. toctree::") == []
    assert R.site_navigation("a: 1\nnav:\n- x\n  # y\n\nz: 2\ndocs_dir: late") == "nav:\n- x\n  # y\n" and R.site_navigation("") == ""


def test_model_stages(spark):
    rows = spark.createDataFrame([(k, "/a/" if k % 2 else "/b/", f"t{k}") for k in range(45)], "k long, path string, text string")

    def model(asked):
        assert len(asked) <= 10
        if ("t44",) in asked:
            raise RuntimeError("no answer")
        return [t.upper() for (t,) in asked]

    got = {r.k: r for r in M.predicted(rows.coalesce(1), model, ["text"]).collect()}
    assert got[3].prediction == "T3" and got[3].prediction_error is None and (got[44].prediction, got[44].prediction_error) == (None, "no answer") and got[40].prediction is None
    kinds = {r.k: r.category for r in M.classified(rows.where("k < 9"), "path", {"A": ["/a/"]}, model, ["text"]).collect()}
    assert kinds == {k: "A" if k % 2 else f"T{k}" for k in range(9)}
    chunks = spark.createDataFrame([(1, 2, "cd"), (1, 1, "ab"), (2, 1, "x" * 30), (3, 1, "y" * 30), (3, 2, "z" * 30), (4, 1, None)], "f long, n int, text string")
    assert dict(map(tuple, M.summarised(chunks, "f", "n", "text", lambda t: f"{t[0]}{len(t)}", short=10, most=40).collect())) == {1: "ab\ncd", 2: "x30", 3: "y7", 4: ""}
    files = spark.createDataFrame([("a.MD", "m"), ("b.txt", "t"), ("c", "n")], "path string, content string")
    assert [r.markdown for r in M.converted(files, "path", "content", {"md": lambda c: c, "txt": lambda c: F.concat(F.lit("# "), c)}).orderBy("path").collect()] == ["m", "# t", None]


def test_cleanup_report(spark):
    parents, children = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, c string"), spark.createDataFrame([(1,), (1,), (2,), (None,)], "fk long")
    report = lambda c, dry: sorted(map(tuple, S.cleanup_report(parents, {"chunks": (children, "fk")}, F.col("c") == c, "k", dry).collect()))
    assert report("a", True) == [("chunks", 4, 2, True, True), ("parents", 3, 1, True, True)]
    assert report("none", False) == [("chunks", 4, 0, False, False), ("parents", 3, 0, False, False)]


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_streams_to_tables(spark, tmp_path, mode):
    rows = spark.createDataFrame([(1, 0, "One. Tw"), (1, 1, "o. Th"), (1, 2, "ree."), (2, 0, "none"), (3, 0, ". x. y")], "request_id long, seq long, token string")
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t"))
    if mode == "append":
        got = jobs.run_to_table(jobs.speech_segments(stream), f"speech-{uuid.uuid4().hex}", mode)
        said = {}
        for r in got.orderBy("request_id", "out_seq").collect():
            said[r.request_id] = said.get(r.request_id, "") + r.segment
        assert said == {1: "One. Two. ", 3: ". x. "}
    else:
        got = jobs.run_to_table(stream.groupBy("request_id").count(), f"counts-{uuid.uuid4().hex}", mode)
        assert dict(map(tuple, got.collect())) == {1: 3, 2: 1, 3: 1}


def test_html_markdown():
    assert R.html_markdown("<h2>A</h2><pre>x  = 1\n y</pre><p>t<br>u &amp; v</p><ol><li>a<ul><li>b</ul><li>c</ol>") == "## A\n\n```\nx  = 1\n y\n```\n\nt\nu & v\n\n1. a\n  * b\n2. c"
    assert R.html_markdown("<div class=x><p>in</p></div><p>out</p>", [("div", "x")]) == "in" and R.html_markdown("") == "" and R.html_markdown("a < b <p") == "a < b <p"
    assert R.html_markdown("</p></div><b>x</b><img src=y alt=z><style>q</style>") == "**x**![z](y)"


def test_index_cache(spark):
    cache, built = C.IndexCache(), []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert cache.get("a", 1, build).count() == 1 and cache.get("a", 1, build).count() == 1 and len(built) == 1
    assert cache.get("a", 2, build).count() == 2 and cache.get("b", 2, build).count() == 3
    cache.clear()
