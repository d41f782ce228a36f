"""Readers of landed files, sinks, parsers, rules and task pipelines on small inputs."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import parsing as P, rules as R
from quillspark.operators import catalog as C, tasks
from quillspark.sources import landed, sinks


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "v": 2}\n\n   \n{"id": "2", "v\n{"v": 3}\n[1]\n')
    got = landed.jsonl(spark, str(tmp_path), "id string, v int").collect()
    assert sorted((r.file, r.id or "", r.v) for r in got if r.v) == [("a.jsonl", "", 3), ("a.jsonl", "1", 2)]
    with pytest.raises(Exception):
        landed.jsonl(spark, str(tmp_path), "id string, v int", strict=True).collect()
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), (None, 9, "n")], "id string, pos long, said string")
    assert [tuple(r) for r in C.last_of(rows, "id", "pos").collect()] == [("a", "z")]


def test_folders(spark, tmp_path):
    for name in ("x.md", "sub/y.PY", "sub/deep/z.md", ".hidden/h.md", "build/b.md", "sub/skip_1.md", "c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("12345")
    got = landed.folder(spark, str(tmp_path), [".md", ".py"], ["build/", "skip_?.md"]).collect()
    assert sorted(r.path for r in got) == ["sub/deep/z.md", "sub/y.PY", "x.md"] and got[0].kb == 5 / 1024
    (tmp_path / "a.yml").write_text("- {id: 1, name: x}\n- {id: 2}\n")
    (tmp_path / "b.yaml").write_text("id: 3\nname: z\nmore: 1\n")
    got = landed.yaml_folder(spark, str(tmp_path), "id long, name string").collect()
    assert sorted((r.id, r.name) for r in got) == [(1, "x"), (2, None), (3, "z")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(k, f"n{k}") for k in range(50)], "k long, name string").repartition(7)
    assert sorted((r.k, r.n) for r in sinks.numbered(df, "k").collect()) == [(k, k + 1) for k in range(50)]
    for form, read in (("json", spark.read.json), ("csv", lambda p: spark.read.option("header", True).csv(p)), ("parquet", spark.read.parquet)):
        for _ in range(2):  # the second replaces the first
            sinks.write_report(df, str(tmp_path / form), form)
        assert read(str(tmp_path / form)).count() == 50
    sinks.compacted(df, str(tmp_path / "one"), 1)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    line = sinks.as_documents(spark.sql("SELECT 1 AS k, TIMESTAMP '2024-01-01 00:00:00' AS at, 1.50BD AS price"), "k").first().line
    assert json.loads(line) == {"_id": "1", "k": 1, "at": "2024-01-01 00:00:00", "price": "1.50"}


def test_numbering_reads_alike(spark, tmp_path):
    # ranges were sampled once for their sizes and once for their rows
    spark.range(0, 200_000, 1, 16).select((F.col("id") * 7919 % 200_000).alias("k"), F.repeat(F.lit("x"), 40).alias("name")).write.parquet(str(tmp_path / "t"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(key, "false")
        sinks.numbered(spark.read.parquet(str(tmp_path / "t")), "k").write.parquet(str(tmp_path / "n"))
    finally:
        spark.conf.unset(key)
    assert spark.read.parquet(str(tmp_path / "n")).agg(F.count(F.lit(1)), F.count(F.when(F.col("n") != F.col("k") + 1, 1))).first() == (200_000, 0)
    odd = spark.createDataFrame([("b",), (None,), ("a",), ("c",)], "k string")
    assert [r.k for r in sinks.numbered(odd, "k").orderBy("n").collect()] == [None, "a", "b", "c"] and sinks.numbered(odd.limit(0), "k").count() == 0


def test_marked_variants_of_long_blank_and_missing(spark, tmp_path):
    import duckdb

    from quillspark.plans import catalogue

    long = "word " * 8000  # longer than any cut
    spark.createDataFrame([(1, long, "en", "s"), (2, " \n", "en", "s"), (3, None, "en", "s"), (4, "x", None, "s"), (5, "x", "en", None)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sql = catalogue.oracle_sql()["marked_variants"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.doc_id: tuple(r) for r in catalogue.queries()["marked_variants"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: r for r in duckdb.sql(sql).fetchall()} and got[1][1] == long + "\n"
    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert get(R.extracted_variant(F.lit(" <!-- TAI_VLM_BEGIN --><!-- TAI_V2_BEGIN -->c<!-- TAI_V2_END --><!-- TAI_VLM_END -->"), 2)) == "c"  # by itself, a blank text is left out


def test_lenient_and_partial_json():
    for text, want in (('{"a": 1}', {"a": 1}), ('so: ```json\n{"a": {"b": 2}}\n``` end', {"a": {"b": 2}}), ('x {"a": "}"} y', {"a": "}"}), ('x {"a": {"b": 1}} {"c"', {"a": {"b": 1}}), ("none", None), ("{", None), (None, None)):
        assert P.lenient(text) == want
    whole = json.dumps({"inner": {"say": "no"}, "say": 'yes "é"\n\\ tab\t', "z": 1})
    assert P.partial_field(whole, "say") == 'yes "é"\n\\ tab\t'
    for k in range(len(whole) + 1):  # what comes is always a beginning of the value
        got = P.partial_field(whole[:k], "say")
        assert got is None or 'yes "é"\n\\ tab\t'.startswith(got)
    assert P.partial_field('{"say": 5', "say") == "" and P.partial_field('{"say":', "say") == "" and P.partial_field("say", "say") is None


def test_citations_and_bullets():
    assert P.cited('```json\n{"blocks": [{"citations": [{"id": 2}, {"id": "1"}, {"id": null}]}, 4]}\n```') == [1, 2]
    assert P.cited('[{"reference": {"number": 3}}, {"reference": null}]') == [3] and P.cited('{"mentioned_contexts": [{"reference": 5}]}') == [5]
    assert P.cited("broken [Reference: 4, 2]") == [2, 4]
    text = '{"title": "t", "bullets" : [{"point": "a } \\" {", "purpose": "b", "sub": {"x": 1}}, {"point": "c"}, {"point": "d", "purpose": "e"}]}'
    seen = [len(P.whole_bullets(text[:k])) for k in range(len(text) + 1)]
    assert seen == sorted(seen) and seen[-1] == 2 and json.loads(P.whole_bullets(text)[0])["sub"] == {"x": 1}


def test_chunks_by_lines_and_fences():
    text = "\n".join("x" * n for n in (10, 5, 30, 3, 3, 3))
    assert P.line_chunks(text, 16) == ["x" * 10 + "\n" + "x" * 5, "x" * 30, "xxx\nxxx\nxxx"] and P.line_chunks("") == []
    md = "a\n```py\ndef f():\n    pass\n```\nb\n```\nend"
    assert P.fence_spans(md) == [[1, 4], [6, 7]]
    pieces = P.fence_pieces(md, 30)
    assert pieces == ["a\n```py\ndef f():\n    pass\n```", "b\n```\nend"] and "\n".join(P.fence_pieces(md, 5)) == md
    assert P.short_merged(["a b", "c d e f g", "h"], lambda x: len(x.split()), 3) == ["a b\n\nc d e f g", "h"]


def test_upload_fold():
    rows = pd.DataFrame([(1, 0, "a.md", 60.0), (1, 1, "b.exe", 1.0), (1, 2, "c.PDF", 60.0), (1, 3, "d.md", 30.0), (1, 4, "e.md", 200.0), (1, 5, "f.md", None), (1, 6, "g.md", 1.0)], columns=["batch", "pos", "name", "size"])
    got = P.folded(rows, total=100, single=100, most=6).fault.tolist()
    assert got == [None, "invalid_extension", "total_size_exceeded", None, "file_too_large", None, "batch_limit"]


def test_tasks():
    assert tasks.levels({"c": ["a", "b"], "a": [], "b": ["a"]}) == [["a"], ["b"], ["c"]]
    for bad in ({"a": ["x"]}, {"a": ["b"], "b": ["a"]}):
        with pytest.raises(ValueError):
            tasks.levels(bad)


def test_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert [get(R.ignored(F.lit(p), ["build/", "*.tmp", "docs/**/x.md", "a?c"])) for p in ("build/x", "x/build", "d/y.tmp", "docs/q/x.md", "q/abc", "q/abbc")] == [True, False, True, True, True, False]
    assert [get(R.valid_module(F.lit(p))) for p in ("practice/hw/one", "study/a/", "support/../x", "/study/a", "study/a/b", "other/a")] == [True, True, False, False, False, False]
    assert get(R.title_words(F.lit("**Part 2**: The `Options`!"))) == ["2", "the"]
    match = lambda a, b: get(R.titles_match(R.title_words(F.lit(a)), R.title_words(F.lit(b))))
    assert match("Intro to Graphs", "graphs") and match("big red old dog", "Old red big cat") and not match("one two three", "one four five")
    assert get(R.message_text(F.lit("<!--THINKING-BLOCK: x-->  a <!--REFERENCES: 1--> b <!--REFERENCES: 2-->"))) == "a <!--REFERENCES: 1--> b"
    assert get(R.blob_fault(F.lit(7))) == "ragged" and get(R.blob_fault(F.lit(0))) == "empty" and get(R.blob_fault(F.lit(4 * 20_000))) == "too wide" and get(R.blob_fault(F.lit(16))) is None
    assert get(R.tidy_lines(F.lit("a\n ## \n\n\n\n\nb  "))) == "a\n\nb\n" and get(R.vector_of(F.lit("[1, 2.5]"))) == [1.0, 2.5] and get(R.vector_of(F.lit("[1,"))) is None
    assert get(R.spoken_roles(F.lit("A: hi\n**B**: A: x"), F.create_map(F.lit("A"), F.lit("Tutor"), F.lit("B"), F.lit("Student")))) == "Tutor: hi\n**Student**: A: x"
    assert get(R.first_distinct(F.array(*map(F.lit, [" a", "A", "", "b", "c"])), 2)) == ["a", "b"]


def test_sentences_keep_their_ends(spark):
    from quillspark.functions import text as T

    got = spark.range(1).select(T.sentences(F.lit("0 is first. 1st comes? Yes 1. And 2 of 2")).alias("x")).first().x
    assert got == ["0 is first. 1st comes?", "Yes 1.", "And 2 of 2"]
