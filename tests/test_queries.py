"""Every registered query of the engine against its SQL, and the operators' corner cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunking, text as T, urls as U
from quillspark.operators import quality as Q, sequence as S, store, vectors as V
from quillspark.plans import catalogue
from quillspark.streaming import jobs

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(records):
    show = lambda v: None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(str([show(v) for v in r]) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    result = [tuple(r) for r in got.select(columns).collect()]
    if sql := catalogue.oracle_sql().get(name):
        want = db.execute(f"SELECT {', '.join(columns)} FROM ({sql})")
        assert rows(result) == rows(want.fetchall())
    else:
        assert result


def test_topk_ties_and_limits(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (8, [0.0, 0.0])], "query_id long, q array<double>")
    got = {(r.query_id, r.id): (r.score, r["rank"]) for r in V.topk(v, q, 2, "normalised").collect()}
    assert got == {(9, 1): (1.0, 1), (9, 2): (1.0, 2), (8, 1): (0.0, 1), (8, 2): (0.0, 2)}
    with pytest.raises(ValueError):
        V.topk(v, q, 0)


def test_rrf_missing_ranks(spark):
    a = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8)], "query_id long, id long, score double")
    b = spark.createDataFrame([(1, 11, 5.0)], "query_id long, id long, score double")
    got = {r.id: r.score for r in V.rrf(a, b).collect()}
    assert got == {10: round(1 / 61 + 1 / 62, 6), 11: round(1 / 62 + 1 / 61, 6)}


def test_upsert_takes_nulls_and_keeps(spark):
    t = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k long, x string, c string")
    s = spark.createDataFrame([(2, None, "new"), (3, "z", "new")], "k long, x string, c string")
    assert sorted(map(tuple, store.upsert(t, s, ["k"], keep=("c",)).collect())) == [(1, "a", "old"), (2, None, "old"), (3, "z", "new")]


def test_null_safe_mismatch_and_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    assert Q.mismatched(df, F.col("b"), F.lit("x")).count() == 1
    assert {r["col"]: r.nulls for r in Q.null_profile(df).collect()} == {"a": 0, "b": 1}
    assert Q.null_profile(df.where("false")).where("null_percent IS NOT NULL").count() == 0


def test_overlap_unknown_and_first_of_equals(spark):
    seg = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 50.0, 60.0)], "rec long, seg_id long, start double, end double")
    turn = spark.createDataFrame([(1, "B", 5.0, 9.0), (1, "A", 1.0, 5.0)], "rec long, speaker string, start double, end double")
    assert {r.seg_id: r.speaker for r in S.overlap_best(seg, turn, "rec", 7.0).collect()} == {1: "A", 2: "UNKNOWN"}


def test_levels_and_chunks():
    assert S.repaired_levels([1, 3, 4, 2, 5]) == [1, 2, 3, 2, 3]
    text = "\n\n".join("word " * n for n in (700, 20, 300, 1500))
    parts = chunking.merged(list(chunking.pieces(text, 600)), 600, 400, 750)
    assert "".join(parts) == text and all(chunking.count_tokens(p) <= 750 for p in parts)


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(T.normal_title(F.lit("  The “Big”  Title!. "))) == "the big title"
    assert get(T.normal_title(F.lit("Don’t “quote” — this –"))) == "dont quote — this"
    assert get(T.reference_numbers(F.lit("[Reference: 3, 1] references 2 and Reference 7 & 8, 9 and 10"))) == [1, 3, 7, 8, 9, 10]  # a plural names none
    assert get(T.plain_markdown(F.lit("# A\n![alt](x.png)  [t](u) `c`\n---\n\n\n\nend"))) == "A\nalt t c\n\nend"
    assert [get(T.slide_type(F.lit(x))) for x in ("A Figure here", "one ROW", "an algorithm", "charts, tables", " \n")] == ["chart", "table", "diagram", "text", "unknown"]
    assert get(U.normalised(F.lit("a/b/"))) == "a/b" and get(U.normalised(F.lit("https://Ex.com/"))) == "https://Ex.com"
    assert get(U.joined(F.lit("http://x.org/a/b"), F.array(*map(F.lit, ["#s", "MAILTO:x", "c", "/d", " "])))) == ["http://x.org/a/b", "http://x.org/a/c", "http://x.org/d"]
    assert get(U.file_name(F.lit("http://x.org/a%20b/c+d%20e.md/?q"))) == "c+d_e.md" and get(U.file_name(F.lit("http://x.org/"))) == "root"
    assert len(get(U.file_name(F.lit("http://x.org/" + "n" * 400 + ".html")))) == 220
    assert get(U.video_host(F.lit("https://youtu.be/x"))) and get(U.unviewable_list(F.lit("https://www.youtube.com/watch?v=1&list=RDx"))) and not get(U.unviewable_list(F.lit("https://www.youtube.com/watch?list=PL1")))
    assert get(T.citations(F.lit("[CITE: a] [CITE: a] [CITE:b]"))) == ["a", "b"]
    assert get(U.normalised(F.lit("HTTP://Ex.com:80/a/b/?q#f"))) == "http://ex.com/a/b?q#f"
    assert get(T.final_channel(F.lit("<think>x</think>y"))) == "y"


def test_token_deltas_hold_back(spark, tmp_path):
    tokens = spark.createDataFrame([(1, 0, "a<thi"), (1, 1, "nk>b</think>c [Refer"), (1, 2, "ence: 1] d")], "request_id long, seq long, token string")
    tokens.coalesce(1).write.parquet(str(tmp_path / "t"))
    out = jobs.run_to_memory(jobs.token_deltas(spark.readStream.schema(tokens.schema).parquet(str(tmp_path / "t"))), "deltas_test", "append").orderBy("out_seq").collect()
    said = {c: "".join(r.delta for r in out if r.channel == c) for c in ("thinking", "final")}
    assert said == {"thinking": "b", "final": "ac [Reference: 1] d"}
