"""Exact scores by tiles against the same scores pair by pair."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import tiles as T, vectors as V
from quillspark.plans import retrieval

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [1.0], [0.0, 0.0, 0.0], [None, 1.0, 2.0], [NAN, 1.0, 0.0], [INF, 0.0, 1.0], [-INF, 1.0, 1.0], [1e200, -1e200, 1e200], [1e-30, 0.0, 0.0], [1e9, 1e9, -1e9], [0.25e-6, 0.25e-6, 1.0]]


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(5)
    rows = [[rng.choice([0.5, 0.25, -0.125, 1.0, rng.gauss(0, 1)]) for _ in range(3)] for _ in range(300)]
    rows += rows[:80] + ODD  # copies: ties
    v = spark.createDataFrame([(i, x, i // 4 if i % 7 else None, i % 3 if i % 11 else None) for i, x in enumerate(rows)], "id long, v array<double>, page_id long, label int").repartition(3).cache()
    q = v.where("id % 5 = 0 OR id >= 380").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "label").cache()
    return v, q


def shown(df):
    return sorted((tuple(map(repr, r)) for r in df.collect()))


@pytest.mark.parametrize("metric", ["dot", "normalised", "cosine"])
def test_topk_of_odd_vectors(monkeypatch, sides, metric):
    for name, n in (("VECTORS", 90), ("QUERIES", 40), ("AT_ONCE", 7)):
        monkeypatch.setattr(T, name, n)
    monkeypatch.setattr(T.blocks_of, "__defaults__", ((90, 40),))
    v, q = sides
    order = [F.desc("score"), F.asc("id")]
    for scope in (None, ["label"]):
        want = V.best(V.scored(v, q if scope else q.drop("label"), metric, scope=scope), ["query_id"], order, 6)
        assert shown(V.topk(v, q, 6, metric, scope=scope)) == shown(want)


def test_others_and_payload(sides):
    v, q = sides
    pairs = v.crossJoin(q.withColumnRenamed("label", "gold")).where("id <> query_id AND size(v) = size(q)")
    want = V.best(pairs.select("query_id", "gold", "id", "label", F.round(V.dot("v", "q"), 6).alias("score")), ["query_id"], [F.desc("score"), F.asc("id")], 10)
    got = V.best(T.topk_pairs(v.drop("page_id"), q.withColumnRenamed("label", "gold"), 10, other=True), ["query_id"], [F.desc("score"), F.asc("id")], 10)
    assert shown(got.select(want.columns)) == shown(want)


@pytest.mark.parametrize("how", ["max", "sum", "mean"])
def test_pages_of_odd_vectors(sides, how):
    v, q = sides
    tame = "{0} < 386 OR {0} > 390"  # sums of what is left don't rest on their order
    v, q = v.where("page_id IS NOT NULL").where(tame.format("id")), q.drop("label").where(tame.format("query_id"))
    of = lambda df: {(r.query_id, r.page_id): r.score for r in df.collect()}
    got, want = of(T.page_pairs(v, q, how, 6)), of(V.page_scores(V.scored(v, q, keep=["page_id"]), how, 6))
    assert {k for k in got if got[k] is None} == {k for k in want if want[k] is None} and any(x is None for x in got.values())
    assert {k: x or 0 for k, x in got.items()} == pytest.approx({k: x or 0 for k, x in want.items()}, abs=1.1e-6, nan_ok=True)


def test_work_is_tiles_not_rows(spark, tmp_path):
    """A search over 20,000 vectors took minutes pair by pair; no plan holds a product of rows any more."""
    plan = V.topk(spark.range(9).select("id", F.array(F.rand(1), F.rand(2)).alias("v")), spark.range(3).select(F.col("id").alias("query_id"), F.array(F.rand(3), F.rand(4)).alias("q")), 2)
    for df in (plan, retrieval._retrieved(spark, "/root/testdata/sf0.001"), retrieval.vec_page_sum(spark, "/root/testdata/sf0.001"), retrieval.vec_topk_scoped(spark, "/root/testdata/sf0.001")):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" in text and "Join" not in text


def test_half_up():
    import numpy as np

    x = np.array([0.0000005, 1.0000015, -0.0000025, 2.5e-7, -1e-9, NAN, INF, 12345678901.1234567])
    assert [repr(float(y)) for y in T.half_up(x, 6)] == ["1e-06", "1.000002", "-3e-06", "0.0", "0.0", "nan", "inf", "12345678901.123457"]


def test_word_scores_by_blocks(spark, monkeypatch):
    from quillspark.operators import lexical as L

    monkeypatch.setattr(L, "BLOCK", 2)
    docs = spark.createDataFrame([(1, "A b\x0bB\tc d"), (2, ""), (3, None), (4, "é É  x y b")], "id long, text string")
    queries = spark.createDataFrame([(1, "b b É"), (2, None), (3, "  "), (4, "x y zz"), (5, "d")], "query_id long, query string")
    got = {(r.query_id, r.id): r.score for r in V.tf_overlap(docs, queries).collect()}
    assert len(got) == 20 and {k: x for k, x in got.items() if x} == {(1, 1): 0.4, (1, 4): 0.75, (4, 4): 0.25, (5, 1): 0.2}
    bm = {(r.query_id, r.id): r.score for r in V.bm25(docs, queries).collect()}
    assert set(bm) == {(1, 1), (1, 4), (4, 4), (5, 1)}
    # 4 documents, 3 with a text, 3 words on average; "b" stands in two of them
    import math

    part = lambda df, tf, n: math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 3))
    assert bm[(1, 4)] == pytest.approx(part(2, 1, 4) + part(1, 2, 4), abs=1e-6) and bm[(5, 1)] == pytest.approx(part(1, 1, 5), abs=1e-6)
    assert V.bm25(docs, queries.limit(0)).count() == 0
    for df in (V.tf_overlap(docs, queries), V.bm25(docs, queries)):  # pairs are neither joined nor shuffled
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("weights", [(1.0, 1.0), (0.2, 3.0), (1.0, -1.0)])
def test_fusion_ranks_whole_lists(spark, weights):
    rng = random.Random(9)
    words = ["a", "b", "c", "d", "e f", "g"]
    rows = [(i, [rng.choice([0.5, 1.0, -1.0, rng.gauss(0, 1)]) for _ in range(2 if i % 9 else 3)], " ".join(rng.choice(words) for _ in range(i % 6)) if i % 13 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, v array<float>, text string").repartition(3)
    asked = [(k, [rng.gauss(0, 1) for _ in range(2 if k % 4 else 3)], t) for k, t in enumerate(["a b", "zz", None, "a b", "g", "c d e"])]
    queries = spark.createDataFrame(asked, "query_id long, q array<float>, query string")
    df = V.hybrid(docs, queries, 3, weights)
    dense = V.scored(docs, queries).withColumnRenamed("score", "dense")
    both = dense.join(V.bm25(docs, queries), ["query_id", "id"], "left").fillna(0.0, ["score"]).collect()
    want = set()
    for k in range(6):
        own = [r for r in both if r.query_id == k]
        d, b = ({r.id: n for n, r in enumerate(sorted(own, key=key), 1)} for key in (lambda r: (-r.dense, r.id), lambda r: (-r.score, r.id)))
        fused = sorted((-round(weights[0] / (60 + d[r.id]) + weights[1] / (60 + b[r.id]), 8), r.id) for r in own)[:3]
        want |= {(k, i, -s, n, d[i], b[i]) for n, (s, i) in enumerate(fused, 1)}
    assert {(r.query_id, r.id, r.score, r["rank"], r.dense_rank, r.bm25_rank) for r in df.collect()} == want
    # the whole lists of a query were joined and shuffled as pairs; now tiles count them
    assert df._jdf.queryExecution().optimizedPlan().toString().count("CoGroup") >= 2


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_concepts_stay_in_their_row(spark, tmp_path):
    """Every word was a row of a shuffle."""
    from quillspark.plans import catalogue

    spark.createDataFrame([(1, "b A a  B c d e f g h i j k"), (2, "  "), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalogue.queries()["capped_concepts"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [(1, "b A c d e f g h i j")] and "Aggregate" not in _plan(df) and "Window" not in _plan(df)


def test_levels_and_sentences_come_in_batches(spark):
    """Each group was a call of its own between Spark and Python."""
    from quillspark.operators import sequence as S

    h = spark.createDataFrame([(1, 3, 3), (1, 1, 1), (1, 2, 3), (2, 1, 5)], "f long, n long, level int")
    df = S.levels_repaired(h, "f", "n")
    assert sorted(map(tuple, df.collect())) == [(1, 1, 1), (1, 2, 2), (1, 3, 2), (2, 1, 5)] and "FlatMapGroups" not in _plan(df)
    lines = spark.createDataFrame([(1, 2, 0, 10.0, 12.0, " b. "), (1, 1, 0, 10.0, 0.0, "a"), (1, 3, 0, 10.0, 24.0, "c"), (2, 1, 0, 10.0, 0.0, "d"), (2, 2, 0, 10.0, 90.0, "e")], "f long, n long, block int, size double, y double, text string")
    df = S.sentences_of_lines(lines, "f", "n")
    assert sorted(map(tuple, df.collect())) == [(1, 0, "a b.", 2), (1, 1, "c", 1), (2, 0, "d", 1), (2, 1, "e", 1)] and "FlatMapGroups" not in _plan(df)


def test_long_inputs_do_not_come_back(spark):
    from quillspark.operators import models as M

    rows = spark.range(0, 450, 1, 1).select("id", F.repeat(F.lit("x"), 30).alias("t"))

    def model(asked):
        assert len(asked) <= 10
        if asked[0][0] is None:
            raise ValueError("none")
        return [str(len(t)) for (t,) in asked]

    df = M.predicted(rows, model, ["t"], "s", keep=["id"])
    assert df.columns == ["id", "s", "s_error"] and df.where("s = '30' AND s_error IS NULL").count() == 450
    assert M.predicted(rows.withColumn("t", F.lit(None).cast("string")), model, ["t"]).where("prediction_error = 'none' AND t IS NULL").count() == 450
