import math

import pytest

from quarry.errors import EvaluationError
from quarry.operators import context, evaluate, lexical, retrieve


def chunks(spark, *texts):
    return spark.createDataFrame([(f"c{i}", f"f{i}.md", t, 0, len(t), "markdown", i) for i, t in enumerate(texts)], "id string, file_path string, text string, start int, end int, kind string, ordinal long")


def asked(spark, *questions):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "qid string, question string")


def ranking(spark, rows):
    return spark.createDataFrame(rows, "qid string, rank int, chunk_id string, score double")


def test_bm25_numbers(spark):
    c = chunks(spark, "cache miss cache", "cache hit", "other words here", "")
    rows = {(r.qid, r.chunk_id): r.score for r in retrieve.bm25(asked(spark, "cache", "cache cache"), lexical.build(c)).collect()}
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    avgdl = 8 / 4
    expected = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avgdl))
    assert rows["q0", "c0"] == pytest.approx(expected, abs=1e-8)
    assert rows["q1", "c0"] == pytest.approx(2 * expected, abs=1e-8)


def test_bm25_ties_and_unknown_words(spark):
    c = chunks(spark, "same words", "same words", "second first", "first")
    found = retrieve.bm25(asked(spark, "same", "the of", "unknownword"), lexical.build(c)).orderBy("rank").collect()
    assert [(r.qid, r.chunk_id) for r in found] == [("q0", "c0"), ("q0", "c1")]
    assert lexical.build_for(c, retrieve.query_terms(asked(spark, "same"))).postings.count() == 2


def test_index_of_nothing(spark):
    index = lexical.build(chunks(spark, "x").limit(0))
    assert index.numbers() == (0, 0.0) and retrieve.bm25(asked(spark, "x"), index).count() == 0


def test_arguments():
    for k in (0, -1):
        with pytest.raises(ValueError):
            retrieve.checked_k(k)
    with pytest.raises(ValueError):
        retrieve.checked_question("  \n")
    assert retrieve.candidates(1) == 10 and retrieve.candidates(5) == 20 and retrieve.candidates(5, 0) == 20 and retrieve.candidates(5, 7) == 7


def test_dense(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 1)
    e = spark.createDataFrame([("c0", 0, [1.0, 0.0]), ("c1", 1, [0.0, 1.0]), ("c2", 2, [0.0, 1.0]), ("c3", 3, None)], "chunk_id string, ordinal long, embedding array<float>")
    q = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.5])], "qid string, embedding array<float>")
    found = sorted((r.qid, r.rank, r.chunk_id) for r in retrieve.dense(q, e, 2).collect())
    assert found == [("a", 1, "c1"), ("a", 2, "c2"), ("b", 1, "c0"), ("b", 2, "c1")]
    assert retrieve.dense(q.limit(0), e, 2).count() == 0


def test_fusion(spark):
    first, second = ranking(spark, [("q", 1, "a", 0.0), ("q", 2, "both", 0.0)]), ranking(spark, [("q", 1, "z", 0.0), ("q", 2, "both", 0.0)])
    rows = retrieve.fuse(first, second, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["both", "a", "z"]
    assert rows[0].score == pytest.approx(2 / 62) and rows[1].score == pytest.approx(1 / 61)


def spans(spark, rows, extra):
    return spark.createDataFrame(rows, f"qid string, {extra}, file_path string, start int, end int")


def test_overlap_edges(spark):
    e = spans(spark, [("q", 0, "f", 0, 100), ("z", 0, "f", 5, 5)], "number int")
    r = spans(spark, [("q", "r", 1, "f", 95, 195), ("q", "r", 2, "f", 0, 5), ("q", "r", 3, "g", 0, 100), ("z", "r", 1, "f", 5, 5)], "result_id string, rank int")
    assert [(x.qid, x.rank) for x in evaluate.matches(e, r).collect()] == [("q", 2)]


def test_recall(spark):
    e = spans(spark, [("q", 0, "f", 0, 10), ("q", 1, "g", 0, 10), ("unasked", 0, "f", 0, 1)], "number int")
    r = spans(spark, [("q", "1", 2, "f", 0, 10), ("other", "2", 1, "f", 0, 10)], "result_id string, rank int")
    assert evaluate.evaluate(e, r, r) == {1: 0.0, 3: 0.5, 5: 0.5, 10: 0.5}
    with pytest.raises(EvaluationError):
        evaluate.evaluate(e.limit(0), r, r)
    with pytest.raises(EvaluationError):
        evaluate.evaluate(e, r, r.where("qid = 'other'"))


def test_context_budget(spark):
    rows = [("q", i + 1, "f", "x" * n) for i, n in enumerate((10, 10, 1))]
    df = spark.createDataFrame(rows, "qid string, rank int, file_path string, text string")
    one = len("Source: f\n") + 10
    sizes = {m: context.build_context(df, m).first() for m in (2 * one + 2, 2 * one + 1, one - 1)}
    assert [r.n for r in sizes.values()] == [2, 1, 0]
    assert sizes[2 * one + 2].context == "Source: f\nxxxxxxxxxx\n\nSource: f\nxxxxxxxxxx"
    q = asked(spark, "a", "b").unionByName(spark.createDataFrame([("q", "c")], "qid string, question string"))
    rows = {r.qid: r for r in context.answer_messages(q, context.build_context(df, one - 1)).collect()}
    assert rows["q0"].answer == context.NO_RESULTS and rows["q"].answer == context.NO_CONTEXT
    ready = context.answer_messages(q, context.build_context(df)).where("status = 'prompt'").first()
    assert "xxxxxxxxxx" in ready.prompt and "c" in ready.prompt


def test_resolve(spark):
    c = chunks(spark, "text")
    good = spark.createDataFrame([("f0.md", 0, 4, 1)], "file_path string, start int, end int, rank int")
    assert context.resolve(good, c).first().id == "c0"
    with pytest.raises(Exception, match="no chunk at"):
        context.resolve(good.withColumn("end", good["end"] + 1), c).collect()
    with pytest.raises(Exception, match="no such chunk"):
        retrieve.materialised(ranking(spark, [("q", 1, "nope", 1.0)]), c).collect()
