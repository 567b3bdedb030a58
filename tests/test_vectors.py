import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions.vectors import dot, pack
from millrace.operators import context, knn


def brute(vectors, questions, k):
    out = set()
    for q, qv in questions:
        scored = sorted((-float(np.dot(np.float64(v), np.float64(qv))), i) for i, v in vectors)
        out |= {(q, i, rank, round(-s, 9)) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


def collected(df):
    return {(r.question_id, r.vec_id, r["rank"], round(r.score, 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(400, 8)).astype("float32").tolist()
    vectors = list(enumerate(base)) + [(1000 + i, base[3]) for i in range(200)]  # a third are copies
    questions = [(q, rng.normal(size=8).tolist()) for q in range(6)] + [(6, [float(x) for x in base[3]])]
    stored = spark.createDataFrame(vectors + [(5000, None)], "vec_id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame(questions, "question_id int, question_vector array<double>")
    return vectors, questions, stored, asked


@pytest.mark.parametrize("max_cells", [16_000_000, 24, 1])
@pytest.mark.parametrize("at_once", [1, 40, 4_000_000])
def test_top_k_is_exact(case, max_cells, at_once, monkeypatch):
    """Whatever the size of question blocks and of the steps within a batch."""
    vectors, questions, stored, asked = case
    matrix, rows = (np.array([v for _, v in x], dtype=float) for x in (questions, vectors))
    monkeypatch.setattr(knn, "SCORES_AT_ONCE", at_once)
    monkeypatch.setattr(knn, "FOLD_AT", min(at_once, 100))
    best = knn._Best(matrix, 5, np.empty(0, np.int64))
    for at in range(0, len(rows), 150):
        best.add(pa.array([i for i, _ in vectors[at : at + 150]]), rows[at : at + 150])
    place = np.arange(35) % 5 + 1
    assert {(q, i, p, round(s, 9)) for q, s, i, p in zip(best.asked, best.scores, best.found, place)} == brute(vectors, questions, 5)
    assert collected(knn.top_k(stored, asked, 5, max_cells=max_cells)) == brute(vectors, questions, 5)


def test_ties_go_to_the_lower_id(case):
    _, _, stored, asked = case
    hits = knn.top_k(stored, asked.filter("question_id = 6"), 4).orderBy("rank").collect()
    assert [r.vec_id for r in hits] == [3, 1000, 1001, 1002]


def test_single_question(case):
    vectors, questions, stored, _ = case
    q, vector = questions[0]
    got = [r.vec_id for r in knn.top_k_single(stored, vector, 3).collect()]
    want = sorted((rank, i) for qq, i, rank, _ in brute(vectors, [(q, vector)], 3))
    assert got == [i for _, i in want]


def test_text_ids(spark):
    stored = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [0.5])], "vec_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [2.0])], "question_id string, question_vector array<double>")
    assert [r.vec_id for r in knn.top_k(stored, asked, 2).orderBy("rank").collect()] == ["a", "b"]


def test_no_questions(case):
    _, _, stored, asked = case
    assert knn.top_k(stored, asked.filter("question_id < 0"), 2).count() == 0


@pytest.mark.parametrize("max_cells", [16_000_000, 2])
def test_vectors_of_another_length_are_an_error(spark, max_cells):
    stored = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], "question_id int, question_vector array<double>")
    with pytest.raises(Exception, match="length|shape|inhomogeneous"):
        knn.top_k(stored, asked, 1, max_cells=max_cells).collect()


def test_mean_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [0.0, 1.0])], "k int, v array<float>")
    assert {r.k: list(r.v) for r in knn.mean_vector(df, "v", "k").collect()} == {1: [2.0, 4.0], 2: [0.0, 1.0]}


def test_dot_and_pack(spark):
    df = spark.createDataFrame([("[1.5, 2, 1e-3]", [2.0, 1.0, 1000.0])], "j string, w array<double>")
    row = df.select(pack(F.col("j")).alias("v"), dot(pack(F.col("j")), F.col("w")).alias("s")).first()
    assert row.v[:2] == [1.5, 2.0] and row.s == pytest.approx(6.0, rel=1e-6)
    short = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert short.select(dot(F.col("a"), F.col("b")).alias("s")).first().s is None


def test_context_and_prompt(spark):
    hits = spark.createDataFrame([(1, 7, 2), (1, 9, 1)], "question_id int, vec_id int, rank int")
    documents = spark.createDataFrame([(7, "seven"), (9, "nine {query}"), (8, "no")], "doc_id int, text string")
    questions = spark.createDataFrame([(1, "why\nnot?")], "question_id int, query string")
    found = context.with_content(hits, documents, "vec_id", "doc_id", "text")
    contexts = context.context(found, "question_id", "vec_id")
    assert contexts.first().context == (
        "Document Name: 9\nContent: nine {query}\n\n---\n\nDocument Name: 7\nContent: seven"
    )
    prompt = context.prompts(contexts, questions, "question_id", "query", "Q {query} C {context}").first().prompt
    assert prompt.startswith("Q why not? C Document Name: 9\nContent: nine {query}")


def test_a_hit_without_a_document_keeps_its_question(spark):
    hits = spark.createDataFrame([(1, 7, 1), (1, 9, 2), (2, 9, 1)], "question_id int, vec_id int, rank int")
    documents = spark.createDataFrame([(7, "seven"), (8, "no")], "doc_id int, text string")
    found = context.with_content(hits, documents, "vec_id", "doc_id", "text")
    assert found.count() == 3
    contexts = {r.question_id: r.context for r in context.context(found, "question_id", "vec_id").collect()}
    assert contexts == {1: "Document Name: 7\nContent: seven", 2: ""}


def test_scores_that_overflow_are_left_out(spark):
    stored = spark.createDataFrame([(1, [1e300, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1e300, 1.0])], "question_id int, question_vector array<double>")
    assert [r.vec_id for r in knn.top_k(stored, asked, 2).orderBy("rank").collect()] == [2, 3]
    assert [r.vec_id for r in knn.top_k_single(stored, [1e300, 1.0], 2).collect()] == [2, 3]


@pytest.mark.parametrize("max_cells", [1, 4, 16_000_000])
@pytest.mark.parametrize("parts", [1, 5])
def test_bad_vectors_cost_no_hits(spark, max_cells, parts):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [0.5, 0.5]), (4, [None, 1.0]), (5, None), (6, [inf, 0.0]), (7, [0.0, 1.0]), (None, [9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [nan, 1.0]), (4, None)], "question_id long, question_vector array<double>")
    got = sorted((r.question_id, r["rank"], r.vec_id) for r in knn.top_k(vectors, asked, 2, max_cells=max_cells).collect())
    assert got == [(1, 1, 1), (1, 2, 3), (2, 1, 7), (2, 2, 3)]
    assert [r.vec_id for r in knn.top_k_single(vectors, [1.0, 0.0], 3).collect()] == [1, 3, 7]
