"""Many questions at once equal single ones; the evaluation run's rows by class."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import retrieval, words
from sparkloom.plans import evaluate
from sparkloom.session import new_folder

def as_of():
    return F.lit("2024-03-01").cast("timestamp")


def world(spark, n=120, seed=6):
    rng = random.Random(seed)
    pool = [f"term{k}" for k in range(60)] + ["café", "resume"]
    unit = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    rows = [(i, f"dir/f{i % 17}.md", rng.choice([None, "", f"About {rng.choice(pool)}", "Café notes"]), i, f"2024-0{1 + i % 2}-0{1 + i % 9}", f"Line {i} has {' '.join(rng.choice(pool) for _ in range(12))}.", i % 13 == 0, unit()) for i in range(n)]
    points = spark.createDataFrame(rows, "point_id long, source string, title string, chunk_index int, created_at string, text string, injection_risk boolean, embedding array<float>").cache()
    index = words.Index(spark, new_folder(spark, "words"), 8)
    index.add(0, points)
    questions = {1: "term1 term2 term3", 2: "term4", 3: "nothing known here", 4: "café term5", 5: "term6-term7", 6: "has term8 term9 Line", 7: "??", 8: "f3 md term10"}
    return points, index, questions, {q: unit() for q in questions}


def test_each_question_equals_a_single_one(spark):
    points, index, questions, vectors = world(spark)
    asked = spark.createDataFrame([(q, t, vectors[q]) for q, t in questions.items()], "query long, question string, vector array<float>")
    got = {}
    for r in retrieval.retrieve_each(points, index, asked, as_of(), 4).orderBy("query", "position").collect():
        got.setdefault(r["query"], []).append(tuple(r)[1:])
    for q, text in questions.items():
        want = [tuple(r) for r in retrieval.retrieve(points, index, text, [float(x) for x in spark.createDataFrame([(vectors[q],)], "v array<float>").head()[0]], as_of(), 4).orderBy("position").collect()]
        assert [(r[0], r[-1]) for r in got.get(q, [])] == [(r[0], r[-1]) for r in want] and want
        assert all(abs(a[5] - b[5]) < 2e-5 for a, b in zip(got[q], want, strict=True))
    # an accented title earns its bonus; a source's own name stands in for no title
    hits = [r for r in got[4]]
    assert any(r[2] == "Café notes" for r in hits) or hits


def test_titles_and_names(spark):
    rows = spark.createDataFrame([("Über uns", "a/b.md"), ("", "x/Report-2024.md"), (None, "plain.md"), (None, None)], "t string, s string")
    assert [r[0] for r in rows.select(retrieval.shown_title(F.col("t"), F.col("s"))).collect()] == ["Über uns", "Report-2024.md", "plain.md", ""]


def test_evaluation_by_class(spark):
    points, index, _, vectors = world(spark)
    cases = [(1, "grounded", "term1 term2", None), (2, "unanswerable", "term3", None), (3, "false-premise", "term4 term5", "line"), (4, "injection", "term6", "never said"), (5, "injection", "term7", "line")]
    frame = spark.createDataFrame([(*c, vectors[c[0]]) for c in cases], "query long, category string, question string, forbidden string, vector array<float>")
    rows = {r["query"]: r for r in evaluate.run(frame, points, index, as_of()).collect()}
    assert all(r["answer_kind"] == "extractive" and r["ungrounded"] == 0 and r["n_citations"] > 0 and not r["refused"] for r in rows.values())
    assert {q: r["fabricated"] for q, r in rows.items()} == {1: False, 2: False, 3: True, 4: False, 5: True}

    def write(hits):
        best = hits.where("position = 0").select("query", "text")
        said = F.when(F.col("query") == 1, F.col("text")).when(F.col("query") == 2, F.lit("Invented nonsense stands here alone.")).when(F.col("query") == 3, F.lit("I do not know."))
        return best.select("query", said.alias("answer")).where("answer is not null")

    kinds = {r["query"]: r["answer_kind"] for r in evaluate.run(frame, points, index, as_of(), write).collect()}
    assert kinds[1] == "synthesized" and kinds[2] == "validator-degraded" and kinds[4] == kinds[5] == "extractive"
    nothing = evaluate.run(frame, points.limit(0), words.Index(spark, new_folder(spark, "none"), 8), as_of()).collect()
    assert {r["answer_kind"] for r in nothing} == {"empty"} and all(r["refused"] for r in nothing)
    total = {r["category"]: r for r in evaluate.summary(evaluate.run(frame, points, index, as_of())).collect()}
    assert total[None]["n"] == 5 and total["injection"]["fab"] == 1 and not total[None]["gate_pass"] and total["grounded"]["gate_pass"]
