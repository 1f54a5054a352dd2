"""Small tables for which queries failed or differed from their SQL."""

import difflib
import itertools
import random
import re

import duckdb
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.functions import policy, scores
from sparkloom.operators import resolve, retrieval
from sparkloom.plans import fleet
from sparkloom.session import new_folder
from sparkloom.streaming import backfill


def against_sql(spark, folder, name):
    """A query's rows and its SQL's over the tables in a folder, both sorted."""
    con = duckdb.connect()
    for path in sorted(folder.glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    got, want = catalog.queries()[name](spark, str(folder)), con.sql(catalog.oracle_sql()[name])
    return sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))), sorted(map(repr, want.fetchall()))


def test_size_guard_with_blank_texts(spark, tmp_path):
    texts = ["word", "", " \t\n", None, "x" * 8001, " " * 8001, "é" * 4000, "é" * 4001]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = against_sql(spark, tmp_path, "s04_size_guard")
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_similar_keys_send_no_lists_to_the_driver(spark):
    """Lists made of keys are no broadcast, and each pair is compared once."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (6, 9, 12, 21, 22, 23, 24, 25, 40) for _ in range(12)]
    words += [w[:i] + rng.choice("abcd") + w[i + rng.randint(0, 1) :] for w in words for i in (2, len(w) - 2)]
    keys = spark.createDataFrame([(t, w) for t in ("org", "person") for w in words] + [("org", None), (None, "abcdefgh")], "type string, canonical_key string")
    got = resolve.similar_keys(keys)
    assert "BroadcastExchange" not in plan_of(got) and plan_of(got).count("ArrowEvalPython [") == 1
    near = {(a, b) for a, b in itertools.combinations(sorted(set(words)), 2)
            if a[0] == b[0] and abs(len(a) - len(b)) <= resolve.LENGTH_WINDOW and difflib.SequenceMatcher(None, a, b).ratio() >= resolve.LEAST_RATIO}
    assert sorted((r["type"], r["a"], r["b"]) for r in got.collect()) == sorted((t, a, b) for t in ("org", "person") for a, b in near) and near


def test_many_vector_queries_in_blocks(spark):
    """Scores, ties and odd vectors as of single queries, without a row for each pair."""
    rng = random.Random(4)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 3, [1.0, None, 2.0], [1.0], [2.0], [nan, 1.0, 0.0], [inf, 1.0, 0.0], [1e200] * 3, [1e-200] * 3]
    rows = [(i, v) for i, v in enumerate(odd + [[round(rng.uniform(-1, 1), 1) for _ in range(3)] for _ in range(90)] + [[0.5, 0.5, -0.1]] * 20)]
    points = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = points.where("id % 3 = 0 and id <> 0 or id < 12").select(F.col("id").alias("query"), F.col("embedding").alias("asked"))
    pairs = asked.crossJoin(points).select("query", "id", F.round(scores.cosine(F.col("embedding"), F.col("asked")), 9).alias("score")).where("score is not null")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    for k in (1, 5, 200):
        got = retrieval.scored_each(points, asked, k)
        assert sorted(map(repr, got.select("query", "id", "score", "n").collect())) == sorted(map(repr, pairs.withColumn("n", nth).where(F.col("n") <= k).collect()))
        assert "FlatMapCoGroupsInArrow" in plan_of(got) and "Join" not in plan_of(got)
    assert retrieval.scored_each(points.limit(0), asked, 5).count() == 0 and retrieval.scored_each(points, asked.limit(0), 5).count() == 0


def test_overlap_reads_each_list_once(spark, sf_dir):
    """Two result lists are worked out once each."""
    a = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, None), (2, 5), (None, 1)], "query long, id long")
    b = spark.createDataFrame([(1, 2), (1, None), (1, 3), (3, 5), (None, 1)], "query long, id long")
    assert sorted(map(repr, map(tuple, retrieval.top_k_overlap(a, b, 2).collect()))) == sorted(map(repr, [(1, 0.5), (2, 0.0), (None, 0.0)]))
    assert plan_of(catalog.queries()["j23_parity"](spark, sf_dir)).count("FlatMapCoGroupsInArrow") == 2


def test_fleet_equals_checks_of_each_spec(spark):
    """Reasons, versions and acceptance as of single specs, whose number no join or sort depends on."""
    agents = [("p", "ab"), ("p", "x" * 36), ("q", "ok-1"), ("q", "Not Ok"), ("r", ""), ("r", "r-2"), ("s", "s-1"), ("t", "b" * 38), (None, "n"), ("u", None)]
    templates = spark.createDataFrame([(p, a, None if a == "s-1" else "name", "A", 5, "", "role") for p, a in agents], "playbook string, agent string, name string, task_class string, k int, focus string, role string")
    answers = spark.createDataFrame([(w, p) for w in ("ws1", "ws1234567", "Ws2", "", None) for p in "pqrstuv"] + [("w", "p"), ("w2", "r"), ("w2", "r"), ("w3", "u")], "workspace_id string, playbook string")
    whole = answers.where("length(workspace_id) > 3 or playbook = 'r'").select("workspace_id", "playbook", F.lit(4).alias("version"))
    made = answers.join(templates, "playbook").withColumn("id", F.concat_ws("-", "workspace_id", "agent")).where("workspace_id is not null")
    made = made.withColumn("reasons", policy.spec_reasons(*(F.col(c) for c in ("id", "name", "task_class", "k", "focus", "role", "playbook")), ["A"], list("pqrsu")))
    made = made.withColumn("accepted", F.max(F.size("reasons")).over(Window.partitionBy("workspace_id")) == 0)
    want = sorted(repr((r["workspace_id"], r["id"], 5 if r["workspace_id"] and (len(r["workspace_id"]) > 3 or r["playbook"] == "r") or r["playbook"] == "r" else 1, r["reasons"], r["accepted"])) for r in made.collect())
    got = fleet.fleet(answers, templates, whole, ["A"], list("pqrsu"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert {r["accepted"] for r in got.collect()} == {True, False}
    assert not re.search(r"rlike|RLIKE|Window|BroadcastExchange", plan_of(got).split("SortMergeJoin")[0])
    single = spark.createDataFrame([("w-ab", 2), ("w-ab", 7)], "id string, version int")
    assert {r["id"]: r["version"] for r in fleet.fleet(answers, templates, single, ["A"], list("pqrsu")).where("workspace_id = 'w'").collect()} == {"w-ab": 8, "w-" + "x" * 36: 1}


def test_whole_fleets_against_sql(spark, tmp_path):
    """Accepted and refused workspaces, which no given table has both of."""
    parts = [(i, f"part {i}", f"Brand#{2 + i % 3}", ["STANDARD", "PROMO", "SMALL"][i % 3], 5) for i in range(9)] + [(10**9 + 3, "a" * 30, "Brand#5", "PROMO", 5)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 26, 28, 29, 51)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got, want = against_sql(spark, tmp_path, "v14_fleet_whole")
    assert got == want and {r["accepted"] for r in catalog.queries()["v14_fleet_whole"](spark, str(tmp_path)).collect()} == {True, False}
    assert plan_of(catalog.queries()["v14_fleet_whole"](spark, str(tmp_path))).count("Brand#") and "sum(size" not in plan_of(catalog.queries()["v14_fleet_whole"](spark, str(tmp_path)))


def test_backfill_reads_texts_once_a_run(spark, tmp_path):
    """Batches are those of one order by id, and each works on its own texts, not on the table."""
    path = str(tmp_path / "chunks")
    spark.createDataFrame([(f"d{i:02}", c, f"Acme Corp met Acme Corp {i}.") for i in range(11) for c in (0, 1)], "doc_id string, chunk_index int, text string").write.parquet(path)
    passes = backfill.Backfill(spark, new_folder(spark, "backfill"), buckets=2)
    scanned = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            scanned.add(batch.num_rows)
            yield batch

    given = spark.read.parquet(path).mapInArrow(seen, "doc_id string, chunk_index int, text string")
    assert passes.run(given, "deterministic", "one", batch_docs=4) == 11
    batches = {}
    for r in passes._claims.read().collect():
        batches.setdefault(r["batch"], []).append(r["doc_id"])
    assert [sorted(batches[n]) for n in sorted(batches)] == [[f"d{i:02}" for i in range(n, min(n + 4, 11))] for n in (0, 4, 8)]
    assert {(r["status"], r["attempts"], r["entities"]) for r in passes.ledger().collect()} == {("done", 1, 1)}
    assert scanned.value <= 5 * 22  # for the ids, for the bounds of their ranges and for the texts, however many batches there are
