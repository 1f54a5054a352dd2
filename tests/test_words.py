"""The keyword index: stored in batches, searched by phrases, by syntax, and for many questions."""

import random
import re
from itertools import product
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import words
from sparkloom.session import new_folder

VOCABULARY = [f"w{k}" for k in range(40)]


def texts(n, seed=1):
    rng = random.Random(seed)
    pick = lambda: VOCABULARY[min(39, int(rng.expovariate(0.12)))]  # noqa: E731  some words are in nearly all texts
    return {i: " ".join(pick() for _ in range(rng.randrange(40))) for i in range(n)}


def frame(spark, held):
    return spark.createDataFrame(list(held.items()), "point_id long, text string")


def index_of(spark, held, buckets=8):
    index = words.Index(spark, new_folder(spark, "words"), buckets)
    index.add(0, frame(spark, held))
    return index


def state(index):
    rows = {(r["term"], r["point_id"], r["tf"], r["doc_len"], tuple(r["positions"])) for r in index.terms().collect()}
    return rows, tuple(round(x, 9) for x in index.stats().head())


def plain_state(held):
    rows = set()
    for i, t in held.items():
        own = t.split()
        rows |= {(w, i, own.count(w), len(own), tuple(k for k, x in enumerate(own) if x == w)) for w in own}
    return rows, (len(held), round(sum(len(t.split()) for t in held.values()) / len(held), 9))


def test_batches_equal_one_build_and_write_only_their_buckets(spark):
    held = texts(60)
    index = index_of(spark, held, 16)
    assert state(index) == plain_state(held)
    root = Path(index.postings.path.removeprefix("file:"))
    files = {f: f.stat().st_mtime_ns for f in root.rglob("*.parquet")}
    new = {3: "w1 fresh", 61: "quite new new", 5: ""}
    index.add(1, frame(spark, new), spark.createDataFrame([(7,), (9999,)], "point_id long"))
    touched = {d.name for d in (root / "batch-1").glob("bucket=*")}
    gone = [held.pop(7), held[3], held[5]]
    held.update(new)
    terms = sorted({w for t in [*gone, *new.values()] for w in t.split()})
    expected = {f"bucket={r[0]}" for r in spark.createDataFrame([(t,) for t in terms], "term string").select(index.postings.bucket("term")).collect()}
    assert touched == expected and len(touched) < 16
    assert all(f.stat().st_mtime_ns == m for f, m in files.items())
    assert state(index) == plain_state(held)
    index.add(1, frame(spark, {3: "never seen"}))  # a batch that is there stays as it is
    assert state(index) == plain_state(held)
    index.add(2, frame(spark, {61: "w2 w2", 7: "back again"}))
    held.update({61: "w2 w2", 7: "back again"})
    assert state(index) == plain_state(held)
    before = {t: sorted(map(tuple, index.of([t]).drop("bucket").collect())) for t in ("w2", "back", "new")}
    index.compact()
    assert [n for n, _ in index.postings.folders()] == [2] and not (root / "batch-0").exists() and state(index) == plain_state(held)
    assert before == {t: sorted(map(tuple, index.of([t]).drop("bucket").collect())) for t in before}
    index.add(3, frame(spark, {1: "after the base"}))
    held[1] = "after the base"
    assert state(index) == plain_state(held)


def test_a_batch_that_was_cut_short_is_finished(spark, monkeypatch):
    held = texts(30)
    index = index_of(spark, held)
    new = {2: "w0 other", 31: "w1"}
    with monkeypatch.context() as patch:
        patch.setattr(words.BatchedTable, "put", lambda self, *a, real=words.BatchedTable.put, **b: real(self, *a, **b) if "forward" in self.path else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(1, frame(spark, new))
    index.add(1, frame(spark, new))
    held.update(new)
    assert state(index) == plain_state(held)


@pytest.mark.parametrize("query,holds", [
    ("a b", lambda a, b, c: a and b), ("a OR b c", lambda a, b, c: a or (b and c)), ("a AND b OR c", lambda a, b, c: (a and b) or c), ("a AND (b OR c)", lambda a, b, c: a and (b or c)),
    ("a NOT b", lambda a, b, c: a and not b), ("a OR b NOT c", lambda a, b, c: a or (b and not c)), ("a NOT b c", lambda a, b, c: a and not (b and c)), ("(a OR b) NOT (b AND c)", lambda a, b, c: (a or b) and not (b and c)),
    ("xa* NOT b", lambda a, b, c: a and not b), ('"a" AND c', lambda a, b, c: a and c)])
def test_truth_tables(spark, request, query, holds):
    rows = {k: " ".join(["pad", *(f"{x} x{x}y" for x, on in zip("abc", bits, strict=True) if on)]) for k, bits in enumerate(product((False, True), repeat=3))}
    if "index" not in (cache := request.session.__dict__.setdefault("_words_cache", {})):
        cache["index"] = index_of(spark, rows)
    got = {r["point_id"] for r in words.match(cache["index"], words.parse(query)).collect()}
    assert got == {k for k, bits in enumerate(product((False, True), repeat=3)) if holds(*bits)}


def test_what_is_not_in_the_syntax_is_a_phrase(spark):
    for query in ("well-known", "what?", "a AND", "OR b", "(a", "a)", '"open', "*", "", "NOT a"):
        with pytest.raises(words.Unreadable):
            words.parse(query)
    assert words.read_query("well-known fact") == ("phrase", ("well", "known", "fact")) and words.parse("and Or") == ("and", ("word", "and"), ("word", "or"))
    index = index_of(spark, {1: "a well known fact", 2: "known well fact", 3: "well-known fact", 4: "so well known a fact"})
    assert {r["point_id"] for r in words.match(index, words.read_query("well-known fact")).collect()} == {1, 3}
    assert words.keyword_search(index, "?!", 5).count() == 0 and words.keyword_search(index, "", 5).count() == 0
    # fewer than k hold the phrase, and more hold any of its words
    assert {r["point_id"] for r in words.keyword_search(index, "well-known fact", 3).collect()} == {1, 3, 2} or len(words.keyword_search(index, "well-known fact", 3).collect()) == 3
    assert {r["point_id"] for r in words.keyword_search(index, "well-known fact", 2).collect()} == {1, 3}
    assert {r["point_id"] for r in words.keyword_search(index, "well-known fact", 9, or_fallback=False).collect()} == {1, 3}


def test_phrases_count_and_repeat(spark):
    held = {1: "to be or not to be", 2: "be to be to be", 3: "to or be", 4: "Be. TO, be"}
    index = index_of(spark, held)
    for phrase in ("to be", "be to be", "or not to", "be be"):
        own = words.query_terms_in_order(phrase)
        want = {}
        for i, t in held.items():
            t = re.findall(r"\w+", t.lower())
            n = sum(t[k : k + len(own)] == own for k in range(len(t)))
            if n:
                want[i] = n
        assert {r["point_id"]: r["tf"] for r in words.phrase_hits(index.of(sorted(set(own))), own).collect()} == want


def test_many_questions_equal_single_ones_with_few_postings_read(spark):
    held = texts(400, 3)
    index = index_of(spark, held)
    rng = random.Random(5)
    asked = {q: " ".join([*rng.sample(VOCABULARY[:4], 3), *rng.sample(VOCABULARY[12:], 3)]) for q in range(25)} | {90: "nothing here", 91: "w0", 92: ""}
    questions = spark.createDataFrame(list(asked.items()), "query long, text string")
    got = {}
    for r in words.keyword_search_each(index, questions, 3).orderBy("query", "n").collect():
        got.setdefault(r["query"], []).append((r["point_id"], round(r["bm25"], 6)))
    for q, text in asked.items():
        terms = words.query_terms(text)
        plain = sorted(words.match(index, words.parse(" OR ".join(terms))).collect(), key=lambda r: (-r["bm25"], r["point_id"]))[:3] if terms else []
        assert got.get(q, []) == [(r["point_id"], round(r["bm25"], 6)) for r in plain]
    makers, _ = words._bounded(index, questions, 3)
    df = {r["term"]: r["df"] for r in index.terms().groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    every = sum(df.get(t, 0) for text in asked.values() for t in words.query_terms(text))
    assert makers.agg(F.sum("df")).head()[0] < 0.5 * every
