"""Backfill: a run that is killed anywhere and run again equals one run."""

import re

import pytest

from sparkloom.session import new_folder
from sparkloom.streaming import backfill

CHUNKS = "doc_id string, chunk_index int, text string"


def chunks(n=14):
    rows = []
    for i in range(n):
        rows += [(f"d{i:02}", 0, f"Acme Corp blocks project Zeta{i} here. Acme Corp and Zeta{i} met Acme Corp again."), (f"d{i:02}", 1, "poison" if i % 5 == 3 else f"Later Blue River owns Zeta{i}.")]
    return [*rows, ("d98", 0, "  \n"), ("d99", 0, None)]


def complete(text):
    if text == "poison":
        raise RuntimeError("model said no")
    m = re.search(r"(Acme Corp|Blue River) (blocks|owns) (?:project )?(Zeta\d+)", text)
    yield {"subject": m[1], "subject_type": "org", "predicate": m[2], "object": m[3], "object_type": "product"}
    yield {"subject": m[1], "subject_type": "org", "predicate": "owns", "object": "Not There", "object_type": "product"}


def state(b):
    rows = lambda df: sorted(map(str, df.collect()))
    return rows(b.ledger()), rows(b.triples()), rows(b.mentions()), rows(b.pairs())


def open_backfill(spark):
    return backfill.Backfill(spark, new_folder(spark, "backfill"), complete, buckets=4)


def test_two_passes_with_limits_and_failures(spark):
    b, given = open_backfill(spark), spark.createDataFrame(chunks(), CHUNKS)
    assert b.run(given, "deterministic", "r1", limit=5, batch_docs=3) == 5 and b.run(given, "deterministic", "r1", limit=5, batch_docs=3) == 5
    assert b.run(given, "deterministic", "r2") == 11
    assert b.run(given, "llm", "r3", batch_docs=6) == 16
    ledger = {(r["doc_id"], r["pass"]): r for r in b.ledger().collect()}
    assert len(ledger) == 32 and {ledger[d, p]["status"] for d in ("d98", "d99") for p in backfill.PASSES} == {"skipped"}
    failed = {d for (d, p), r in ledger.items() if r["status"] == "failed"}
    assert failed == {"d03", "d08", "d13"} and ledger["d03", "llm"]["error"] == "RuntimeError: model said no"
    assert (ledger["d00", "llm"]["edges"], ledger["d00", "llm"]["entities"]) == (2, 3)  # what a text does not bear out is no triple
    assert b.triples().count() == 22 and b.mentions().count() > 14 and b.pairs().count() > 0
    # the next run takes what has failed again, and nothing else
    assert b.run(given, "llm", "r4") == 3
    again = {r["doc_id"]: r["attempts"] for r in b.ledger().where("pass = 'llm'").collect()}
    assert {d for d, n in again.items() if n == 2} == failed and max(again.values()) == 2
    assert b.run(given, "deterministic", "r5") == 0
    with pytest.raises(ValueError):
        b.run(given, "other", "r6")


def test_killed_runs_equal_one_run(spark, monkeypatch):
    given = spark.createDataFrame(chunks(9), CHUNKS)
    whole = open_backfill(spark)
    for name in backfill.PASSES:
        whole.run(given, name, f"run {name}", batch_docs=4)
    killed, calls = open_backfill(spark), [0]

    def put(self, *a, real=backfill.BatchedTable.put, **k):
        calls[0] += 1
        if calls[0] in (3, 6, 8, 13, 17, 19, 24, 26):
            raise KeyboardInterrupt
        return real(self, *a, **k)

    with monkeypatch.context() as patch:
        patch.setattr(backfill.BatchedTable, "put", put)
        for name in backfill.PASSES:
            for _ in range(30):
                try:
                    killed.run(given, name, f"run {name}", batch_docs=4)
                    break
                except KeyboardInterrupt:
                    pass
    assert calls[0] > 12 and state(killed) == state(whole)
