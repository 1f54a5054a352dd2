"""Queries that SQL does not express, each against plain Python on the given tables."""

import difflib
import itertools
import re

import pytest

from sparkloom import catalog
from sparkloom.catalog import base, graph_queries
from sparkloom.functions import guard
from sparkloom.operators import chunking, resolve, retrieval
from sparkloom.session import table


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: (r["text"], r["source"]) for r in table(spark, sf_dir, "documents").collect()}


def run(spark, sf_dir, name):
    return catalog.queries()[name](spark, sf_dir).collect()


def window(text, limit=700):
    """A window in the words of its rule: ragged starts are skipped, long texts end with a sentence."""
    t = (text or "").strip(" \t\n\x0b\x0c\r")
    if t and (t[0].islower() or t[0] in ",;:)]}"):
        found = re.search(r"[.!?][ \t\n\x0b\x0c\r]+|\n", t[:220])
        t = t[found.end() :].lstrip(" \t\n\x0b\x0c\r") if found else t
    if len(t) > limit:
        last = max(t[:limit].rfind(x) for x in (". ", ".\n", "! ", "? "))
        t = t[: last + 1] if last > limit // 2 else t[:limit]
    return t.rstrip(" \t\n\x0b\x0c\r")


def test_windows(spark, sf_dir, texts):
    assert {r["doc_id"]: r["window"] for r in run(spark, sf_dir, "f20_verbatim_window")} == {i: window("end of a line before. " + t if t is not None else "") for i, (t, _) in texts.items()}


def test_extractive_answer(spark, sf_dir):
    points = base.points(spark, sf_dir, vectors=True)
    hits = retrieval.retrieve(points, base.word_index(spark, sf_dir), base.QUESTION, base.query_vector(spark, sf_dir), base.as_of()).collect()
    best = max(hits, key=lambda r: (-1.0 if r["vscore"] is None else r["vscore"], -r["position"]))
    assert [tuple(r) for r in run(spark, sf_dir, "t05_extractive")] == [(best["point_id"], window(best["text"]))]


def test_slices_and_ingest_report(spark, sf_dir, texts):
    rows, masked, flagged = [], 0, 0
    for i, (t, source) in texts.items():
        for n, (body, section) in enumerate(chunking.slices(t or "")):
            shown = f"[Doc: {source} | Section: {section or '—'}]\n{body}"
            rows.append((str(i), n, section))
            for _, pattern in guard.PII:
                masked += len(re.findall(pattern, shown, re.ASCII))
                shown = re.sub(pattern, guard.MASK, shown, flags=re.ASCII)
            flagged += any(re.search(p, shown, re.I | re.ASCII) for _, p in guard.INJECTION)
    got = run(spark, sf_dir, "c01_slices")
    assert sorted((r["doc_id"], r["chunk_index"], r["section"]) for r in got) == sorted(rows)
    assert len({r["chunk_id"] for r in got}) == len(got)
    report = run(spark, sf_dir, "a26_ingest_report")[0].asDict()
    assert report == {"documents": len(texts), "chunks": len(rows), "pii_redacted": masked, "flagged": flagged} and masked


def test_profiles(spark, sf_dir):
    entities, edges, _ = (x.collect() for x in graph_queries._graph(spark, sf_dir))
    top = sorted(entities, key=lambda r: (-r["mention_count"], r["id"]))[:20]
    aliases: dict = {}
    for r in graph_queries._aliases(spark, sf_dir).collect():
        aliases.setdefault(r["entity_id"], set()).add((r["alias"], r["alias_key"]))
    keys, spelled = {r["canonical_key"] for r in top}, {r["label"].strip().lower() for r in top}
    want = {}
    for r in entities:
        own = aliases.get(r["id"], set())
        if r["canonical_key"] in keys or any(k in spelled for _, k in own):
            ends = sum(r["id"] in (e["src_id"], e["dst_id"]) for e in edges)
            want[r["id"]] = (r["canonical_key"], r["type"], "|".join(sorted(a for a, _ in own)), ends)
    assert {r["id"]: (r["canonical_key"], r["type"], r["aliases"] or "", r["n_edges"]) for r in run(spark, sf_dir, "g17_profile")} == want and want


def test_similar_keys(spark, sf_dir):
    names = sorted({re.sub("#0+", " ", r["c_name"].lower()) for r in table(spark, sf_dir, "customer").select("c_name").collect()})
    near = {(a, b) for a, b in itertools.combinations(names, 2)
            if a[0] == b[0] and abs(len(a) - len(b)) <= resolve.LENGTH_WINDOW and difflib.SequenceMatcher(None, a, b).ratio() >= resolve.LEAST_RATIO}
    assert {(r["a"], r["b"]) for r in run(spark, sf_dir, "f07_fuzzy_keys")} == near and near
