"""Periodic runs against comparison of all places and periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from sparkloom.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[i:] < s[j:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(s, least=2, times=2):
    n, out = len(s), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, times * q) and size >= 2 * q and not any(all(s[k] == s[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.add((i, size, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def sequences(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        k = rng.choice((1, 2, 3, 5))
        some = lambda most, k=k: [rng.randrange(k) for _ in range(rng.randrange(most))]
        unit = some(7) or [0]
        yield some(24) if rng.random() < 0.5 else some(6) + unit * rng.randrange(1, 24) + unit[: rng.randrange(len(unit) + 1)] + some(9)


def test_lyndon_arrays_and_runs():
    for s in sequences(1, 1500):
        assert periodic_runs.lyndon_array(s) == brute_lyndon(s)
        assert sorted(periodic_runs.runs(s), key=lambda x: (x[0], x[2])) == brute_runs(s)
        assert periodic_runs.word_runs([b"%d" % x for x in s]) == brute_runs(s, 24, 3)


def test_fibonacci_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert sorted(periodic_runs.runs(b), key=lambda x: (x[0], x[2])) == brute_runs(b)
    assert periodic_runs.word_runs([b"x"] * 200_000) == [(0, 200_000, 1)]
    assert len(periodic_runs.lyndon_array(list(range(50_000)))) == 50_000


def plain(doc_id, text):
    """What op11 returns for a document, by comparing all places and periods."""
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 24, 3)
    gone = {i for a, size, q in found for i in range(a + q, a + size)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{a},{size},{q}\n" for a, size, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_over_the_given_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    short = [r for r in rows if len(r["text"] or "") < 6000]  # the plain way is quadratic
    assert len(got) == len(rows) and len(short) > 0.8 * len(rows)
    assert {r["doc_id"]: got[r["doc_id"]] for r in short} == {r["doc_id"]: plain(r["doc_id"], r["text"]) for r in short}
    assert sum(x[0] > 0 for x in got.values()) > 5


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "a b " * 12), (5, "a b " * 11 + "a"), (6, "a b " * 11 + "a b"), (6, "a b " * 11 + "a b"), (None, "x " * 30), (7, "Ä ö " * 24), (8, "one two three four " * 9000 + "end")]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(a, b, "kept", 5) for a, b in ODD], "doc_id long, text string, runs string, W int")
    rows = periodic_runs.periodic_runs(docs).collect()
    spans = lambda r: [tuple(x) for x in r["runs"]]
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) and rows[0]["W"] == 5
    assert [spans(by[k]) for k in (1, 2, 3, 4, 5, 6)] == [[], [], [], [(0, 24, 2)], [], [(0, 24, 2)]]
    assert by[1]["collapsed"] is None and by[2]["collapsed"] == "" and by[4]["collapsed"] == "a b"
    assert spans(by[None]) == [(0, 30, 1)] and spans(by[7]) == [(0, 24, 1)] and by[7]["collapsed"] == "Ä ö"  # a no-break space is no border
    assert spans(by[8]) == [(0, 36000, 4)] and by[8]["collapsed"] == "one two three four end"
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("found,want", [([(0, 24, 8), (30, 24, 8)], (0, 24, 8)), ([(0, 25, 8), (30, 50, 16), (30, 24, 1)], (30, 24, 1)), ([(5, 50, 16), (5, 25, 8)], (5, 25, 8)), ([], None)])
def test_best_run(spark, found, want):
    df = spark.createDataFrame([([dict(zip(("start", "length", "period"), x, strict=True)) for x in found],)], "runs array<struct<start:long,length:long,period:long>>")
    best = df.select(periodic_runs.best_run().alias("b")).head()["b"]
    assert (best and tuple(best)) == want
