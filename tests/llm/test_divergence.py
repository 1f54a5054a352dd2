"""The source divergence audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

from sparkloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=50):
    """rows: (lang, source, text)."""
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(words)
        seen[lang or ""].update(set(words))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in seen.items()}
    rates, out = {}, set()

    def rate(counted, lang):
        total = sum(counted[t] for t in kept[lang])
        return {t: 1 + 1_000_000_000 * (counted[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    for (lang, source), c in counts.items():
        rates[lang, source] = rate(c, lang)
    for (lang, source), p in rates.items():
        whole = rate(sum((c for (x, _), c in counts.items() if x == lang), Counter()), lang)
        pairs = sorted(((-sum(abs(p[t] - q[t]) for t in p), b.encode()) for (x, b), q in rates.items() if x == lang and b != source))
        terms = sorted((whole[t] - p[t], t.encode()) for t in p if counts[lang, source][t] and p[t] > whole[t])[:top]
        for part, found in (("pair", pairs), ("term", terms)):
            out |= {(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)}
    return out


def corpus(n, seed=4):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)] + ["Ünï", "ça", "日本"]
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "", None, "É"])
        yield lang, source, rng.choice([None, ""]) if rng.random() < 0.05 else " ".join(rng.choice(words[: rng.choice((10, 60, 153))]) + rng.choice(["", ".", "-X1y", "\0"]) for _ in range(rng.randrange(60)))


def test_against_plain_counting_with_many_small_runs(spark):
    rows = [*corpus(900), ("xx", "lonely", "one two"), ("xx", "other", None)]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "lang string, source string, text string, Value int, term string").repartition(5)
    for held in (divergence.BLOCK_BYTES, 20_000):  # one run a task, and one every few documents
        got = [tuple(r) for r in divergence.audit(docs, block_bytes=held).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert {r for r in got if r[0] == "xx"} == {("xx", "lonely", "pair", "other", 0, 1), ("xx", "other", "pair", "lonely", 0, 1)}
    assert divergence.audit(docs.limit(0)).count() == 0


def test_runs_spill_sorted_and_merge_whole(spark):
    docs = spark.createDataFrame(list(corpus(400)), "lang string, source string, text string").na.fill("").repartition(3)
    runs = divergence.spilled_runs(docs, 4, 5000).collect()
    assert len(runs) > 100 and all(r["terms"] == sorted(r["terms"]) and r["first"] == r["terms"][0] for r in runs)
    got = {(r["lang"], r["term"]): dict(zip(r["sources"], r["counts"], strict=True)) for r in divergence.frequencies(docs, 1, 5000).collect()}
    want = defaultdict(Counter)
    for lang, source, text in docs.collect():
        for t in TERM.findall(text.translate(LOWER)):
            want[lang, t][source] += 1
    assert got == {k: dict(v) for k, v in want.items()}


def test_merge_of_blocks_that_share_and_skip_terms():
    block = lambda lang, terms: (0, lang, terms[0], terms, ["s"] * len(terms), [1] * len(terms), [1] * len(terms))
    blocks = [block("a", [b"a", b"c"]), block("a", [b"b"]), block("a", [b"c", b"c"]), block("a", [b"c"]), block("a", [b"x"]), block("b", [b"x"]), block("b", [b"y"])]
    assert [(x, t, n["s"], d) for x, t, n, d in divergence.merged(iter(blocks))] == [("a", b"a", 1, 1), ("a", b"b", 1, 1), ("a", b"c", 4, 4), ("a", b"x", 1, 1), ("b", b"x", 1, 1), ("b", b"y", 1, 1)]


def test_sums_of_pairs_spill(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SUM_BYTES", 1)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = list(corpus(500, 9))
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert {tuple(r) for r in divergence.audit(docs).collect()} == plain(rows)
