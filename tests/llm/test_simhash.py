"""SimHash near-dedup against comparison of all pairs."""

import random
import re
from itertools import combinations

import pytest
import xxhash

from sparkloom.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, k=4):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=4):
    """values: {doc: fingerprint}; {doc: smallest doc reachable}."""
    group = {d: d for d in values}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for a, b in combinations(sorted(values), 2):
        if (values[a] ^ values[b]).bit_count() <= radius:
            x, y = root(a), root(b)
            group[max(x, y)] = min(x, y)
    return {d: root(d) for d in values}


def test_every_pair_within_the_radius_collides_and_masks_are_balanced():
    found = simhash.masks()
    assert len(found) == 31 and all(30 <= m.bit_count() <= 34 for m in found)
    rng = random.Random(1)
    for n in (1, 2, 3, 4):
        for _ in range(4000):
            apart = sum(1 << i for i in rng.sample(range(64), n))
            assert any(not apart & m for m in found)
    small = simhash.masks(2, 9)  # all of them
    assert all(any(not apart & m for m in small) for apart in range(1 << 9) if apart.bit_count() <= 2)
    assert any(all(apart & m for m in small) for apart in range(1 << 9) if apart.bit_count() == 3)


def test_fingerprints_count_repeats_and_break_ties_to_zero():
    for text in (None, "", " \n", "One", "a B c", "a b c d", "a b c d e", "x " * 9, "Ünï cödé wörds hère Ä", "a b c d e f", "q w e r t y " * 9000):
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_query_over_the_given_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    values = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    want = plain_components(values)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op13_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {d: (f"{x:016x}", want[d]) for d, x in values.items()}
    assert sum(d != c for d, c in want.items()) > 5


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_of_clouds_and_chains(spark, monkeypatch, bucket):
    """Clouds of near values make hot buckets, which go by centres; chains are linked from end to end."""
    monkeypatch.setattr(simhash, "BROADCAST_BUCKETS", 0 if bucket == 2 else 100_000)
    rng = random.Random(bucket)
    values = []
    for _ in range(4):
        centre = rng.getrandbits(64)
        values += [centre ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(7))) for _ in range(80)]
        for _ in range(12):
            centre ^= sum(1 << i for i in rng.sample(range(64), rng.choice((4, 4, 5))))
            values.append(centre)
    values += [0, (1 << 64) - 1, 1 << 63]
    values = sorted(set(values))
    nodes = spark.createDataFrame([(simhash._signed(x),) for x in values], "fp long")
    unsigned = lambda x: x % (1 << 64)
    found = [(unsigned(r["src"]), unsigned(r["dst"])) for r in simhash.links(nodes, bucket=bucket).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    number = {x: k for k, x in enumerate(values)}
    want = plain_components(dict(enumerate(values)))
    group = dict.fromkeys(range(len(values)))
    group = {k: k for k in group}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for a, b in found:
        x, y = root(number[a]), root(number[b])
        group[max(x, y)] = min(x, y)
    assert {k: root(k) for k in group} == want


def test_odd_rows(spark):
    same = "a text of more than four words"
    docs = spark.createDataFrame([(5, None, 1), (3, "", 1), (None, " ", 1), (9, same, 1), (7, same.upper(), 1), (7, same, 1), (None, "all alone here", 1), (1, "other", 1)], "doc_id long, text string, FP int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (9, 7), (7, 7), (7, 7), (None, None), (1, 1)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, radius=3)
