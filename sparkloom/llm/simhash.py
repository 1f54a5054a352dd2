"""SimHash near-dedup: 64-bit fingerprints of word shingles, covering masks, exact verification.

1. A text's fingerprint has the bits that more than half of its shingles' hashes have (XXH64, seed 42, repeats counted).
2. Equal fingerprints are one node. Bit positions get vectors of ``radius + 1`` bits in turn; for each of the
   2 ** (radius + 1) - 1 nonzero vectors v, a mask drops the positions whose vector is orthogonal to v (an even number of
   ones in common). The vectors of any ``radius`` positions leave some v orthogonal to all of them, so every pair within the
   radius is equal under some mask and collides in that table: no pair is missed (Pagh: Locality-sensitive hashing without
   false negatives, SODA 2016).
3. A bucket of two is its smallest and its largest node. Larger ones up to ``BUCKET`` nodes are compared within a row. Nodes
   of a bucket beyond that go another exact way: each is put under all fingerprints within half the radius. Nodes under one such
   centre are linked to each other without a comparison, two nodes within the radius have a centre in common, and a centre has at
   most 2,081 nodes, as nodes differ.
4. The components of all links are the result.

Defined results: texts without words, or null, have fingerprint zero and are linked like others; rows that share a doc_id have
one component, as long as their fingerprints do; a row without doc_id is reported with the component of its fingerprint, null
if no document with an id is in it; texts of any length are read whole; an empty table gives an empty result; other columns
are not read, so their names do not matter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import bound_batches, give_back, slices
from sparkloom.operators.components import connected_components
from sparkloom.session import cut, remove_folder, written

SHINGLE_WORDS = 4
RADIUS = 4
BITS = 64
BUCKET = 64  # nodes of a bucket that are compared within a row
#: Keys of so many larger buckets at most (some 30 bytes each) are broadcast; above, both sides are shuffled.
BROADCAST_BUCKETS = 100_000
SEED = 42
_HASHES = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: bytes, k: int = SHINGLE_WORDS) -> int:
    """The bits that over half of the shingles' hashes have; unsigned."""
    joined = b" ".join(text.lower().split())  # of bytes: A-Z, and at space and 0x09-0x0D
    if not joined:
        return 0
    edges = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = len(edges) + 2 - k
    starts = [0, *(edges + 1).tolist()]
    ends = [*edges.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, SEED)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _HASHES):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + _HASHES)], ends[at + k - 1 : at + k - 1 + _HASHES], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks, one for each nonzero vector."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def near_by(distance: int, bits: int = BITS) -> list[int]:
    """All values of at most ``distance`` bits."""
    return [sum(1 << i for i in some) for n in range(distance + 1) for some in combinations(range(bits), n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _literal(values: list[int]) -> Column:
    return F.array(*(F.lit(_signed(x)).cast("long") for x in values))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc, fp): one row per row of ``docs``; fp as a signed long."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [_signed(fingerprint(x or b"", k)) for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], names=["doc", "fp"])
        give_back()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc long, fp long")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(src, dst) of fp: links that connect all pairs of distinct nodes (fp) within the radius, and no others."""
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for t, m in enumerate(masks(radius))]
    keyed = nodes.select("fp", F.inline(F.array(*tables)))
    buckets = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst")).where("n > 1")
    buckets = cut(buckets)
    twos = buckets.where("n = 2").select("src", "dst").where(_apart(F.col("src"), F.col("dst")) <= radius)

    larger = buckets.where("n > 2").select("t", "key", "n")
    # dealt anew, so that the join shuffles both sides and AQE can split a bucket that holds much of the table
    larger = F.broadcast(larger) if larger.count() <= BROADCAST_BUCKETS else larger.repartition(F.xxhash64("t", "key"))
    members = keyed.join(larger, ["t", "key"])
    held = members.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (y > x) & (_apart(x, y) <= radius)), lambda y: F.struct(x.alias("src"), y.alias("dst")))))
    some = held.select(F.inline(near))

    crowd = members.where(F.col("n") > bucket).select("fp").distinct()
    centres = crowd.select("fp", F.explode(_literal(near_by(radius // 2))).alias("step")).select("fp", F.col("fp").bitwiseXOR(F.col("step")).alias("centre"))
    stars = centres.groupBy("centre").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    hung = stars.select(F.col("fps")[0].alias("src"), F.explode(F.slice("fps", 2, 1 << 30)).alias("dst"))
    return twos.unionAll(some).unionAll(hung).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    if radius % 2:
        raise ValueError("the radius is even: centres lie half of it away")
    rows = cut(fingerprints(docs, id_col, text_col, k))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc").alias("first")))
    found, folder = written(links(nodes.select("fp"), radius, bucket), "links")
    linked = connected_components(found)
    remove_folder(docs.sparkSession, folder)
    tied = nodes.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = tied.groupBy("component").agg(F.min("first").alias("component_id"))
    # dealt anew, so that AQE can split the rows of one fingerprint
    place = tied.select("fp", "component").join(first, "component").select("fp", "component_id").repartition(F.xxhash64("fp"))
    return rows.join(place, "fp").select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
