"""MinHash near-dedup: fast similarity sketches, banding, and exact verification on whole shingle sets.

1. Each text becomes its set of word shingles, a fingerprint of that set, and a sketch of ``bands * rows`` coordinates.
2. Equal sets are one class from here on, under its smallest doc_id; copies are never compared.
3. Classes that agree on a band are held against the band's smallest one (n - 1 pairs, not all pairs): sorted by it,
   they stream past its set, so a hot band is spread over tasks and no group is ever held. A pair at the threshold
   shares no band with a probability of about 2e-7.
4. What the true links leave apart within a band is compared exactly too: all but the band's largest component, in
   blocks, with the whole band. So the work beyond step 3 grows with the classes that are *not* linked, not with the
   square of a cluster of near copies. An inverted list of one block's shingles counts the intersections.
5. The components of all true links are the result.

Defined results: a text without words, or null, has an empty set, is linked with nothing and stays; rows that share a
doc_id are one document (each row is reported; their links join); a row without doc_id is reported without component
and stays; ids are integers, or are cast to such; texts of any length are read as a whole; other columns are not read, so their
names do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import bound_batches, fresh, give_back, slices
from sparkloom.llm.shingles import FastSimilaritySketch, fingerprint, mix, overlap, seeds, shingle_sets
from sparkloom.operators.components import connected_components
from sparkloom.session import cut

SHINGLE_WORDS = 5
BANDS, ROWS = 48, 8
BLOCK = 512  # sets in a block, or in one task's share of a band
BLOCK_HASHES = 1 << 21  # shingles of a block's sets, 16 MB


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc, n, a, b, bands): set size, fingerprint, and one hash per band; no bands for the empty set."""
    weights = seeds(rows, 3)
    bound_batches(docs.sparkSession)

    def run(batches):
        sketch, marks = FastSimilaritySketch(bands * rows), seeds(bands, 5)
        for batch in batches:
            for part in slices(batch):
                sizes, one, two, keys = [], [], [], []
                for values in shingle_sets(part.column(1), k):
                    a, b = fingerprint(values)
                    sizes.append(len(values))
                    one.append(a)
                    two.append(b)
                    keys.append(mix((sketch(values).reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64) ^ marks).view(np.int64) if len(values) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "n", "a", "b", "bands"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc long, n int, a long, b long, bands array<long>")


def _shingled(members: DataFrame, k: int) -> DataFrame:
    """(node, set) of members (node, a, b, text), without rows of another text under the same id."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column("text"), k))
                same = pa.array([fingerprint(s) == (a, b) for s, a, b in zip(sets, part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"]).filter(same)
        give_back()

    return members.select("node", "a", "b", "text").mapInArrow(run, "node long, set binary")


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = overlap(a, b)
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def _held_against_pivots(dealt: DataFrame, percent: int) -> DataFrame:
    """(src, dst): true links of members and the pivot of their star; dealt: star, part, leads, node, set."""

    def run(batches):
        at, pivots = None, []
        for batch in batches:
            for rows in slices(batch):
                src, dst = [], []
                for star, part, leads, node, raw in zip(*(rows.column(c).to_pylist() for c in ("star", "part", "leads", "node", "set")), strict=True):
                    values = np.frombuffer(raw, np.uint64)
                    if (star, part) != at:
                        at, pivots = (star, part), []
                    if leads:
                        pivots.append(values)
                    elif any(_near(values, x, percent) for x in pivots):
                        src.append(node)
                        dst.append(star)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
        give_back()

    ordered = dealt.select("star", "part", "leads", "node", "set").repartition("star", "part").sortWithinPartitions("star", "part", F.desc("leads"))
    return ordered.mapInArrow(run, "src long, dst long")


def true_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (left, right) with 100 * intersection >= percent * union; right None: within left."""
    other = left if right is None else right
    sizes = np.array([len(x) for x in other])
    flat = np.concatenate(other)
    owner = np.repeat(np.arange(len(other)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    shift = 0 if right is None else len(left)
    parent = list(range(shift + len(other)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, own in enumerate(left):
        low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        n = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(other))
        near = (shared > 0) & (100 * shared >= percent * (len(own) + sizes - shared))
        for j in np.flatnonzero(near):
            if right is None and j <= i:
                continue
            a, b = root(i), root(int(j) + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j)))
    return out


def _verified(dealt: DataFrame, percent: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")  # row order is not given after a shuffle
        nodes, blocks = table["node"].to_pylist(), table["block"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        first, second = table["i"][0].as_py(), table["j"][0].as_py()
        l, r = (np.flatnonzero(blocks == x) for x in (first, second))  # noqa: E741
        if first == second:
            found = [(nodes[l[i]], nodes[l[j]]) for i, j in true_links([sets[x] for x in l], None, percent)] if len(l) > 1 else []
        else:
            found = [(nodes[l[i]], nodes[r[j]]) for i, j in true_links([sets[x] for x in l], [sets[x] for x in r], percent)] if len(l) and len(r) else []
        src, dst = zip(*found, strict=True) if found else ((), ())
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return dealt.groupBy("band", "i", "j").applyInArrow(run, "src long, dst long")


def _blocks(rows: str, hashes: str) -> Column:
    """Long texts make smaller blocks, so that a block's sets stay within BLOCK_HASHES or so whatever the texts' lengths."""
    return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(hashes) / BLOCK_HASHES)).cast("int")


def _stars(met: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(node, tags, parts): the stars, each with a part, that a node is held against, and into how many parts its own is dealt."""
    of = lambda name: sizes.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"))
    pairs = met.where("node <> star").select("node", "star").distinct().join(of("node"), "node").join(of("star"), "star")
    # sets of too different sizes cannot be near
    pairs = pairs.where(100 * F.least("size_node", "size_star") >= percent * F.greatest("size_node", "size_star")).groupBy("node", "star").agg(F.max("size_node").alias("size"))
    parts = pairs.groupBy("star").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes")).select("star", _blocks("n", "hashes").alias("parts"))
    # dealt anew, so that both sides of the join are shuffled and a hot star is split
    members = pairs.join(parts.repartition(F.xxhash64("star")), "star").select("node", F.struct("star", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")).alias("tag"))
    tags = members.groupBy("node").agg(F.collect_list("tag").alias("list"))  # one a band at most
    both = tags.join(parts.withColumnRenamed("star", "node"), "node", "full_outer")
    return both.select("node", F.struct(F.coalesce("list", F.array().cast("array<struct<star:bigint,part:int>>")).alias("list"), F.coalesce("parts", F.lit(0)).alias("parts")).alias("tags"))


def _apart(met: DataFrame, components: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, tags): for each band that holds several components, the blocks in which a node is compared.

    Blocks 0 to low - 1 hold all components but the largest; they meet each other and the largest one's blocks.
    """
    size = sizes.groupBy("node").agg(F.max("size").alias("size"))
    rows = met.select("band", "node").join(components, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")).join(size, "node")
    mark = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")
    parts = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes"), mark)
    bands = parts.groupBy("band").agg(F.count(F.lit(1)).alias("components"), F.sum("n").alias("all_n"), F.sum("hashes").alias("all_hashes"), F.sum("mark").alias("mark"),
                                      F.max_by(F.struct("component", "n", "hashes"), F.struct("n", F.col("component"))).alias("most"))
    # a band of two is the pair that its star has decided; bands of the same nodes are compared once
    bands = bands.where("components > 1 and all_n > 2")
    once = bands.groupBy("mark", "all_n").agg(F.min_by(F.struct("band", "all_hashes", "most"), "band").alias("b"))
    dealt = once.select("b.band", F.col("b.most.component").alias("largest"), F.col("b.most.n").alias("high_n"), F.col("b.most.hashes").alias("high_hashes"),
                        (F.col("all_n") - F.col("b.most.n")).alias("low_n"), (F.col("b.all_hashes") - F.col("b.most.hashes")).alias("low_hashes"))
    dealt = dealt.select("band", "largest", _blocks("low_n", "low_hashes").alias("low"), _blocks("high_n", "high_hashes").alias("high"))
    low = F.col("component") != F.col("largest")
    to = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    tag = F.struct("band", F.when(low, to("low")).otherwise(F.col("low") + to("high")).alias("block"), F.when(low, F.col("low") + F.col("high")).otherwise(F.col("low")).alias("meets"))
    return rows.join(dealt, "band").select("node", tag.alias("tag")).groupBy("node").agg(F.collect_list("tag").alias("tags"))  # one a band at most


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
                    k: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    seen = cut(features(docs, id_col, text_col, k, bands, rows))
    full = seen.where("n > 0 and doc is not null")
    classes = cut(full.groupBy("a", "b").agg(F.min("doc").alias("rep"), F.max("n").alias("size")))
    reps = full.join(classes.drop("size"), ["a", "b"]).where("doc = rep").select("rep", F.explode("bands").alias("band"))
    pivots = reps.groupBy("band").agg(F.min("rep").alias("star"), F.max("rep").alias("far")).where("star <> far").drop("far")
    pivots = pivots.repartition(F.xxhash64("band"))  # dealt anew, so that both sides of the join are shuffled and a hot band is split
    met = cut(reps.join(pivots, "band").select("band", F.col("rep").alias("node"), "star").distinct())
    sizes = classes.select(F.col("rep").alias("node"), "size")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))

    wanted = met.select("node").distinct().join(classes.select("a", "b", F.col("rep").alias("node")), "node")
    sets = cut(_shingled(texts.join(wanted, "node"), k))  # texts are shuffled once

    own = F.transform(F.sequence(F.lit(0), F.col("tags.parts") - 1), lambda i: F.struct(F.col("node").alias("star"), i.cast("int").alias("part"), F.lit(True).alias("leads")))
    held = F.transform("tags.list", lambda x: F.struct(x["star"].alias("star"), x["part"].alias("part"), F.lit(False).alias("leads")))
    places = F.when(F.col("tags.parts") > 0, F.concat(held, own)).otherwise(held)
    starred = sets.join(_stars(met, sizes, percent), "node").select("node", "set", F.explode(places).alias("p")).select("node", "set", "p.*")
    near = connected_components(_held_against_pivots(starred, percent))

    apart, linked = cut(_apart(met, near, sizes)), near
    if not apart.isEmpty():
        tagged = sets.join(apart, "node").select("node", "set", F.explode("tags").alias("t")).select("node", "set", "t.*")
        dealt = (tagged.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
                 .select("band", "node", "block", "set", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
        linked = connected_components(near.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionAll(_verified(dealt, percent)))

    component = classes.drop("size").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("a", "b", F.coalesce("component", "rep").alias("component"))
    out = seen.select("doc", "n", "a", "b").join(component, ["a", "b"], "left")
    group = F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc").isNotNull(), group).alias("component_id"),
                      (F.col("doc").isNull() | (F.col("doc") == group)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
                         bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id."""
    name = fresh("gone_id", docs)
    gone = near_duplicates(docs, id_col, text_col, percent, bands=bands, rows=rows).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone[name], "left_anti")
