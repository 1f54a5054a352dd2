"""How far the sources of a language differ in their words: single-pass in-memory indexing, merged runs, pair corrections.

1. Each task counts the terms of its documents in memory, by language and source, until about ``block_bytes`` are held.
   Then it spills a run: the counts sorted by hash shard, language and term, in blocks of ``BLOCK`` entries.
2. A shard's blocks arrive by language and first term. A heap holds the runs' open blocks, and a block is opened once the
   heap's least term reaches its first one; so the runs merge into one frequency list for each term, and terms of fewer than
   ``least_docs`` of the language's documents go.
3. A pair of sources is as far apart as the smoothed rates of all kept terms. Most terms occur in few sources, so each pair
   begins with what absent terms alone would give, and the frequency lists are streamed past the sources' rates, which adds
   a correction for each term that one of them has. Tasks keep sums of pairs, never pairs by term.
4. The terms a source has more often than its language are ranked, the first ``top_terms`` of each source.

Rates are integers: p = 1 + floor(UNIT * (count + 5) / (N + 5 V)), with N the group's count over the language's V kept terms.

Defined results: null texts, languages and sources are empty strings, and the empty string is a language or source like
others; a source without terms has the rate of absent terms, a language without kept terms gives pairs of value 0; ties of
value are ranked by the item's bytes; repeated rows count again; very long texts are counted whole; other columns are not
read, so their names do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.arrow import bound_batches, give_back, slices
from sparkloom.session import cut

LEAST_DOCS = 30
TOP_TERMS = 50
UNIT, SMOOTH = 1_000_000_000, 5
BLOCK_BYTES = 96 << 20  # of counts that a task holds before it spills a run
ENTRY_BYTES = 280  # of a term's two counts, besides its own bytes
BLOCK = 1024  # entries of a block
SLOT_TERMS = 4096  # kept terms that meet a language's rates at once, in step 3
SUM_BYTES = 64 << 20  # of sums of pairs that a task holds
#: A table of this many groups at most (some 100 bytes each) is broadcast; above, both sides are shuffled.
BROADCAST_GROUPS = 20_000

_FOLD = bytes(x if x >= 128 or 97 <= x <= 122 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))
_RUNS = "shard int, lang string, first binary, terms array<binary>, sources array<string>, n array<bigint>, docs array<bigint>"


def terms(text: bytes) -> list[bytes]:
    """Runs of letters A-Z, lowered, and of characters outside ASCII."""
    return text.translate(_FOLD).split()


def _run(held: dict[tuple[str, str], tuple[Counter, Counter]], shards: int) -> Iterator[pa.RecordBatch]:
    """The counts that are held as a run: sorted by shard, language, term and source, in blocks."""
    groups = [k for k in sorted(held) if held[k][0]]
    if not groups:
        return
    sizes = [len(held[k][0]) for k in groups]
    column = lambda make, kind: np.concatenate([np.fromiter(make(*held[k]), kind, n) for k, n in zip(groups, sizes, strict=True)])
    own = pa.concat_arrays([pa.array(list(held[k][0]), pa.binary()) for k in groups])
    langs, lang = np.unique([k[0] for k in groups], return_inverse=True)
    group = np.repeat(np.arange(len(groups), dtype=np.int32), sizes)
    shard = (column(lambda counts, _: map(zlib.crc32, counts), np.int64) % shards).astype(np.int32)
    lang = lang.astype(np.int32)[group]
    order = np.asarray(pc.sort_indices(pa.table({"s": shard, "l": lang, "t": own, "g": group}), [(c, "ascending") for c in "sltg"]))
    shard, lang, own = shard[order], lang[order], own.take(pa.array(order))
    edges = np.flatnonzero(np.concatenate(([True], (np.diff(shard) != 0) | (np.diff(lang) != 0), [True])))
    starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    ends = pa.array(np.append(starts, len(order)).astype(np.int32))
    lists = lambda values: pa.ListArray.from_arrays(ends, values)
    n, docs = column(lambda counts, _: counts.values(), np.int64), column(lambda counts, docs: map(docs.__getitem__, counts), np.int64)
    sources = pa.array([k[1] for k in groups], pa.string()).take(pa.array(group[order]))
    columns = [pa.array(shard[starts]), pa.array(langs.tolist(), pa.string()).take(pa.array(lang[starts])), own.take(pa.array(starts)), lists(own), lists(sources), lists(pa.array(n[order])), lists(pa.array(docs[order]))]
    blocks = pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _RUNS.split(", ")])
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 16 * BLOCK)))
        yield blocks.slice(at, to - at)
        at = to


def spilled_runs(docs: DataFrame, shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of term-sorted runs of docs (lang, source, text), by hash shard."""
    bound_batches(docs.sparkSession)

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    words = terms(text)
                    own = set(words)
                    counts, seen = held.setdefault((lang, source), (Counter(), Counter()))
                    new = -len(counts)
                    counts.update(words)
                    seen.update(own)
                    new += len(counts)
                    size += new * (ENTRY_BYTES + sum(map(len, own)) // len(own)) if new else 0
                    if size >= block_bytes:
                        yield from _run(held, shards)
                        held, size = {}, 0
        yield from _run(held, shards)
        give_back()

    return docs.select("lang", "source", "text").mapInArrow(run, _RUNS)


def _lists(column: pa.Array) -> Iterator[list]:
    """The lists of a column; their values are converted all at once."""
    values = column.flatten()
    if pa.types.is_integer(values.type):
        flat = values.to_numpy().tolist()
    elif pa.types.is_string(values.type):  # few different ones
        coded = values.dictionary_encode()
        flat = list(map(coded.dictionary.to_pylist().__getitem__, coded.indices.to_numpy().tolist()))
    else:
        flat = values.to_pylist()
    at = 0
    for n in column.value_lengths().to_pylist():
        yield flat[at : at + n]
        at += n


def merged(blocks: Iterator[tuple]) -> Iterator[tuple[str, bytes, dict[str, int], int]]:
    """(lang, term, counts by source, documents) from blocks (shard, lang, first, terms, sources, n, docs) in their order.

    Open blocks are held, one or two of each run; a block is let go with its last entry.
    """
    heap: list[tuple[bytes, int, int, tuple]] = []
    coming, opened = next(blocks, None), 0
    at = term = None
    counts: dict[str, int] = {}
    docs = 0
    while heap or coming is not None:
        if not heap and coming[:2] != at:
            if term is not None:
                yield at[1], term, counts, docs
            at, term = coming[:2], None
        while coming is not None and coming[:2] == at and (not heap or coming[2] <= heap[0][0]):
            heapq.heappush(heap, (coming[2], opened, 0, coming))
            coming, opened = next(blocks, None), opened + 1
        least, k, i, block = heap[0]
        if least != term:
            if term is not None:
                yield at[1], term, counts, docs
            term, counts, docs = least, {}, 0
        own, sources, n, seen = block[3:]
        while i < len(own) and own[i] == term:
            counts[sources[i]] = counts.get(sources[i], 0) + n[i]
            docs += seen[i]
            i += 1
        if i < len(own):
            heapq.heapreplace(heap, (own[i], k, i, block))
        else:
            heapq.heappop(heap)
    if term is not None:
        yield at[1], term, counts, docs


def frequencies(docs: DataFrame, least_docs: int = LEAST_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, term, sources, counts) of the terms in at least ``least_docs`` documents of their language."""
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        def rows():
            for batch in batches:
                for part in slices(batch):
                    yield from zip(*(c.to_pylist() for c in part.columns[:3]), *map(_lists, part.columns[3:]), strict=True)

        def batch(some: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=["lang", "term", "sources", "counts"])

        some: list[tuple] = []
        entries = 0
        for lang, term, counts, seen in merged(rows()):
            if seen >= least_docs:
                some.append((lang, term.decode(), list(counts), list(counts.values())))
                entries += len(counts)
                if entries >= 16 * BLOCK:
                    yield batch(some)
                    some, entries = [], 0
        if some:
            yield batch(some)
        give_back()

    runs = spilled_runs(docs, shards, block_bytes)
    ordered = runs.repartition("shard").sortWithinPartitions("shard", "lang", "first")
    return ordered.mapInArrow(run, "lang string, term string, sources array<string>, counts array<bigint>")


def _rate(count: Column, all_terms: Column) -> Column:
    """p of a count in a group with N + 5 V = all_terms, exactly; null if the language has no terms."""
    return F.when(all_terms > 0, 1 + F.call_function("div", (count.cast("decimal(20,0)") + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)"), all_terms.cast("decimal(20,0)")))


class _Sums:
    """Corrections of the pairs of one language's sources; rows of sums are made as sources occur."""

    def __init__(self, lang: str, rates: list[tuple[str, int]]) -> None:
        self.lang = lang
        self.names = [x for x, _ in rates]
        self.number = {x: k for k, x in enumerate(self.names)}
        self.all_terms = [n for _, n in rates]
        self.absent = np.array([1 + UNIT * SMOOTH // n for _, n in rates], np.int64)
        self.rows: dict[int, np.ndarray] = {}  # corrections of a source that has a term, and each other one
        self.both: dict[int, np.ndarray] = {}  # those of sources that both have it

    def add(self, sources: list[str], counts: list[int]) -> None:
        at = np.array([self.number[x] for x in sources])
        own = np.array([1 + UNIT * (n + SMOOTH) // self.all_terms[k] for n, k in zip(counts, at, strict=True)], np.int64)
        rates = self.absent.copy()
        rates[at] = own
        change = np.abs(own[:, None] - rates) - np.abs(self.absent[at, None] - self.absent)
        for k, x in zip(at.tolist(), change, strict=True):
            if k not in self.rows:
                self.rows[k], self.both[k] = np.zeros(len(rates), np.int64), np.zeros(len(rates), np.int64)
            self.rows[k] += x
            self.both[k][at] += x[at]

    def bytes(self) -> int:
        return 16 * len(self.rows) * len(self.names)

    def take(self) -> Iterator[pa.RecordBatch]:
        """(lang, source, other, delta), one source's rows at a time; for absent sources the mirrored pair too."""
        names = pa.array(self.names, pa.string())
        n = len(self.names)
        for k, x in self.rows.items():
            one = pa.array([self.names[k]] * n, pa.string())
            lang = pa.array([self.lang] * n, pa.string())
            for a, b, delta in ((one, names, x), (names, one, x - self.both[k])):
                yield pa.RecordBatch.from_arrays([lang, a, b, pa.array(delta)], names=["lang", "source", "other", "delta"])
        self.rows, self.both = {}, {}


def pair_corrections(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, delta) of frequency lists streamed past the rates of groups (lang, source, v, all_terms)."""
    slots = F.greatest(F.lit(1), F.ceil(F.col("v") / SLOT_TERMS)).cast("int")
    langs = groups.groupBy("lang").agg(F.max(slots).alias("slots"))
    placed = lists.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("slots")).cast("int").alias("slot"), F.lit(1).alias("kind"), "sources", "counts")
    leads = groups.where("v > 0").select("lang", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"), F.lit(0).alias("kind"), F.array("source").alias("sources"), F.array("all_terms").alias("counts"))

    def run(batches):
        at, rates, sums = None, [], None
        for batch in batches:
            for part in slices(batch):
                for lang, slot, kind, sources, counts in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (lang, slot) != at:
                        at, rates = (lang, slot), []
                        if sums and sums.lang != lang:
                            yield from sums.take()
                            sums = None
                    if not kind:
                        rates.append((sources[0], counts[0]))
                        continue
                    if not sums:
                        sums = _Sums(lang, rates)
                    sums.add(sources, counts)
                    if sums.bytes() > SUM_BYTES:
                        yield from sums.take()
        if sums:
            yield from sums.take()
        give_back()

    ordered = leads.unionByName(placed).repartition("lang", "slot").sortWithinPartitions("lang", "slot", "kind", "sources")
    return ordered.mapInArrow(run, "lang string, source string, other string, delta bigint").groupBy("lang", "source", "other").agg(F.sum("delta").alias("delta"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source the others by distance, and the terms it has more often."""
    own = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    lists = cut(frequencies(own, least_docs, block_bytes))
    entries = lists.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("lang_count"), F.explode(F.arrays_zip("sources", "counts")).alias("e")).select(
        "lang", "term", "lang_count", F.col("e.sources").alias("source"), F.col("e.counts").alias("n"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = lists.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("lang_total"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    v = F.coalesce("v", F.lit(0))
    groups = cut(groups.select("lang", "source", v.alias("v"), (F.coalesce("total", F.lit(0)) + SMOOTH * v).alias("all_terms"), (F.coalesce("lang_total", F.lit(0)) + SMOOTH * v).alias("lang_terms")))

    absent = groups.select("lang", "source", "v", _rate(F.lit(0), F.col("all_terms")).alias("z"))
    others = absent.select("lang", F.col("source").alias("other"), F.col("z").alias("other_z"))
    pairs = absent.join(others, "lang").where("source <> other").join(pair_corrections(lists, groups), ["lang", "source", "other"], "left")
    value = F.coalesce(F.col("v") * F.abs(F.col("z") - F.col("other_z")), F.lit(0)) + F.coalesce("delta", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), value.cast("long").alias("value"))

    small = groups if groups.count() > BROADCAST_GROUPS else F.broadcast(groups)
    above = entries.join(small, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                                           (_rate(F.col("n"), F.col("all_terms")) - _rate(F.col("lang_count"), F.col("lang_terms"))).cast("long").alias("value")).where("value > 0")
    # the keys in another order, so that the union does not take both sides for partitioned alike
    rank = lambda *group: F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank("source", "lang")).unionByName(above.withColumn("rank", rank("lang", "source")).where(F.col("rank") <= top_terms))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
tokens AS (SELECT doc_id, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM tokens GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30),
per AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM tokens t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM kept GROUP BY lang),
sized AS (SELECT g.lang, g.source, l.v, l.total, coalesce(sum(p.n), 0)::HUGEINT AS own FROM groups g LEFT JOIN langs l ON g.lang = l.lang LEFT JOIN per p ON g.lang = p.lang AND g.source = p.source GROUP BY ALL),
rates AS (SELECT s.lang, s.source, k.term, coalesce(p.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(p.n, 0) + 5)) // (s.own + 5 * s.v) AS p,
  1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (s.total + 5 * s.v) AS q
  FROM sized s JOIN kept k ON s.lang = k.lang LEFT JOIN per p ON p.lang = s.lang AND p.source = s.source AND p.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM rates WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
