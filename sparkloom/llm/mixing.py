"""Mixing sources to target weights, with DataFrame functions only.

Token totals per source give repetition rates; each document is emitted floor(rate) times plus one hash-seeded
Bernoulli copy with the fraction as its probability.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a null doc_id draws like
the text "null"; rows that share a doc_id share a draw; a source without words has target 0 and keeps no copies; an
empty table gives an empty result; other columns are carried along whatever their names, and columns named as an output
are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import fresh
from sparkloom.session import cut, numbered

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: A table of this many sources at most (some 50 bytes each) is broadcast; above, both sides are shuffled.
BROADCAST_SOURCES = 20_000


def word_count(text: Column | str) -> Column:
    """Number of runs outside space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target.

    Targets share ``share`` times all tokens by weight and stop at ``most`` times the source's own; the excess is shared
    anew among the others, by weight, until no target is above. Each round is one aggregate over one row per source, and
    fixes at least one source more; sources keep the order of their code points by range partitioning.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    sizes = numbered(sizes, F.col("source").asc_nulls_last()).select(
        "source", "source_size", F.element_at(cycle, (F.col("at") % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * most).alias("cap"))
    sizes = cut(sizes)
    total = (sizes.agg(F.sum("source_size")).head()[0] or 0) * share
    level, stopped = 0.0, F.lit(False)
    while True:
        caps, open_weight = sizes.agg(F.coalesce(F.sum(F.when(stopped, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0))).head()
        new = (total - caps) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
        stopped = F.lit(level) * F.col("weight") > F.col("cap")
    return sizes.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def uniform(doc_id: Column | str, seed: int) -> Column:
    """A number in [0, 1) from the seed and the id alone, so that reruns and retried tasks agree."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (size * copies)."""
    made = ("size", "source_size", "target", "copies", "taken")
    carried = [c for c in docs.columns if c not in made]
    sized = docs.select(*(docs[f"`{c}`"] for c in carried), word_count(docs[f"`{text_col}`"]).alias("size"))
    # one small row per source, written once: the documents below are read again, not shuffled
    targets = cut(source_targets(sized.select(F.col(source_col).alias("source"), "size"), weights, share, most))
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    name = fresh("mix_source", docs)
    targets = targets.withColumnRenamed("source", name)
    joined = sized.join(F.broadcast(targets) if small else targets, sized[f"`{source_col}`"].eqNullSafe(targets[name]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (uniform(F.col(f"`{id_col}`"), seed) < rate - F.floor(rate)).cast("long")
    joined = joined.withColumn("copies", F.floor(rate) + extra).withColumn("taken", F.col("size") * F.col("copies"))
    return joined.select(*(F.col(f"`{c}`") for c in (*carried, *made)))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of mix() as often as its copies say."""
    name = fresh("mix_copy", mixed)
    return mixed.withColumn(name, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop(name)


ORACLE_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM sizes),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least((max(level) OVER ()) * weight, cap::DOUBLE) AS target FROM levels),
rated AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('9:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
