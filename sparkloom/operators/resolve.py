"""Entity resolution in batch: the same key, a shared spelling, a very similar key; and what follows from it.

The order of arrival does not matter: keys (type, canonical_key) are nodes, shared spellings and best similar keys are
links, and every component of links is one entity under its best attested key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import scores
from sparkloom.functions.text import sequence_ratio
from sparkloom.operators.components import connected_components
from sparkloom.operators.graph import TYPE_EVIDENCE

# fixed values
LEAST_RATIO, LENGTH_WINDOW, LEAST_LENGTH = 0.92, 2, 6
_GRAM = 4
SHORT = 22  # characters; of two similar keys of which one has so many, at most two characters of each stay unmatched


def entity_id(key: Column, type_: Column) -> Column:
    return scores.point_id(F.concat_ws("|", key, type_))


def _prefix(size: Column) -> Column:
    """How many of a key's rarest grams are enough to meet every key that is similar to it.

    Two keys of ratio r and lengths that differ by the window at most match in M = r (a + b) / 2 characters, in at most one
    block more than there are characters unmatched, and so share M - 3 * blocks grams of four at least.
    """
    matched = F.ceil(LEAST_RATIO * (size - LENGTH_WINDOW / 2))
    blocks = F.floor((1 - LEAST_RATIO) * (2 * size + LENGTH_WINDOW) + 1e-9) + 1
    shared = F.greatest(F.lit(1), matched - (_GRAM - 1) * blocks)
    return size - (_GRAM - 1) - shared + 1


def similar_keys(keys: DataFrame) -> DataFrame:
    """(type, a, b, ratio) of the keys (type, canonical_key) of one type, first letter and nearly one length whose ratio reaches LEAST_RATIO; a < b."""
    # Spark would move a filter on a deterministic ratio below distinct(), to each time that a pair meets
    ratio = sequence_ratio.asNondeterministic()
    return candidate_pairs(keys).withColumn("ratio", ratio("a", "b")).where(F.col("ratio") >= LEAST_RATIO)


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """(type, a, b) of the pairs that are compared: all similar ones, and few others.

    What two similar keys match in is a common subsequence of M = ratio (a + b) / 2 characters. If the shorter one has SHORT
    characters at most, M leaves one or two of each out, so both keys are listed under all that is left of them without as many,
    and meet where these are equal: only pairs with a common subsequence of M meet, however alike all keys are. Longer keys
    meet over their rarest grams of four, and are held against the number of characters that may differ before they are compared.
    """
    # a stated number of partitions: the keys are small, but what they are listed under is not
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = keys.select("type", "canonical_key").where(F.length("canonical_key") >= LEAST_LENGTH).repartition(parts, "type", "canonical_key").distinct()
    keys = keys.withColumns({"size": F.length("canonical_key"), "first": F.substring("canonical_key", 1, 1)})
    return _by_deletion(keys).unionAll(_by_grams(keys.where(F.col("size") > SHORT)))


def _matched(a: Column, b: Column) -> Column:
    """Characters that keys of two lengths match in at least."""
    return F.ceil(LEAST_RATIO * (a + b) / 2 - 1e-9).cast("int")


def _without_some(key: Column, size: Column) -> list[Column]:
    """What is left of a key without none, each one, and each two of its characters."""
    cut = lambda text, i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.lit(1 << 30)))
    one = F.transform(F.sequence(F.lit(1), size), lambda i: cut(key, i))
    two = F.flatten(F.transform(F.sequence(F.lit(2), size), lambda j: F.transform(F.sequence(F.lit(1), j - 1), lambda i: cut(cut(key, j), i))))
    return [F.array(key), one, two]


def _by_deletion(keys: DataFrame) -> DataFrame:
    size = F.col("size")
    partners = F.filter(F.transform(F.sequence(-F.lit(LENGTH_WINDOW), F.lit(LENGTH_WINDOW)), lambda d: size + d),
                        lambda other: (other >= LEAST_LENGTH) & (F.least(size, other) <= SHORT) & (_matched(size, other) <= F.least(size, other)))
    meet = F.transform(partners, lambda other: F.struct(F.least(size, other).alias("low"), F.greatest(size, other).alias("high"), (size - _matched(size, other)).alias("out")))
    none, one, two = _without_some(F.col("canonical_key"), size)
    listed = keys.where(size <= SHORT + LENGTH_WINDOW).select("*", F.explode(meet).alias("m")).select("type", "first", "canonical_key", "size", "m.*")
    left = F.when(F.col("out") == 0, none).when(F.col("out") == 1, one).otherwise(two)
    flat = listed.select("type", "first", "low", "high", "canonical_key", "size", F.explode(F.array_distinct(left)).alias("left"))
    flat = flat.withColumn("met", F.xxhash64("first", "low", "high", "left"))
    low = flat.where("size = low").select("type", "met", F.col("canonical_key").alias("x"))
    high = flat.where("size = high").select("type", "met", F.col("canonical_key").alias("y"))
    # the planner takes lists for as small as the keys they come from, and would send them to the driver for a broadcast
    met = low.hint("merge").join(high.hint("merge"), ["type", "met"]).where((F.length("x") < F.length("y")) | (F.length("x") == F.length("y")) & (F.col("x") < F.col("y")))
    # what meets by its hash alone
    met = met.where((F.substring("x", 1, 1) == F.substring("y", 1, 1)) & (F.length("y") - F.length("x") <= LENGTH_WINDOW))
    return met.select("type", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _by_grams(keys: DataFrame) -> DataFrame:
    grams = F.transform(F.sequence(F.lit(1), F.col("size") - (_GRAM - 1)), lambda i: F.substring(F.col("canonical_key"), i, F.lit(_GRAM)))
    numbered = F.transform(grams, lambda g, i: F.struct(g.alias("gram"), F.size(F.filter(F.slice(grams, 1, i), lambda x: x == g)).alias("again")))
    flat = keys.select("*", F.explode(numbered).alias("g")).select("type", "canonical_key", "size", "first", "g.*")
    df = flat.groupBy("type", "first", "gram", "again").agg(F.count(F.lit(1)).alias("df"))
    nth = F.row_number().over(Window.partitionBy("type", "canonical_key").orderBy("df", "gram", "again"))
    rare = flat.hint("merge").join(df.hint("merge"), ["type", "first", "gram", "again"]).where("df > 1").withColumn("nth", nth).where(F.col("nth") <= _prefix(F.col("size")))
    rare = rare.select("type", "first", "gram", "again", "canonical_key", "size")
    other = rare.withColumnsRenamed({"canonical_key": "b", "size": "size_b"})
    met = rare.withColumnRenamed("canonical_key", "a").hint("merge").join(other.hint("merge"), ["type", "first", "gram", "again"]).where("a < b").where(F.abs(F.col("size") - F.col("size_b")) <= LENGTH_WINDOW)
    pairs = met.select("type", "a", "b").distinct()
    # what is not matched is deleted from one key or put into the other
    differ = F.length("a") + F.length("b") - 2 * _matched(F.length("a"), F.length("b"))
    return pairs.where(F.levenshtein("a", "b") <= differ)


def best_matches(keys: DataFrame) -> DataFrame:
    """(type, canonical_key, match, ratio): each key's most similar one, the smaller one of equals."""
    pairs = similar_keys(keys)
    both = pairs.select("type", F.col("a").alias("canonical_key"), F.col("b").alias("match"), "ratio").unionByName(pairs.select("type", F.col("b").alias("canonical_key"), F.col("a").alias("match"), "ratio"))
    return both.groupBy("type", "canonical_key").agg(F.min_by(F.struct("match", "ratio"), F.struct(-F.col("ratio"), "match")).alias("m")).select("type", "canonical_key", "m.*")


def by_alias(wanted: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(alias_key, type, id) of the entities that a spelling (alias_key, type) stands for, of the same type only; type evidence is no spelling."""
    spelled = aliases.where(~F.startswith("alias_key", F.lit(TYPE_EVIDENCE))).select(F.col("entity_id").alias("id"), "alias_key")
    return spelled.join(entities.select("id", "type"), "id").join(wanted.select("alias_key", "type").distinct(), ["alias_key", "type"]).select("alias_key", "type", "id").distinct()


def resolve(mentions: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(type, canonical_key, entity_id, entity_key): which entity each key of mentions (doc_id, type, canonical_key, alias_key) is.

    Nulls name nothing: rows without type or key are left out, a null alias_key links nothing.
    """
    seen = mentions.where("type is not null and canonical_key is not null").select("doc_id", "type", "canonical_key", "alias_key").distinct()
    nodes = seen.groupBy("type", "canonical_key").agg(F.count_distinct("doc_id").alias("docs")).withColumn("node", entity_id(F.col("canonical_key"), F.col("type")))
    spelled = seen.where("alias_key is not null").select("type", "canonical_key", "alias_key").distinct()
    # a spelling's keys hang on its smallest one: a link for each key, not for each pair
    hub = spelled.groupBy("type", "alias_key").agg(F.min("canonical_key").alias("hub"))
    links = spelled.join(hub, ["type", "alias_key"]).select("type", "canonical_key", F.col("hub").alias("match"))
    if fuzzy:
        links = links.unionByName(best_matches(nodes).select("type", "canonical_key", "match"))
    edges = links.where("canonical_key <> match").select(entity_id(F.col("canonical_key"), F.col("type")).alias("src"), entity_id(F.col("match"), F.col("type")).alias("dst"))
    found = nodes.join(connected_components(edges), "node", "left").withColumn("group", F.coalesce("component", "node"))
    # a struct orders by documents, then by key
    best = found.groupBy("group").agg(F.min_by("canonical_key", F.struct(-F.col("docs"), "canonical_key")).alias("entity_key"))
    return found.join(best, "group").select("type", "canonical_key", entity_id(F.col("entity_key"), F.col("type")).alias("entity_id"), "entity_key")


def type_evidence(resolved: DataFrame, aliases: DataFrame) -> DataFrame:
    """The aliases (entity_id, alias, alias_key) with a row for each type that an entity's key was seen under."""
    types = resolved.select("entity_key", "type").distinct().withColumnRenamed("type", "seen_as")
    rows = resolved.select("entity_id", "entity_key").distinct().join(types, "entity_key").select("entity_id", F.col("seen_as").alias("alias"), F.concat(F.lit(TYPE_EVIDENCE), "seen_as").alias("alias_key"))
    return aliases.select("entity_id", "alias", "alias_key").unionByName(rows).distinct()
