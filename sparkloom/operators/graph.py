"""The property graph: edges, weights, panels, walks, merges and integrity.

Entities (id, canonical_key, label, type, confidence, mention_count, first_seen, last_seen), edges (src_id, dst_id,
predicate, confidence, weight, doc_id, chunk_id, extractor, asserted_at), mentions (entity_id, doc_id) and aliases
(entity_id, alias, alias_key) are tables; every operator gives a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import scores
from sparkloom.functions.identity import ascii_key
from sparkloom.schemas import ENTITY_TYPES, EXTRACTORS, PREDICATES

# fixed values
TOP_PER_DOC, MOST_NODES, MOST_EDGES, MOST_CO_ENTITIES = 10, 50, 400, 8
TYPE_PRIOR = {"date": 0.25, "marker": 0.25, "lock": 0.5, "slice": 0.5}
SHAPE_TYPES = ("money", "date", "lock", "slice", "marker")
NAMED_ORDER = {"product": 4, "person": 3, "technology": 2, "place": 1}
PROVEN, CORROBORATED = 0.9, 3
TYPE_EVIDENCE = "type::"


def entities_from_mentions(mentions: DataFrame) -> DataFrame:
    """One entity per (canonical_key, type); the id is 63 bits of the key's hash, so that no global counter is needed."""
    one = mentions.groupBy("canonical_key", "type").agg(F.min("label").alias("label"), F.max("confidence").alias("confidence"), F.count_distinct("doc_id").alias("mention_count"))
    return one.withColumn("id", scores.point_id(F.concat_ws("|", "canonical_key", "type")))


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge from both ends (node, other, direction), so that walks and lookups are equi joins."""
    out = edges.withColumns({"node": F.col("src_id"), "other": F.col("dst_id"), "direction": F.lit("out")})
    return out.unionByName(edges.withColumns({"node": F.col("dst_id"), "other": F.col("src_id"), "direction": F.lit("in")}))


def co_mentions(mentions: DataFrame, top: int = TOP_PER_DOC) -> DataFrame:
    """(doc_id, a, b): pairs of a document's ``top`` first mentions, and the others paired with the first one only.

    A document makes top * (top - 1) / 2 pairs and one for every further mention; no pair is made across documents.
    """
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "label", "entity_id"))
    ranked = mentions.withColumn("nth", nth)
    lists = ranked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "entity_id"))), lambda x: x["entity_id"]).alias("ids"))
    head = F.slice("ids", 1, top)
    pairs = F.flatten(F.transform(head, lambda a, i: F.transform(F.slice(head, i + 2, top), lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))))
    anchor = F.element_at("ids", 1)
    rest = F.transform(F.slice("ids", top + 1, 1 << 30), lambda b: F.struct(F.least(anchor, b).alias("a"), F.greatest(anchor, b).alias("b")))
    return lists.select("doc_id", F.explode(F.concat(pairs, rest)).alias("p")).select("doc_id", "p.a", "p.b").where("a <> b").distinct()


def mined(mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n_ab, weight, confidence): PMI and its normalised form of every pair; none for fewer than two documents."""
    return weighed(*counted(mentions, pairs))


def counted(mentions: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How many documents hold each entity (entity_id, df) and each pair (a, b, n_ab), and how many there are (n)."""
    n = mentions.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    df = mentions.select("entity_id", "doc_id").distinct().groupBy("entity_id").agg(F.count(F.lit(1)).alias("df"))
    return df, pairs.select("a", "b", "doc_id").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab")), n


def weighed(df: DataFrame, both: DataFrame, n: DataFrame) -> DataFrame:
    """mined() from counts that are at hand."""
    met = both.join(df.select(F.col("entity_id").alias("a"), F.col("df").alias("n_a")), "a").join(df.select(F.col("entity_id").alias("b"), F.col("df").alias("n_b")), "b")
    met = met.crossJoin(F.broadcast(n)).where("n >= 2")  # one row
    args = [F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n")]
    return met.select("a", "b", "n_ab", scores.pmi(*args).alias("weight"), scores.npmi(*args).alias("confidence"))


def asserted(assertions: DataFrame) -> DataFrame:
    """Edges from assertions: the vocabulary and the provenance are checked, self-loops go, repeats add weight."""
    ok = assertions.where(~_refused())
    return ok.groupBy("src_id", "dst_id", "predicate", "doc_id").agg(F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"), F.min("chunk_id").alias("chunk_id"),
                                                                      F.min("extractor").alias("extractor"), F.max("asserted_at").alias("asserted_at"))


def _refused() -> Column:
    bad = ~F.col("predicate").isin(*PREDICATES) | ~F.col("extractor").isin(*EXTRACTORS) | F.col("doc_id").isNull() | (F.col("doc_id") == "") | (F.col("src_id") == F.col("dst_id"))
    return F.coalesce(bad, F.lit(True))


def refused(assertions: DataFrame) -> DataFrame:
    """What asserted() leaves out, with the reason."""
    reason = F.when(F.coalesce(~F.col("predicate").isin(*PREDICATES), F.lit(True)), "unknown predicate").when(F.coalesce(~F.col("extractor").isin(*EXTRACTORS), F.lit(True)), "unknown extractor")
    return assertions.where(_refused()).withColumn("reason", reason.when(F.col("src_id") == F.col("dst_id"), "self-loop").otherwise("no provenance"))


def co_retrieved(mentions: DataFrame, entities: DataFrame, runs: DataFrame, most: int = MOST_CO_ENTITIES) -> DataFrame:
    """CO_ACTIVITY assertions among the most confident entities of the documents (run_id, doc_id) that a run has hit."""
    met = runs.select("run_id", "doc_id").distinct().join(mentions.select("doc_id", "entity_id").distinct(), "doc_id").select("run_id", "entity_id").distinct()
    met = met.join(entities.select(F.col("id").alias("entity_id"), "confidence"), "entity_id")
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("confidence"), "entity_id"))
    ids = met.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("run_id").agg(F.array_sort(F.collect_list("entity_id")).alias("ids"))
    pairs = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + 2, most), lambda b: F.struct(a.alias("src_id"), b.alias("dst_id")))))
    out = ids.select("run_id", F.explode(pairs).alias("p")).select("p.*", F.concat(F.lit("run:"), "run_id").alias("doc_id"))
    return out.withColumns({"predicate": F.lit("CO_ACTIVITY"), "extractor": F.lit("co_activity"), "confidence": F.lit(0.4), "weight": F.lit(1.0)})


def _total(weight: str) -> Column:
    """A sum that does not depend on the order of its rows; weights have four places."""
    return F.sum(F.col(weight).cast("decimal(18,4)")).cast("double")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): the weights of all edges at a node."""
    ends = edges.select(F.col("src_id").alias("id"), "weight").unionAll(edges.select(F.col("dst_id").alias("id"), "weight"))
    return ends.groupBy("id").agg(_total("weight").alias("degree"))


def top_entities(entities: DataFrame, edges: DataFrame, limit: int = MOST_NODES) -> DataFrame:
    """Entities by weighted degree times the prior of their type."""
    prior = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPE_PRIOR.items() for x in kv)), F.col("type")), F.lit(1.0))
    scored = entities.join(degrees(edges), "id", "left").withColumn("score", F.round(F.coalesce("degree", F.lit(0.0)) * prior, 3))
    return scored.orderBy(F.desc("score"), F.desc("mention_count"), F.desc("confidence"), "id").limit(limit).select("id", "label", "type", "score", "confidence", "mention_count")


def panel_edges(nodes: DataFrame, edges: DataFrame, limit: int = MOST_EDGES) -> DataFrame:
    """The heaviest grouped edges among at most 50 nodes."""
    ids = F.broadcast(nodes.select("id"))
    inner = edges.join(ids, edges["src_id"] == ids["id"], "left_semi").join(ids, F.col("dst_id") == ids["id"], "left_semi")
    grouped = inner.groupBy("src_id", "dst_id", "predicate").agg(F.round(_total("weight"), 3).alias("weight"), F.max("confidence").alias("confidence"), F.max("doc_id").alias("doc_id"),
                                                                  F.max("asserted_at").alias("last_seen"), F.count(F.lit(1)).alias("sources"))
    return grouped.orderBy(F.desc("weight"), "src_id", "dst_id", "predicate").limit(limit)


def walk(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(start, id, hop, predicate, doc_id, extractor, via) reached within ``hops`` (1 to 3): distinct steps, not shortest paths.

    One equi join a hop over the undirected view; a step that repeats is dropped at once, so the rows do not multiply.
    """
    ways = undirected(edges).select("node", "other", "predicate", "doc_id", "extractor")
    front, found = starts.select(F.col("id").alias("start"), "id").distinct(), None
    for hop in range(1, max(1, min(hops, 3)) + 1):
        steps = front.join(ways, front["id"] == ways["node"]).select("start", F.col("other").alias("id"), F.lit(hop).alias("hop"), "predicate", "doc_id", "extractor", F.col("node").alias("via")).distinct()
        found = steps if found is None else found.unionByName(steps)
        front = steps.select("start", "id").distinct()
    return found.where("id <> start")


def related(entity_ids: DataFrame, edges: DataFrame, limit: int = 25) -> DataFrame:
    """Each entity's heaviest edges with their direction."""
    near = undirected(edges).join(entity_ids.select(F.col("id").alias("node")), "node", "left_semi")
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), F.desc("confidence"), "other", "predicate", "direction"))
    return near.withColumn("nth", nth).where(F.col("nth") <= limit).select("node", "other", "predicate", "direction", "weight", "confidence", "nth")


def profile(entities: DataFrame, aliases: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entities found by key or by alias (wanted: name), with their spellings and number of edges."""
    keys = wanted.select(ascii_key(F.col("name")).alias("key"), F.lower(F.trim("name")).alias("alias_key"))
    by_key = entities.join(keys, entities["canonical_key"] == keys["key"], "left_semi").select("id")
    by_alias = aliases.join(keys.select("alias_key"), "alias_key", "left_semi").select(F.col("entity_id").alias("id"))
    found = entities.join(by_key.union(by_alias).distinct(), "id", "left_semi")
    spelled = aliases.where(~F.startswith("alias_key", F.lit(TYPE_EVIDENCE))).groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    count = undirected(edges).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"))
    return found.join(spelled, "id", "left").join(count, "id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def health(edges: DataFrame, as_of: Column, stall_hours: int = 24) -> DataFrame:
    """One row per extractor with the total, the last assertion and whether the graph has stalled."""
    out = edges.groupBy("extractor").agg(F.count(F.lit(1)).alias("edges"), F.max("asserted_at").alias("last_grown"))
    return out.withColumn("stalled", (F.unix_timestamp(as_of) - F.unix_timestamp("last_grown")) > stall_hours * 3600)


def split_keys(entities: DataFrame) -> DataFrame:
    """Keys that stand under more than one type."""
    return entities.groupBy("canonical_key").agg(F.count_distinct("type").alias("n_types")).where("n_types > 1")


def integrity(entities: DataFrame, edges: DataFrame, mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(counter, value): sizes, split keys, dangling references and self-loops."""
    ids = entities.select("id")
    dangling = lambda df, c: df.join(ids, df[c] == ids["id"], "left_anti")
    parts = {"entities": entities, "edges": edges, "mentions": mentions, "split_type_keys": split_keys(entities), "dangling_edge_src": dangling(edges, "src_id"), "dangling_edge_dst": dangling(edges, "dst_id"),
             "dangling_mentions": dangling(mentions, "entity_id"), "dangling_aliases": dangling(aliases, "entity_id"), "self_loop_edges": edges.where("src_id = dst_id")}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("counter"), F.count(F.lit(1)).alias("value"))
        out = row if out is None else out.unionAll(row)
    return out


def type_tier(type_: Column, confidence: Column) -> Column:
    """How much a type is worth: proven shapes, named things, the bucket for names, propositions, unproven shapes."""
    proven = F.coalesce(confidence, F.lit(0.0)) >= PROVEN
    return F.when(type_.isin(*SHAPE_TYPES) & proven, 4).when(type_.isin(*SHAPE_TYPES), 0).when(type_ == "org", 2).when(type_.isin(*NAMED_ORDER), 3).otherwise(1)


def merge_plan(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(loser_id, winner_id, blocked) for every key under several types.

    The winner has the highest tier, then proof, mentions, confidence, fixed order of named types, smallest id. Two
    well attested names that share no document are left apart.
    """
    tier = type_tier(F.col("type"), F.col("confidence"))
    proven = (F.coalesce("confidence", F.lit(0.0)) >= PROVEN).cast("int")
    order = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in NAMED_ORDER.items() for x in kv)), F.col("type")), F.lit(0))
    rank = F.struct(tier.alias("t"), proven.alias("p"), F.col("mention_count").alias("m"), F.coalesce("confidence", F.lit(0.0)).alias("c"), order.alias("o"), (-F.col("id")).alias("i"))
    split = entities.join(split_keys(entities).select("canonical_key"), "canonical_key", "left_semi")
    best = split.groupBy("canonical_key").agg(F.max_by(F.struct("id", "type", "mention_count"), rank).alias("w"))
    pairs = split.join(best, "canonical_key").where("id <> w.id").select(F.col("id").alias("loser_id"), F.col("w.id").alias("winner_id"), F.col("type").alias("loser_type"), F.col("w.type").alias("winner_type"),
                                                                         F.col("mention_count").alias("loser_mentions"), F.col("w.mention_count").alias("winner_mentions"))
    docs = mentions.select("entity_id", "doc_id").distinct()
    shared = (pairs.select("loser_id", "winner_id").join(docs.withColumnRenamed("entity_id", "loser_id"), "loser_id")
              .join(docs.withColumnRenamed("entity_id", "winner_id"), ["winner_id", "doc_id"]).select("loser_id", "winner_id").distinct().withColumn("shares", F.lit(True)))
    named = [*NAMED_ORDER, "org"]
    apart = F.col("loser_type").isin(*named) & F.col("winner_type").isin(*named) & (F.col("loser_mentions") >= CORROBORATED) & (F.col("winner_mentions") >= CORROBORATED)
    return pairs.join(shared, ["loser_id", "winner_id"], "left").select("loser_id", "winner_id", "loser_type", "winner_type", (apart & ~F.coalesce("shares", F.lit(False))).alias("blocked"))


def folded(entities: DataFrame, edges: DataFrame, mentions: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, edges and mentions after the merges that are not blocked: references follow, collisions and self-loops go."""
    moves = plan.where("not blocked").select("loser_id", "winner_id")

    def follow(df: DataFrame, column: str) -> DataFrame:
        m = moves.select(F.col("loser_id").alias(column), F.col("winner_id").alias("_to"))
        return df.join(m, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

    new_mentions = follow(mentions, "entity_id").groupBy("entity_id", "doc_id").agg(F.max("confidence").alias("confidence"))
    moved = follow(follow(edges, "src_id"), "dst_id").where("src_id <> dst_id")
    keep = F.row_number().over(Window.partitionBy("src_id", "dst_id", "predicate", "doc_id").orderBy(F.desc("weight"), F.desc("confidence"), "extractor"))
    new_edges = moved.withColumn("_n", keep).where("_n = 1").drop("_n")
    lost = entities.join(moves.select(F.col("loser_id").alias("id"), "winner_id"), "id").groupBy(F.col("winner_id").alias("id")).agg(F.max("confidence").alias("c"))
    counts = new_mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    new_entities = (entities.join(moves.select(F.col("loser_id").alias("id")), "id", "left_anti").join(lost, "id", "left").join(counts, "id", "left")
                    .withColumn("confidence", F.greatest(F.coalesce("confidence", F.lit(0.0)), F.coalesce("c", F.lit(0.0)))).withColumn("mention_count", F.coalesce("m", F.lit(0))).drop("c", "m"))
    return new_entities, new_edges, new_mentions


def folded_aliases(aliases: DataFrame, plan: DataFrame) -> DataFrame:
    """Aliases (entity_id, alias, alias_key) after the merges that are not blocked; of one key's spellings the smallest stays."""
    moves = plan.where("not blocked").select(F.col("loser_id").alias("entity_id"), "winner_id")
    moved = aliases.join(moves, "entity_id", "left").withColumn("entity_id", F.coalesce("winner_id", "entity_id"))
    return moved.groupBy("entity_id", "alias_key").agg(F.min("alias").alias("alias")).select("entity_id", "alias", "alias_key")


def forgotten(entities: DataFrame, edges: DataFrame, mentions: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without some documents (doc_id), and without entities that nothing mentions any more."""
    gone = docs.select("doc_id").distinct()
    left_mentions = mentions.join(gone, "doc_id", "left_anti")
    left_edges = edges.join(gone, "doc_id", "left_anti")
    ends = undirected(left_edges).select(F.col("node").alias("id")).union(left_mentions.select(F.col("entity_id").alias("id"))).distinct()
    return entities.join(ends, "id", "left_semi"), left_edges, left_mentions


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): what an upsert would insert, update, delete or leave."""
    both = old.select(F.col(key), F.col(value).alias("_o"), F.lit(True).alias("_in_old")).join(new.select(F.col(key), F.col(value).alias("_n"), F.lit(True).alias("_in_new")), key, "full_outer")
    change = F.when(F.col("_in_old").isNull(), "insert").when(F.col("_in_new").isNull(), "delete").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("update")
    return both.select(key, change.alias("change"))


def merged_view(nodes: DataFrame, edges: DataFrame, hidden_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes once by id, edges once by their unordered ends and predicate; edges of hidden nodes go too."""
    seen = nodes.dropDuplicates(["id"])
    if hidden_types:
        seen = seen.where(~F.col("type").isin(*hidden_types))
    once = edges.withColumns({"low": F.least("src_id", "dst_id"), "high": F.greatest("src_id", "dst_id")}).groupBy("low", "high", "predicate").agg(F.max("weight").alias("weight"))
    ids = seen.select("id")
    return seen, once.join(ids, once["low"] == ids["id"], "left_semi").join(ids, F.col("high") == ids["id"], "left_semi")


def grounded_triples(triples: DataFrame, docs: DataFrame, most: int = 24) -> DataFrame:
    """Triples (doc_id, n, subject, subject_type, predicate, object, object_type) that their document's text bears out.

    Unknown vocabulary, labels outside 2..80 characters, self-loops, repeats and labels that the text does not hold go;
    labels that recur give 0.8 confidence, others 0.6.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    t = triples.withColumns({"s": norm(F.col("subject")), "o": norm(F.col("object")), "predicate": F.replace(F.upper(F.trim("predicate")), F.lit(" "), F.lit("_")),
                             "subject_type": F.lower("subject_type"), "object_type": F.lower("object_type")})
    ok = F.col("predicate").isin(*PREDICATES) & F.col("subject_type").isin(*ENTITY_TYPES) & F.col("object_type").isin(*ENTITY_TYPES)
    ok = ok & F.length(F.trim("subject")).between(2, 80) & F.length(F.trim("object")).between(2, 80) & (F.col("s") != F.col("o"))
    met = t.where(ok).join(docs.select("doc_id", norm(F.col("text")).alias("_text")), "doc_id")
    met = met.where(F.contains("_text", F.col("s")) & F.contains("_text", F.col("o")))
    times = lambda c: ((F.length("_text") - F.length(F.replace(F.col("_text"), c, F.lit("")))) / F.length(c)).cast("int")
    first = F.row_number().over(Window.partitionBy("doc_id", "s", "predicate", "o").orderBy("n"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))
    confidence = F.when(F.least(times(F.col("s")), times(F.col("o"))) >= 2, 0.8).otherwise(0.6)
    met = met.withColumn("confidence", confidence).withColumn("_f", first).where("_f = 1").withColumn("_k", nth).where(F.col("_k") <= most)
    return met.select("doc_id", "subject", "subject_type", "predicate", "object", "object_type", "confidence")


def persisted_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of grounded triples; a label without a key drops its triple, not its document."""
    end = lambda label, type_: F.struct(ascii_key(F.col(label)).alias("canonical_key"), F.col(type_).alias("type"), F.trim(label).alias("label"))
    keyed = triples.select(F.col("doc_id").cast("string").alias("doc_id"), "predicate", "confidence", end("subject", "subject_type").alias("s"), end("object", "object_type").alias("o"))
    keyed = keyed.where("s.canonical_key <> '' and o.canonical_key <> ''")
    entities = entities_from_mentions(keyed.select("doc_id", "confidence", F.explode(F.array("s", "o")).alias("e")).select("doc_id", "confidence", "e.*"))
    node = lambda e: scores.point_id(F.concat_ws("|", f"{e}.canonical_key", f"{e}.type"))
    edges = keyed.select(node("s").alias("src_id"), node("o").alias("dst_id"), "predicate", "doc_id", "confidence", F.lit(1.0).alias("weight"), F.lit("llm").alias("extractor"),
                         F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("timestamp").alias("asserted_at"))
    return entities, asserted(edges)


def representative_chunks(chunks: DataFrame, k: int, least_chars: int = 120) -> DataFrame:
    """Of each document the k chunks (doc_id, chunk_index, text) that are long enough and name most, in document order."""
    from sparkloom.operators.entities import CANDIDATE

    named = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(1))))
    order = [F.desc(F.length("text") >= least_chars), F.desc(named), F.desc(F.length("text")), F.asc("chunk_index")]
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def walk_page(steps: DataFrame, entities: DataFrame, limit: int = 100) -> DataFrame:
    """A walk's first steps: near ones first, then often mentioned ones."""
    named = steps.join(entities.select("id", "label", "type", "mention_count"), "id")
    return named.orderBy("hop", F.desc("mention_count"), "id", "predicate", "doc_id", "via").limit(limit)


def runs_behind(edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """(src_id, dst_id, session) of edges whose provenance is a run."""
    runs = edges.where(F.startswith("doc_id", F.lit("run:"))).select("src_id", "dst_id", F.substring("doc_id", 5, F.lit(1 << 30)).alias("id"))
    return runs.join(sessions.select("id", "started_at"), "id")


def shown_labels(edges: DataFrame, per_predicate: int = 2, most: int = 8) -> DataFrame:
    """The edges that get a label: the heaviest of each predicate, few in all."""
    nth = F.row_number().over(Window.partitionBy("predicate").orderBy(F.desc("weight"), "src_id", "dst_id"))
    return edges.withColumn("nth", nth).where(F.col("nth") <= per_predicate).orderBy(F.desc("weight"), "predicate", "src_id", "dst_id").limit(most)


def find_labels(entities: DataFrame, text: str, least: int = 2) -> DataFrame:
    """Entities whose label holds a text, whatever its case; none for a text of fewer than ``least`` characters."""
    wanted = text.strip().lower()
    return entities.where(F.contains(F.lower("label"), F.lit(wanted)) if len(wanted) >= least else F.lit(False))
