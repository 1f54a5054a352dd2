"""The graph of names in documents, and what is read from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalog.base import LETTERS_SQL, ORACLE_SQL, as_of, query, quoted, stored, version
from sparkloom.functions import scores
from sparkloom.functions.identity import ascii_label
from sparkloom.operators import entities as ents
from sparkloom.operators import graph
from sparkloom.operators.components import connected_components
from sparkloom.session import cut, new_folder, table
from sparkloom.streaming.backfill import Backfill
from sparkloom.streaming.corpus import Corpus

_MASKED = "text"
for _p in [p for _, p, _ in ents.TYPED] + [ents.MONEY]:
    _MASKED = f"regexp_replace({_MASKED}, {quoted(_p)}, ' ', 'g')"
_EDGE = "|".join(ents.EDGE_WORDS)
_TRIM = f"trim(regexp_replace(regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), '(?i)^(?:(?:{_EDGE})(?:''s)?(?:\\s+|$))+', ''), '(?i)(?:(?:^|\\s+)(?:{_EDGE})(?:''s)?)+$', ''))"
_KEY = r"trim(regexp_replace(lower(regexp_replace({}, '''s\b|''$', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_LABEL = r"""regexp_replace(trim(regexp_replace(regexp_replace(trim({}), '''s\b|''$', '', 'g'), '\s+', ' ', 'g')), '^[ ,.;:!?''"-]+|[ ,.;:!?''"-]+$', '', 'g')"""
_STOP = ", ".join(f"'{w}'" for w in ents.EDGE_WORDS)

_CANDIDATES = rf"""{LETTERS_SQL}, clean AS (SELECT doc_id, {_MASKED} AS text FROM letter_docs),
lines AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS ln FROM clean),
raw_hits AS (SELECT doc_id, ln, line, unnest(regexp_extract_all(line, {quoted(ents.CANDIDATE)}, 1)) AS raw, generate_subscripts(regexp_extract_all(line, {quoted(ents.CANDIDATE)}, 1), 1) AS nth FROM lines),
named AS (SELECT doc_id, ln, nth, regexp_matches(line, {quoted(ents.HEADING)}) OR (ends_with(trim(line), ':') AND length(trim(line)) BETWEEN 1 AND 60) AS heading, {_TRIM} AS surface FROM raw_hits),
keyed AS (SELECT *, {_KEY.format('surface')} AS canonical_key FROM named),
real_keys AS (SELECT * FROM keyed WHERE length(canonical_key) >= 3 AND NOT regexp_matches(canonical_key, '^\d+$') AND len(list_filter(string_split(canonical_key, ' '), lambda w: w NOT IN ({_STOP}))) > 0),
per AS (SELECT doc_id, canonical_key, count(*) AS n, bool_or(heading) AS heading, bool_or(surface = upper(surface) AND regexp_matches(surface, '[A-Z]')) AS allcaps, arg_min(surface, (ln, nth)) AS surface FROM real_keys GROUP BY doc_id, canonical_key),
lowered AS (SELECT doc_id, w AS canonical_key, count(*) AS n_lower FROM (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(ents.LOWER_TOKEN)}, 1)) AS w FROM clean) GROUP BY doc_id, w),
candidates AS (SELECT p.doc_id, p.canonical_key, p.n, p.heading, p.allcaps, p.surface, CASE WHEN p.n >= 2 AND contains(p.canonical_key, ' ') THEN 0.85 WHEN p.n >= 2 THEN 0.75 ELSE 0.7 END::DOUBLE AS confidence
  FROM per p LEFT JOIN lowered l USING (doc_id, canonical_key) WHERE (p.n >= 2 OR p.heading) AND (contains(p.canonical_key, ' ') OR p.allcaps OR coalesce(l.n_lower, 0) <= p.n))"""
_TYPED = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, {quoted(p)})) AS surface, '{k}' AS type, {c}::DOUBLE AS confidence FROM letter_docs" for k, p, c in ents.TYPED)
_MENTIONS = rf"""{_CANDIDATES}, typed AS ({_TYPED}),
every AS (SELECT doc_id, {_KEY.format('surface')} AS canonical_key, type, {_LABEL.format('surface')} AS label, confidence FROM typed
  UNION ALL SELECT doc_id, canonical_key, 'org', {_LABEL.format('surface')}, confidence FROM candidates),
one AS (SELECT doc_id, canonical_key, type, min(label) AS label, max(confidence) AS confidence FROM every WHERE length(label) BETWEEN 2 AND 60 GROUP BY doc_id, canonical_key, type),
ranked_mentions AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, label, type) AS nth FROM one WHERE confidence >= 0.55),
mentions AS (SELECT doc_id, canonical_key, type, label, confidence, (('0x' || substr(sha256(canonical_key || '|' || type), 1, 16))::UBIGINT >> 1)::BIGINT AS entity_id FROM ranked_mentions WHERE nth <= 200)"""
_ENTITIES = f"{_MENTIONS}, entities AS (SELECT entity_id AS id, canonical_key, type, min(label) AS label, max(confidence) AS confidence, count(DISTINCT doc_id) AS mention_count FROM mentions GROUP BY entity_id, canonical_key, type)"
_PAIRS = f"""{_ENTITIES}, tops AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, label, entity_id) AS r FROM mentions),
pairs AS (SELECT DISTINCT x.doc_id, least(x.entity_id, y.entity_id) AS a, greatest(x.entity_id, y.entity_id) AS b FROM tops x JOIN tops y ON x.doc_id = y.doc_id AND ((x.r < y.r AND y.r <= 10) OR (x.r = 1 AND y.r > 10)) WHERE x.entity_id <> y.entity_id)"""
_EDGES = f"""{_PAIRS}, corpus AS (SELECT count(DISTINCT doc_id) AS n FROM mentions), dfs AS (SELECT entity_id, count(DISTINCT doc_id) AS df FROM mentions GROUP BY entity_id),
both_docs AS (SELECT a, b, count(DISTINCT doc_id) AS n_ab FROM pairs GROUP BY a, b),
mined AS (SELECT a, b, n_ab, round(greatest(0, log2(n_ab::DOUBLE * n / (x.df::DOUBLE * y.df))), 4) AS weight,
  CASE WHEN n_ab >= n THEN 0.0 ELSE round(least(1, greatest(0, greatest(0, log2(n_ab::DOUBLE * n / (x.df::DOUBLE * y.df))) / -log2(n_ab::DOUBLE / n))), 4) END AS confidence
  FROM both_docs JOIN dfs x ON x.entity_id = a JOIN dfs y ON y.entity_id = b, corpus WHERE n >= 2),
edges AS (SELECT p.a AS src_id, p.b AS dst_id, 'CO_ACTIVITY' AS predicate, p.doc_id::VARCHAR AS doc_id, m.weight, m.confidence, 'pmi' AS extractor, TIMESTAMP '2024-01-01' + to_minutes(p.doc_id) AS asserted_at FROM pairs p JOIN mined m USING (a, b))"""


def _candidates(spark, sf_dir):
    return stored(spark, sf_dir, "candidates", lambda: ents.name_candidates(table(spark, sf_dir, "documents"), ents.EDGE_WORDS))


def _mentions(spark, sf_dir):
    """Mentions as an ingest stores them; written once a session."""
    def build():
        found = ents.mentions(table(spark, sf_dir, "documents"), ents.EDGE_WORDS, candidates=_candidates(spark, sf_dir))
        return found.withColumn("entity_id", scores.point_id(F.concat_ws("|", "canonical_key", "type")))

    return stored(spark, sf_dir, "mentions", build)


def _pairs(spark, sf_dir):
    return stored(spark, sf_dir, "pairs", lambda: graph.co_mentions(_mentions(spark, sf_dir)))


def _graph(spark, sf_dir):
    """Entities, edges and mentions."""
    mentions = _mentions(spark, sf_dir)

    def build():
        pairs = _pairs(spark, sf_dir)
        mined = graph.mined(mentions, pairs)
        return pairs.join(mined, ["a", "b"]).select(F.col("a").alias("src_id"), F.col("b").alias("dst_id"), F.lit("CO_ACTIVITY").alias("predicate"), F.col("doc_id").cast("string").alias("doc_id"), "weight", "confidence",
                                                    F.lit("pmi").alias("extractor"), F.lit(None).cast("string").alias("chunk_id"), F.timestamp_add("minute", F.col("doc_id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("asserted_at"))

    return graph.entities_from_mentions(mentions), stored(spark, sf_dir, "edges", build), mentions


@query("a21_candidates", f"WITH {_CANDIDATES} SELECT doc_id, canonical_key, n, heading, allcaps, surface, confidence FROM candidates")
def a21_candidates(spark, sf_dir):
    found = _candidates(spark, sf_dir)
    return found.select("doc_id", "canonical_key", "n", "heading", "allcaps", F.get("surfaces", 0).alias("surface"), "confidence")


@query("a22_entities", f"WITH {_ENTITIES} SELECT id, canonical_key, type, label, confidence, mention_count FROM entities")
def a22_entities(spark, sf_dir):
    return graph.entities_from_mentions(_mentions(spark, sf_dir)).select("id", "canonical_key", "type", "label", "confidence", "mention_count")


@query("g10_pairs", f"WITH {_PAIRS} SELECT doc_id, a, b FROM pairs")
def g10_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("g11_pmi", f"WITH {_EDGES} SELECT a, b, n_ab, weight, confidence FROM mined")
def g11_pmi(spark, sf_dir):
    return graph.mined(_mentions(spark, sf_dir), _pairs(spark, sf_dir))


_CORPORA: dict[tuple[str, ...], Corpus] = {}
_TAKEN = "(SELECT doc_id, CASE WHEN source = 'src1' THEN 'Replaced Text. Replaced Text ' || lang ELSE text END AS text FROM documents WHERE source <> 'src2')"


def _corpus(spark, sf_dir):
    """All documents as one batch, of which those of one source have no valid date; then new texts for those of another source."""
    key = (spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir))
    if key not in _CORPORA:
        docs = table(spark, sf_dir, "documents")
        rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), F.col("source").alias("source_file"), F.when(F.col("source") == "src2", "soon").otherwise("2024-01-01").alias("created_at"), "text", "lang", "source")
        _CORPORA[key] = Corpus(spark, new_folder(spark, "corpus"))
        _CORPORA[key].take(rows, "all")
        _CORPORA[key].take(rows.where("source = 'src1'").withColumns({"text": F.concat(F.lit("Replaced Text. Replaced Text "), "lang"), "created_at": F.lit("2024-01-02")}), "replaced")
    return _CORPORA[key]


@query("g01_ingested_edges", "WITH " + _EDGES.replace("FROM documents)", f"FROM {_TAKEN})", 1) + " SELECT src_id, dst_id, doc_id, weight, confidence FROM edges")
def g01_ingested_edges(spark, sf_dir):
    """Edges of documents that came in two batches; their weights come from counts that the second one has changed by differences."""
    return _corpus(spark, sf_dir).edges().select("src_id", "dst_id", "doc_id", "weight", "confidence")


@query("s05_failed_documents", "SELECT doc_id::VARCHAR AS doc_id, 'read' AS stage, 'created_at is not a date' AS reason FROM documents WHERE source = 'src2' AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' UNION ALL SELECT doc_id::VARCHAR, 'read', 'blank' FROM documents WHERE source <> 'src1' AND trim(regexp_replace(text, '\\s+', ' ', 'g')) = ''")
def s05_failed_documents(spark, sf_dir):
    return _corpus(spark, sf_dir).failures()


@query("s05_ingest_report", "SELECT count(*) FILTER (source <> 'src2' AND (source = 'src1' OR NOT blank)) AS documents, count(*) FILTER (source = 'src2' OR (source <> 'src1' AND blank)) AS failed FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' AS blank FROM documents)")
def s05_ingest_report(spark, sf_dir):
    return _corpus(spark, sf_dir).report().select("documents", "failed")


_TOP = "degree AS (SELECT id, sum(w::DECIMAL(18,4))::DOUBLE AS degree FROM (SELECT src_id AS id, weight AS w FROM edges UNION ALL SELECT dst_id, weight FROM edges) GROUP BY id), top AS (SELECT e.id, e.label, e.type, round(coalesce(d.degree, 0) * CASE e.type WHEN 'date' THEN 0.25 WHEN 'marker' THEN 0.25 WHEN 'lock' THEN 0.5 WHEN 'slice' THEN 0.5 ELSE 1.0 END, 3) AS score, e.confidence, e.mention_count FROM entities e LEFT JOIN degree d USING (id) ORDER BY score DESC, mention_count DESC, e.confidence DESC, e.id LIMIT 50)"


@query("g13_top_entities", f"WITH {_EDGES}, {_TOP} SELECT id, label, type, score, mention_count FROM top")
def g13_top_entities(spark, sf_dir):
    entities, edges, _ = _graph(spark, sf_dir)
    return graph.top_entities(entities, edges).select("id", "label", "type", "score", "mention_count")


@query("g14_panel", f"""WITH {_EDGES}, {_TOP} SELECT src_id, dst_id, predicate, round(sum(weight::DECIMAL(18,4))::DOUBLE, 3) AS weight, max(confidence) AS confidence, count(*) AS sources FROM edges
WHERE src_id IN (SELECT id FROM top) AND dst_id IN (SELECT id FROM top) GROUP BY src_id, dst_id, predicate ORDER BY weight DESC, src_id, dst_id LIMIT 400""")  # fmt: skip
def g14_panel(spark, sf_dir):
    entities, edges, _ = _graph(spark, sf_dir)
    nodes = cut(graph.top_entities(entities, edges))
    return graph.panel_edges(nodes, edges).select("src_id", "dst_id", "predicate", "weight", "confidence", "sources")


_WAYS = "ways AS (SELECT src_id AS node, dst_id AS other, predicate, doc_id, extractor FROM edges UNION ALL SELECT dst_id, src_id, predicate, doc_id, extractor FROM edges)"
_START = "starts AS (SELECT id FROM entities ORDER BY mention_count DESC, id LIMIT 3)"


@query("g15_walk", f"""WITH {_EDGES}, {_WAYS}, {_START},
one_hop AS (SELECT DISTINCT s.id AS start, w.other AS id, w.doc_id, w.node AS via FROM starts s JOIN ways w ON w.node = s.id),
two_hop AS (SELECT DISTINCT o.start, w.other AS id, w.doc_id, w.node AS via FROM (SELECT DISTINCT start, id FROM one_hop) o JOIN ways w ON w.node = o.id)
SELECT start, id, hop, doc_id, via FROM (SELECT *, 1 AS hop FROM one_hop UNION ALL SELECT *, 2 FROM two_hop) WHERE id <> start""")  # fmt: skip
def g15_walk(spark, sf_dir):
    entities, edges, _ = _graph(spark, sf_dir)
    starts = entities.orderBy(F.desc("mention_count"), "id").limit(3)
    return graph.walk(starts, edges, 2).select("start", "id", "hop", "doc_id", "via")


@query("g16_related", f"""WITH {_EDGES}, {_START}, near AS (SELECT src_id AS node, dst_id AS other, 'out' AS direction, weight, confidence, predicate, doc_id FROM edges UNION ALL SELECT dst_id, src_id, 'in', weight, confidence, predicate, doc_id FROM edges)
SELECT node, other, direction, weight, nth FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, confidence DESC, other, predicate, direction) AS nth FROM near WHERE node IN (SELECT id FROM starts)) WHERE nth <= 25""")  # fmt: skip
def g16_related(spark, sf_dir):
    entities, edges, _ = _graph(spark, sf_dir)
    return graph.related(entities.orderBy(F.desc("mention_count"), "id").limit(3), edges).select("node", "other", "direction", "weight", "nth")


def _aliases(spark, sf_dir):
    flat = _candidates(spark, sf_dir).select("canonical_key", F.explode("surfaces").alias("alias")).distinct()
    return flat.select(scores.point_id(F.concat_ws("|", "canonical_key", F.lit("org"))).alias("entity_id"), "alias", F.lower(F.trim("alias")).alias("alias_key"))


@query("g17_profile")
def g17_profile(spark, sf_dir):
    entities, edges, _ = _graph(spark, sf_dir)
    wanted = entities.orderBy(F.desc("mention_count"), "id").limit(20).select(ascii_label(F.col("label")).alias("name"))
    out = graph.profile(entities, _aliases(spark, sf_dir), edges, wanted)
    return out.select("id", "canonical_key", "type", F.array_join("aliases", "|").alias("aliases"), "n_edges")


@query("g19_health", f"WITH {_EDGES} SELECT extractor, count(*) AS edges, max(asserted_at) AS last_grown, epoch(TIMESTAMP '2024-01-30') - epoch(max(asserted_at)) > 86400 AS stalled FROM edges GROUP BY extractor")
def g19_health(spark, sf_dir):
    _, edges, _ = _graph(spark, sf_dir)
    return graph.health(edges, as_of())


@query("g12_co_retrieved", f"""WITH {_ENTITIES}, runs AS (SELECT DISTINCT d.source AS run_id, d.doc_id FROM documents d),
met AS (SELECT DISTINCT r.run_id, m.entity_id FROM runs r JOIN mentions m USING (doc_id)), top8 AS (SELECT m.run_id, m.entity_id, row_number() OVER (PARTITION BY m.run_id ORDER BY e.confidence DESC, m.entity_id) AS nth FROM met m JOIN entities e ON e.id = m.entity_id QUALIFY nth <= 8)
SELECT x.entity_id AS src_id, y.entity_id AS dst_id, 'run:' || x.run_id AS doc_id FROM top8 x JOIN top8 y ON x.run_id = y.run_id AND x.entity_id < y.entity_id""")  # fmt: skip
def g12_co_retrieved(spark, sf_dir):
    """Each run takes all documents of its source."""
    mentions = _mentions(spark, sf_dir)
    runs = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), "doc_id")
    return graph.co_retrieved(mentions, graph.entities_from_mentions(mentions), runs).select("src_id", "dst_id", "doc_id")


query("g12_co_retrieved_whole", ORACLE_SQL["g12_co_retrieved"])(g12_co_retrieved)


_PEOPLE = """split AS (SELECT key, type, sum(n)::BIGINT AS mention_count, max(conf) AS confidence FROM (
  SELECT DISTINCT p_name AS key, CASE p_type WHEN 'PROMO' THEN 'person' WHEN 'LARGE' THEN 'product' WHEN 'ECONOMY' THEN 'org' ELSE 'marker' END AS type, 1 AS n, p_partkey, CASE WHEN p_size > 45 THEN 0.95 ELSE 0.6 END AS conf FROM part) GROUP BY key, type),
nodes AS (SELECT (('0x' || substr(sha256(key || '|' || type), 1, 16))::UBIGINT >> 1)::BIGINT AS id, key AS canonical_key, type, mention_count, confidence FROM split)"""


def _parts(spark, sf_dir):
    """Part names under the types that their kind stands for; a part mentions its brand's document."""
    kind = F.when(F.col("p_type") == "PROMO", "person").when(F.col("p_type") == "LARGE", "product").when(F.col("p_type") == "ECONOMY", "org").otherwise("marker")
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("canonical_key"), kind.alias("type"), F.when(F.col("p_size") > 45, 0.95).otherwise(0.6).alias("confidence"), F.col("p_brand").alias("doc_id"))
    rows = rows.withColumn("entity_id", scores.point_id(F.concat_ws("|", "canonical_key", "type")))
    nodes = rows.groupBy(F.col("entity_id").alias("id"), "canonical_key", "type").agg(F.count(F.lit(1)).alias("mention_count"), F.max("confidence").alias("confidence"))
    return nodes.withColumn("label", F.col("canonical_key")), rows.select("entity_id", "doc_id", "confidence").distinct()


@query("a17_split_keys", f"WITH {_PEOPLE} SELECT canonical_key, count(DISTINCT type) AS n_types FROM nodes GROUP BY canonical_key HAVING count(DISTINCT type) > 1")
def a17_split_keys(spark, sf_dir):
    return graph.split_keys(_parts(spark, sf_dir)[0])


_PLAN = f"""{_PEOPLE}, docs AS (SELECT DISTINCT (('0x' || substr(sha256(p_name || '|' || CASE p_type WHEN 'PROMO' THEN 'person' WHEN 'LARGE' THEN 'product' WHEN 'ECONOMY' THEN 'org' ELSE 'marker' END), 1, 16))::UBIGINT >> 1)::BIGINT AS id, p_brand AS doc FROM part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY CASE WHEN type = 'marker' AND confidence >= 0.9 THEN 4 WHEN type = 'marker' THEN 0 WHEN type = 'org' THEN 2 ELSE 3 END DESC,
  (confidence >= 0.9)::INT DESC, mention_count DESC, confidence DESC, CASE type WHEN 'product' THEN 4 WHEN 'person' THEN 3 ELSE 0 END DESC, id) AS r, count(*) OVER (PARTITION BY canonical_key) AS k FROM nodes),
plan AS (SELECT l.id AS loser_id, w.id AS winner_id, l.type AS loser_type, w.type AS winner_type, (l.type <> 'marker' AND w.type <> 'marker' AND l.mention_count >= 3 AND w.mention_count >= 3
  AND NOT EXISTS (SELECT 1 FROM docs a JOIN docs b ON a.doc = b.doc WHERE a.id = l.id AND b.id = w.id)) AS blocked FROM ranked l JOIN ranked w ON l.canonical_key = w.canonical_key AND w.r = 1 WHERE l.r > 1),
moves AS (SELECT loser_id, winner_id FROM plan WHERE NOT blocked)"""


@query("g06_merge_plan", f"WITH {_PLAN} SELECT * FROM plan")
def g06_merge_plan(spark, sf_dir):
    return graph.merge_plan(*_parts(spark, sf_dir))


@query("g05_folded", f"""WITH {_PLAN}, m AS (SELECT DISTINCT coalesce(winner_id, id) AS id, doc FROM docs LEFT JOIN moves ON id = loser_id)
SELECT n.id, n.canonical_key, n.type, greatest(n.confidence, coalesce(l.c, 0))::DOUBLE AS confidence, coalesce(k.m, 0) AS mention_count FROM nodes n
LEFT JOIN (SELECT winner_id, max(confidence) AS c FROM moves JOIN nodes ON id = loser_id GROUP BY winner_id) l ON l.winner_id = n.id LEFT JOIN (SELECT id, count(*) AS m FROM m GROUP BY id) k ON k.id = n.id
WHERE n.id NOT IN (SELECT loser_id FROM moves)""")  # fmt: skip
def g05_folded(spark, sf_dir):
    nodes, mentions = _parts(spark, sf_dir)
    none = spark.createDataFrame([], "src_id long, dst_id long, predicate string, confidence double, weight double, doc_id string, chunk_id string, extractor string, asserted_at timestamp")
    return graph.folded(nodes, none, mentions, graph.merge_plan(nodes, mentions))[0].select("id", "canonical_key", "type", "confidence", "mention_count")


@query("a18_integrity", f"""WITH {_PEOPLE}, edges AS (SELECT l_partkey AS src_id, l_suppkey AS dst_id FROM lineitem), ids AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 7 <> 0)
SELECT 'entities' AS counter, (SELECT count(*) FROM ids) AS value UNION ALL SELECT 'edges', (SELECT count(*) FROM edges) UNION ALL SELECT 'mentions', (SELECT count(*) FROM orders) UNION ALL SELECT 'split_type_keys', (SELECT count(*) FROM (SELECT p_name FROM part WHERE p_partkey % 7 <> 0 GROUP BY p_name HAVING count(DISTINCT p_type) > 1))
UNION ALL SELECT 'dangling_edge_src', (SELECT count(*) FROM edges WHERE src_id NOT IN (SELECT id FROM ids)) UNION ALL SELECT 'dangling_edge_dst', (SELECT count(*) FROM edges WHERE dst_id NOT IN (SELECT id FROM ids))
UNION ALL SELECT 'dangling_mentions', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT id FROM ids)) UNION ALL SELECT 'dangling_aliases', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT id FROM ids))
UNION ALL SELECT 'self_loop_edges', (SELECT count(*) FROM edges WHERE src_id = dst_id)""")  # fmt: skip
def a18_integrity(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("canonical_key"), F.col("p_type").alias("type"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src_id"), F.col("l_suppkey").alias("dst_id"))
    mentions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"))
    return graph.integrity(nodes, edges, mentions, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id")))


_ASSERTED = "calls AS (SELECT l_suppkey AS src_id, l_partkey % 50 AS dst_id, CASE l_linestatus WHEN 'O' THEN 'OWNS' WHEN 'F' THEN 'BLOCKS' END AS predicate, CASE WHEN l_linenumber = 7 THEN 'oracle' ELSE 'regex' END AS extractor, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_returnflag END AS doc_id, l_discount AS confidence, 1.0 AS weight FROM lineitem)"


def _assertions(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_suppkey").alias("src_id"), (F.col("l_partkey") % 50).alias("dst_id"), F.when(F.col("l_linestatus") == "O", "OWNS").when(F.col("l_linestatus") == "F", "BLOCKS").alias("predicate"),
                        F.when(F.col("l_linenumber") == 7, "oracle").otherwise("regex").alias("extractor"), F.when(F.col("l_linenumber") != 6, F.col("l_returnflag")).alias("doc_id"),
                        F.col("l_discount").alias("confidence"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("timestamp").alias("asserted_at"))


@query("g09_asserted", f"WITH {_ASSERTED} SELECT src_id, dst_id, predicate, doc_id, sum(weight)::DOUBLE AS weight, max(confidence) AS confidence FROM calls WHERE predicate IS NOT NULL AND extractor = 'regex' AND doc_id IS NOT NULL AND src_id <> dst_id GROUP BY ALL")
def g09_asserted(spark, sf_dir):
    return graph.asserted(_assertions(spark, sf_dir)).select("src_id", "dst_id", "predicate", "doc_id", "weight", "confidence")


@query("g09_refused", f"WITH {_ASSERTED} SELECT CASE WHEN predicate IS NULL THEN 'unknown predicate' WHEN extractor <> 'regex' THEN 'unknown extractor' WHEN src_id = dst_id THEN 'self-loop' ELSE 'no provenance' END AS reason, count(*) AS n FROM calls WHERE NOT (predicate IS NOT NULL AND extractor = 'regex' AND doc_id IS NOT NULL AND src_id <> dst_id) GROUP BY 1")
def g09_refused(spark, sf_dir):
    return graph.refused(_assertions(spark, sf_dir)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("g07_forgotten", f"""WITH {_EDGES}, gone AS (SELECT doc_id FROM documents WHERE source = 'src1'), m AS (SELECT * FROM mentions WHERE doc_id NOT IN (SELECT doc_id FROM gone)), e AS (SELECT * FROM edges WHERE doc_id::BIGINT NOT IN (SELECT doc_id FROM gone))
SELECT id, canonical_key FROM entities WHERE id IN (SELECT entity_id FROM m UNION SELECT src_id FROM e UNION SELECT dst_id FROM e)""")  # fmt: skip
def g07_forgotten(spark, sf_dir):
    entities, edges, mentions = _graph(spark, sf_dir)
    gone = table(spark, sf_dir, "documents").where("source = 'src1'").select(F.col("doc_id").cast("string").alias("doc_id"))
    return graph.forgotten(entities, edges, mentions.withColumn("doc_id", F.col("doc_id").cast("string")), gone)[0].select("id", "canonical_key")


@query("j21_changes", """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'delete' WHEN o.v = n.v THEN 'same' ELSE 'update' END AS change FROM o FULL JOIN n ON o.k = n.k""")  # fmt: skip
def j21_changes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    new = orders.where("k % 7 <> 0").withColumn("v", F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("v")))
    return graph.changes(orders.where("k % 5 <> 0"), new, "k", "v")


@query("j22_todo", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j22_todo(spark, sf_dir):
    settled = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(settled, "doc_id", "left_anti")


@query("j24_merged_view", """WITH n AS (SELECT DISTINCT n_nationkey AS id FROM nation WHERE n_regionkey <> 2), e AS (SELECT least(c_nationkey, s_nationkey) AS low, greatest(c_nationkey, s_nationkey) AS high, c_mktsegment AS predicate, max(c_acctbal) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)
SELECT low, high, predicate, weight FROM e WHERE low IN (SELECT id FROM n) AND high IN (SELECT id FROM n)""")  # fmt: skip
def j24_merged_view(spark, sf_dir):
    """Line items as edges between the nations of their customer and their supplier."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("type"))
    items, placed, c, s = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "supplier"))
    sold = items.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = sold.select(F.col("c_nationkey").alias("src_id"), F.col("s_nationkey").alias("dst_id"), F.col("c_mktsegment").alias("predicate"), F.col("c_acctbal").alias("weight"))
    return graph.merged_view(nodes, edges, ["2"])[1].select("low", "high", "predicate", "weight")


@query("f30_grounded_triples", r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]{4,}') AS w FROM documents),
t AS (SELECT doc_id, text, lower(w[1]) AS s, lower(w[len(w)]) AS o, w[1] AS subject, w[len(w)] AS object, CASE WHEN doc_id % 3 = 0 THEN 'OWNS' WHEN doc_id % 3 = 1 THEN 'BLOCKS' ELSE 'LIKES' END AS predicate FROM w WHERE len(w) > 1),
n AS (SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm FROM t WHERE predicate <> 'LIKES' AND s <> o AND length(s) <= 80 AND length(o) <= 80)
SELECT doc_id, subject, predicate, object, CASE WHEN least((length(norm) - length(replace(norm, s, ''))) // length(s), (length(norm) - length(replace(norm, o, ''))) // length(o)) >= 2 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM n""")  # fmt: skip
def f30_grounded_triples(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), F.lit(1)).alias("w")).where(F.size("w") > 1)
    predicate = F.when(F.col("doc_id") % 3 == 0, "owns").when(F.col("doc_id") % 3 == 1, "Blocks").otherwise("LIKES")
    triples = words.select("doc_id", F.lit(0).alias("n"), F.get("w", 0).alias("subject"), F.lit("Person").alias("subject_type"), predicate.alias("predicate"), F.element_at("w", -1).alias("object"), F.lit("org").alias("object_type"))
    return graph.grounded_triples(triples, words.select("doc_id", "text")).select("doc_id", "subject", "predicate", "object", "confidence")


@query("w06_representative", f"""WITH {LETTERS_SQL}, c AS (SELECT source AS doc_id, doc_id AS chunk_index, text, len(list_distinct(regexp_extract_all(text, {quoted(ents.CANDIDATE)}, 1))) AS named FROM letter_docs)
SELECT doc_id, chunk_index FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (length(text) >= 120) DESC, named DESC, length(text) DESC, chunk_index) <= 3""")  # fmt: skip
def w06_representative(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"), "text")
    return graph.representative_chunks(chunks, 3).select("doc_id", "chunk_index")


@query("u02_linked_components", """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, -l_partkey AS b FROM lineitem), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT w.b, min(r.root) FROM r JOIN both_ways w ON r.node = w.a JOIN recurring.r AS held ON held.node = w.b WHERE r.root < held.root GROUP BY w.b)
SELECT node, root AS component FROM r""")  # fmt: skip
def u02_linked_components(spark, sf_dir):
    """Components of links between orders and parts, over all line items, under the smallest id; parts have negative ids."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey")).alias("dst"))
    return connected_components(pairs)


@query("g21_backfill_ledger", f"""WITH {_MENTIONS}, per_doc AS (SELECT doc_id, count(*) AS n FROM mentions GROUP BY doc_id)
SELECT d.doc_id::VARCHAR AS doc_id, CASE WHEN trim(regexp_replace(d.text, '\\s+', ' ', 'g')) = '' THEN 'skipped' ELSE 'done' END AS status, 1 AS attempts, coalesce(p.n, 0) AS entities FROM documents d LEFT JOIN per_doc p USING (doc_id)""")
def g21_backfill_ledger(spark, sf_dir):
    """The deterministic pass over all documents, in two runs of which the first one has a limit."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_index"), "text")
    passes = Backfill(spark, new_folder(spark, "backfill"))
    passes.run(chunks, "deterministic", "first", limit=100)
    passes.run(chunks, "deterministic", "rest")
    return passes.ledger().select("doc_id", "status", "attempts", "entities")
