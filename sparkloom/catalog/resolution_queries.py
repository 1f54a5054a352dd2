"""Entity resolution, stored chunks, valid specs, artifact states and label search over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalog.base import query
from sparkloom.operators import graph, ledger, resolve
from sparkloom.session import table

_TYPE = "CASE p_type WHEN 'PROMO' THEN 'person' WHEN 'LARGE' THEN 'product' WHEN 'ECONOMY' THEN 'org' ELSE 'place' END"
_ID = "(('0x' || substr(sha256({} || '|' || {}), 1, 16))::UBIGINT >> 1)::BIGINT"


def _named_parts(spark, sf_dir):
    """Parts as mentions: brand and name as the key, the name alone as the spelling."""
    kind = F.when(F.col("p_type") == "PROMO", "person").when(F.col("p_type") == "LARGE", "product").when(F.col("p_type") == "ECONOMY", "org").otherwise("place")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), kind.alias("type"), F.concat_ws(" ", "p_name", "p_brand").alias("canonical_key"), F.col("p_name").alias("alias_key"))


_RESOLVED = f"""nodes AS (SELECT {_TYPE} AS type, p_name || ' ' || p_brand AS canonical_key, p_name AS alias_key, count(DISTINCT p_partkey) AS docs FROM part GROUP BY ALL),
resolved AS (SELECT type, canonical_key, first_value(canonical_key) OVER (PARTITION BY type, alias_key ORDER BY docs DESC, canonical_key) AS entity_key FROM nodes)"""


@query("g02_resolved_spellings", f"WITH {_RESOLVED} SELECT type, canonical_key, {_ID.format('entity_key', 'type')} AS entity_id, entity_key FROM resolved")
def g02_resolved_spellings(spark, sf_dir):
    """Same key or same spelling; the similar keys are held against a brute force in the tests, as SQL has no such ratio."""
    return resolve.resolve(_named_parts(spark, sf_dir), fuzzy=False)


@query("g02_resolved")
def g02_resolved(spark, sf_dir):
    """The whole chain: key, spelling, similar key."""
    return resolve.resolve(_named_parts(spark, sf_dir))


@query("j09_by_alias", f"WITH {_RESOLVED} SELECT DISTINCT n.alias_key, n.type, {_ID.format('r.entity_key', 'r.type')} AS id FROM nodes n JOIN resolved r USING (type, canonical_key) WHERE n.type <> 'place'")
def j09_by_alias(spark, sf_dir):
    parts = _named_parts(spark, sf_dir)
    found = resolve.resolve(parts, fuzzy=False)
    entities = found.select(F.col("entity_id").alias("id"), "type").distinct()
    aliases = parts.join(found, ["type", "canonical_key"]).select("entity_id", "alias_key").distinct()
    return resolve.by_alias(parts.where("type <> 'place'"), aliases, entities)


@query("g08_type_evidence", f"""WITH {_RESOLVED}, seen AS (SELECT DISTINCT entity_key, type FROM resolved)
SELECT {_ID.format('a.entity_key', 'a.type')} AS entity_id, b.type AS alias, 'type::' || b.type AS alias_key FROM seen a JOIN seen b USING (entity_key)""")  # fmt: skip
def g08_type_evidence(spark, sf_dir):
    found = resolve.resolve(_named_parts(spark, sf_dir), fuzzy=False)
    none = spark.createDataFrame([], "entity_id long, alias string, alias_key string")
    return resolve.type_evidence(found, none)


@query("t09_find_labels", "SELECT p_partkey AS id, p_name AS label FROM part WHERE contains(lower(p_name), 'ro')")
def t09_find_labels(spark, sf_dir):
    return graph.find_labels(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), "RO")


@query("s07_stored_chunks", "SELECT source AS doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'c' || doc_id END, doc_id::VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth FROM documents")
def s07_stored_chunks(spark, sf_dir):
    """Chunks of stored points by document, in the order of their ids; the id in the payload comes first."""
    stored = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), F.col("source").alias("doc_id"), "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("chunk_id"))
    return ledger.stored_chunks(stored).select("doc_id", "chunk_id", "nth")


@query("p11_valid_specs", "SELECT doc_id AS id, quality AS validator_pass FROM labels WHERE quality = 1")
def p11_valid_specs(spark, sf_dir):
    return ledger.valid_specs(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("validator_pass")))


@query("a30_artifact_states", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'error' WHEN count(p_partkey) = 0 THEN 'empty' ELSE 'loaded' END AS state, count(p_partkey) AS n
FROM supplier LEFT JOIN part ON p_partkey % 90 = s_suppkey GROUP BY s_suppkey""")  # fmt: skip
def a30_artifact_states(spark, sf_dir):
    """Suppliers as artifact folders, parts as their files; every seventh cannot be read."""
    folders = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 == 0, "unreadable").alias("error"))
    files = table(spark, sf_dir, "part").select((F.col("p_partkey") % 90).alias("id"))
    return ledger.artifact_states(folders, files)
