"""How the given tables stand for a workspace's, in both languages, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.guard import scan_injection
from sparkloom.operators.words import Index
from sparkloom.session import cut, new_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "2024-01-30 00:00:00"
QUESTION = "that there would be another edition of the thing"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def quoted(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def injection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, injection_risk): every text is scanned once, when it is stored."""
    docs = table(spark, sf_dir, "documents")
    return stored(spark, sf_dir, "injection_flags", lambda: docs.select(F.col("doc_id").alias("point_id"), (F.size(scan_injection(F.col("text"))) > 0).alias("injection_risk")))


def word_index(spark: SparkSession, sf_dir: str) -> Index:
    """The documents' stored postings; written once a session, as an ingest would."""
    key = (spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir), "words")
    if key not in _INDEXES:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), "text")
        _INDEXES[key] = Index(spark, new_folder(spark, "words"))
        _INDEXES[key].add(0, docs)
    return _INDEXES[key]


def points(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """Documents as chunks: the source is the document, the id the chunk; dates are spread over a year by id.

    The pairing of vec_id with doc_id is ours; the tables have no key between texts and vectors.
    """
    docs = table(spark, sf_dir, "documents")
    day = F.date_format(F.date_add(F.lit("2023-02-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    out = docs.select(F.col("doc_id").alias("point_id"), F.col("source").alias("doc_id"), F.concat(F.lit("corpus/"), "source", F.lit(".md")).alias("source"),
                      F.substring(F.regexp_extract("text", r"^([^\n]*)", 1), 1, 40).alias("title"), F.col("doc_id").cast("int").alias("chunk_index"), day.alias("created_at"), "text", "lang")
    out = out.join(injection_flags(spark, sf_dir), "point_id")
    if vectors:
        out = out.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding", "label"), "point_id", "left")
    return out


POINTS_SQL = r"""points AS (SELECT d.doc_id AS point_id, d.source AS doc_id, 'corpus/' || d.source || '.md' AS source, substr(regexp_extract(d.text, '^([^\n]*)', 1), 1, 40) AS title,
  d.doc_id AS chunk_index, strftime(DATE '2023-02-01' + (d.doc_id % 365)::INT, '%Y-%m-%d') AS created_at, d.text, d.lang FROM documents d)"""


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").head()[0])


#: Documents for SQL patterns with word borders: RE2 takes no letter outside ASCII for one, so these letters become "_",
#: which no pattern here captures; every text keeps its length, and borders are then those of the engine's patterns.
LETTERS_SQL = r"letter_docs AS (SELECT * REPLACE (regexp_replace(text, '[^\x00-\x7F\P{L}]', '_', 'g') AS text) FROM documents)"

_STORED: dict[tuple[str, ...], DataFrame] = {}
_INDEXES: dict[tuple[str, ...], Index] = {}


def version(spark: SparkSession, sf_dir: str) -> str:
    """The documents' files with their sizes and times, so that what is stored of a table is not used for another one under its path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return ",".join(sorted(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in listed))


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries share, written to the shared folder once a session, as an ingest would store it."""
    key = (spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir), name)
    if key not in _STORED:
        _STORED[key] = cut(build())
    return _STORED[key]


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a cost ledger: value cents a call, the event type as the model."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("model"), (F.col("value") / 100).alias("cost_usd"), F.col("ts").alias("created_at"))


COSTS_SQL = "costs AS (SELECT event_id AS id, user_id::VARCHAR AS run_id, event_type AS model, value / 100 AS cost_usd, ts AS created_at FROM events)"


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as validator receipts."""
    return table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).cast("string").alias("run_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").alias("validator_pass"))


RECEIPTS_SQL = "receipts AS (SELECT doc_id AS id, (doc_id % 50)::VARCHAR AS run_id, doc_id::VARCHAR AS doc_id, quality AS validator_pass FROM labels WHERE quality IS NOT NULL)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First user turns as sessions."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("intent"))
    return first.select(F.col("conv_id").cast("string").alias("id"), "intent", F.timestamp_add("minute", F.col("conv_id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("started_at"))


SESSIONS_SQL = """sessions AS (SELECT conv_id::VARCHAR AS id, min_by(text, turn) AS intent, TIMESTAMP '2024-01-01' + to_minutes(conv_id) AS started_at
  FROM conversations WHERE role = 'user' GROUP BY conv_id)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as orders with a status; returned ones count as sent back."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_partkey").cast("string").alias("sku"), F.when(F.col("l_returnflag") == "R", "rto").otherwise("delivered").alias("status"))


ORDERS_SQL = "shipped AS (SELECT l_partkey::VARCHAR AS sku, CASE WHEN l_returnflag = 'R' THEN 'rto' ELSE 'delivered' END AS status FROM lineitem)"
