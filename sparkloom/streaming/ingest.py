"""Streams: files that land in a folder become guarded chunks; event windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.functions.guard import guard
from sparkloom.operators.chunking import slice_documents
from sparkloom.sources.store import BucketedTable

LANDING = "doc_id string, title string, source_file string, created_at string, text string"


def guarded_chunks(docs: DataFrame) -> DataFrame:
    """Documents to chunks that are masked and marked; the same function serves batch and stream."""
    chunks = slice_documents(docs).withColumn("_g", guard(F.col("text")))
    out = chunks.withColumn("text", F.col("_g.text")).withColumns({c: F.col(f"_g.{c}") for c in ("pii_redacted", "injection_risk", "injection_patterns")})
    return out.drop("_g")


def ingest_stream(spark: SparkSession, landing: str, store: BucketedTable, checkpoint: str, report: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Takes what has landed since the last run, replaces those documents' chunks, and ends.

    A batch that is run again replaces the same documents with the same chunks, so a restart changes nothing.
    """

    def take(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max_by(F.struct("title", "source_file", "created_at", "text"), F.struct("created_at", "text")).alias("d")).select("doc_id", "d.*")
        chunks = guarded_chunks(last)
        store.replace_by(chunks.select([f.name for f in store.schema]), last)
        if report:
            report(ingest_report(last, chunks))

    stream = spark.readStream.schema(LANDING).json(landing)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counters."""
    counts = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("pii_redacted"), F.lit(0)).cast("long").alias("pii_redacted"), F.count_if("injection_risk").alias("flagged"))
    return docs.agg(F.count(F.lit(1)).alias("documents")).crossJoin(counts)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream's watermark needs an instant; a table is taken as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def event_windows(events: DataFrame, time: str, keys: list[str], size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums of ``value`` by window and keys; additional to what ledgers need. Late events are taken up to ``late``."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    timed = _timed(events, time, late)
    out = timed.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def event_sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key without a pause longer than ``gap``; additional as well."""
    timed = _timed(events, time, late)
    out = timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
