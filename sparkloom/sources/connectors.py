"""Results of outside tools as a landing table: what may be pulled, what becomes chunks, what is kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.guard import context_block, guard
from sparkloom.functions.policy import resolved_tier


def pullable(tools: DataFrame) -> DataFrame:
    """Tools (connector_id, tool, description, risk_tier) that may run unasked: those whose resolved tier is read."""
    return tools.where(resolved_tier(F.col("risk_tier"), F.col("tool"), F.col("description")) == "read")


def guarded_results(results: DataFrame) -> DataFrame:
    """Results (id, connector_id, tool, raw_text) with their marks and the only text that may go on."""
    g = guard(F.col("raw_text"))
    marked = results.withColumn("_g", g)
    return marked.select(*results.columns, *(F.col(f"_g.{c}") for c in ("pii_redacted", "injection_risk", "injection_patterns")), context_block(F.col("id"), F.col("_g")).alias("context"))


def synced_chunks(results: DataFrame, tools: DataFrame) -> DataFrame:
    """One chunk per clean result of a pullable tool, with its provenance; the newest result of a tool replaces older ones."""
    allowed = pullable(tools).select("connector_id", "tool").distinct()
    newest = F.row_number().over(Window.partitionBy("connector_id", "tool").orderBy(F.desc("id")))
    kept = guarded_results(results.join(allowed, ["connector_id", "tool"], "left_semi")).where(~F.col("injection_risk"))
    kept = kept.withColumn("_n", newest).where("_n = 1")
    doc = F.concat(F.lit("connector:"), "connector_id", F.lit(":"), "tool")
    return kept.select(doc.alias("doc_id"), F.col("context").alias("text"), F.lit("connector").alias("source_type"), "connector_id", F.lit(0).alias("chunk_index"))


def sync_report(results: DataFrame, tools: DataFrame) -> DataFrame:
    """(connector_id, pulled, flagged, chunked, refused): flagged results are counted, never chunked."""
    allowed = pullable(tools).select("connector_id", "tool", F.lit(True).alias("_ok")).distinct()
    seen = guarded_results(results).join(allowed, ["connector_id", "tool"], "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    return seen.groupBy("connector_id").agg(F.count_if("_ok").alias("pulled"), F.count_if(F.col("_ok") & F.col("injection_risk")).alias("flagged"),
                                            F.count_distinct(F.when(F.col("_ok") & ~F.col("injection_risk"), F.col("tool"))).alias("chunked"), F.count_if(~F.col("_ok")).alias("refused"))
