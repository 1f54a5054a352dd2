"""The daily brief: sections are builders of (section, line, source, date); one that fails is reported as its own line."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import base_name
from sparkloom.operators import ledger
from sparkloom.session import cut

Section = Callable[[], DataFrame]


def line(df: DataFrame, section: str, text: Column, source: Column, date: Column | None = None) -> DataFrame:
    return df.select(F.lit(section).alias("section"), text.alias("line"), source.alias("source"), (date if date is not None else F.lit("")).cast("string").alias("date"))


def changed(points: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    docs = ledger.changed_sources(points, as_of, hours)
    return line(docs, "changed", F.concat(base_name(F.col("source")), F.lit(" changed · "), F.col("chunks").cast("string"), F.lit(" chunk(s) current")), F.col("source"), F.date_format("changed_at", "yyyy-MM-dd"))


def costs(costs_: DataFrame, as_of: Column) -> DataFrame:
    one = ledger.spend(costs_, as_of)
    return line(one, "costs", F.format_string("spend today $%.4f (%d calls) · 7d $%.4f (%d calls)", "today_usd", "today_calls", "week_usd", "week_calls"), F.lit("costs ledger"))


def approvals(approvals_: DataFrame) -> DataFrame:
    one = approvals_.agg(F.count_if(F.col("status") == "pending").alias("n"))
    return line(one, "approvals", F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" approval(s) waiting in the tray"))).otherwise("approvals tray clear"), F.lit("approvals tray"))


def sentinel(checks: DataFrame) -> DataFrame:
    one = checks.agg(F.count_if("ok").alias("green"), F.count(F.lit(1)).alias("n"))
    head = line(one, "sentinel", F.concat(F.lit("health "), "green", F.lit("/"), "n", F.lit(" green")), F.lit("sentinel"))
    return head.unionByName(line(checks.where(~F.col("ok")), "sentinel", F.concat(F.lit("FLAG: "), "name", F.lit(" — "), "detail"), F.lit("sentinel")))


def _shown(text: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def gates(hits: DataFrame, most: int = 3, limit: int = 12) -> DataFrame:
    """Of the first hits (source, text, date, position) for open gates, the first of each source."""
    first = hits.where(F.col("position") < limit).groupBy("source").agg(F.min_by(F.struct("position", "text", "date"), "position").alias("h"))
    return line(first.orderBy("h.position").limit(most), "gates", _shown(F.col("h.text"), 150), F.col("source"), F.col("h.date"))


def locks(points: DataFrame, most: int = 2) -> DataFrame:
    """The newest passages (source, text, date) of files named LOCKS.md; of those that have LOCKS in their path only if there are none."""
    some = points.where(F.contains("source", F.lit("LOCKS"))).withColumn("proper", F.endswith("source", F.lit("/LOCKS.md")))
    nth = F.row_number().over(Window.partitionBy("proper").orderBy(F.desc("date"), "source", "text"))
    few = some.withColumn("nth", nth).where(F.col("nth") <= most)
    few = few.withColumn("best", F.max("proper").over(Window.partitionBy())).where("proper = best")  # of four rows at most
    return line(few, "locks", _shown(F.col("text"), 150), F.col("source"), F.col("date"))


def sessions(sessions_: DataFrame, newest: int = 5, named: int = 3) -> DataFrame:
    """One line on the newest runs (id, intent, started_at)."""
    few = sessions_.orderBy(F.desc("started_at"), "id").limit(newest)
    order = F.array_sort(F.collect_list(F.struct(-F.unix_micros(F.col("started_at").cast("timestamp_ltz")).alias("at"), F.col("id"), F.substring(F.coalesce("intent", F.lit("")), 1, 40).alias("intent"))))
    one = few.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.slice(order, 1, named), lambda x: x["intent"]), " · ").alias("latest"))
    text = F.when(F.col("n") == 0, "no runs recorded yesterday").otherwise(F.concat(F.col("n").cast("string"), F.lit(" recent run(s) · latest: "), F.col("latest")))
    return line(one, "sessions", text, F.lit("sessions"))


def stored(lines: DataFrame, brief_id: Column, workspace: Column, kind: str, as_of: Column) -> DataFrame:
    """Rows for the table of briefs, one for each brief_id and workspace; a brief has a few dozen lines."""
    item = F.struct("section", "line", F.struct("source", F.lit(0).alias("chunk"), "date").alias("breadcrumb"))
    out = lines.groupBy(brief_id.cast("long").alias("id"), workspace.cast("string").alias("workspace_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return out.select("id", "workspace_id", F.lit(kind).alias("kind"), "items", as_of.alias("created_at"), F.lit(0).alias("notified"))


def latest(briefs: DataFrame) -> DataFrame:
    """The brief of the largest id; no row without briefs."""
    return briefs.orderBy(F.desc("id")).limit(1)


def build(sections: Mapping[str, Section], spark) -> DataFrame:
    """All sections as one table; each is worked out by itself, so that one that fails, while planned or while run, does not stop the others."""
    empty = out = spark.createDataFrame([], "section string, line string, source string, date string")
    for name, section in sections.items():
        try:
            rows = cut(section().select(*empty.columns))  # a few dozen lines
        except Exception as e:  # noqa: BLE001  a brief is better short than missing
            rows = spark.createDataFrame([(name, f"section failed: {type(e).__name__}", "", "")], empty.schema)
        out = out.unionByName(rows)
    return out
