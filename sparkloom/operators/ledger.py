"""Analytics over append-only ledgers: costs, receipts, sessions, connector results, documents. ``as_of`` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import base_name, intent_terms, theme_of


def document_list(points: DataFrame) -> DataFrame:
    """(doc_id, source_file, created_at) with the smallest of each; nameless documents are left out."""
    return points.where("doc_id is not null and doc_id <> ''").groupBy("doc_id").agg(F.min("source_file").alias("source_file"), F.min("created_at").alias("created_at"))


def changed_sources(points: DataFrame, as_of: Column, hours: int = 48, limit: int = 5) -> DataFrame:
    """Sources that changed within the window, latest first."""
    recent = points.where(F.col("changed_at") > as_of - F.make_dt_interval(hours=F.lit(hours)))
    return recent.groupBy("source").agg(F.max("changed_at").alias("changed_at"), F.count(F.lit(1)).alias("chunks")).orderBy(F.desc("changed_at"), "source").limit(limit)


def recent_docs(points: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """Documents whose latest chunk lies within the window, with their theme."""
    docs = points.groupBy("doc_id").agg(F.coalesce(F.min("source_file"), F.col("doc_id")).alias("source_file"), F.max("created_at").alias("changed_at"))
    return docs.where(F.col("changed_at") >= as_of - F.make_dt_interval(hours=F.lit(hours))).withColumn("theme", theme_of(F.col("source_file")))


def spend(costs: DataFrame, as_of: Column) -> DataFrame:
    """One row: today's and the last seven days' cost and calls."""
    day = F.date_trunc("day", as_of)
    today, week = F.col("created_at") >= day, F.col("created_at") >= day - F.expr("INTERVAL 7 DAYS")
    total = lambda when: F.round(F.coalesce(F.sum(F.when(when, F.col("cost_usd"))), F.lit(0.0)), 4)
    return costs.agg(total(today).alias("today_usd"), F.count_if(today).alias("today_calls"), total(week).alias("week_usd"), F.count_if(week).alias("week_calls"))


def daily_spend(costs: DataFrame, budget: float) -> DataFrame:
    """Cost of each day against a budget; a budget of 0 never flags."""
    days = costs.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("cost_usd"), 4).alias("usd"), F.count(F.lit(1)).alias("calls"))
    return days.withColumn("over", F.lit(budget > 0) & (F.col("usd") > budget))


def pass_rate(receipts: DataFrame, last: int = 500, least: float = 0.5) -> DataFrame:
    """One row over the ``last`` receipts by id: total, passed, rate (3 places), flagged."""
    some = receipts.orderBy(F.desc("id")).limit(last)
    out = some.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("validator_pass"), F.lit(0)).cast("long").alias("passed"))
    rate = F.when(F.col("total") > 0, F.col("passed") / F.col("total"))
    return out.select("total", "passed", F.round(rate, 3).alias("rate"), F.coalesce(rate < least, F.lit(False)).alias("flagged"))


def return_stats(orders: DataFrame) -> DataFrame:
    """(sku, orders, rto, rto_rate_pct) with a total row (sku null); nothing at all if any order lacks a field."""
    bad = orders.agg(F.count_if(F.col("sku").isNull() | F.col("status").isNull()).alias("bad"))
    rows = orders.crossJoin(F.broadcast(bad)).where("bad = 0")  # one row
    hit = F.sum((F.col("status") == "rto").cast("long"))
    out = rows.rollup("sku").agg(F.count(F.lit(1)).alias("orders"), hit.alias("rto"))
    return out.where("orders > 0").withColumn("rto_rate_pct", F.round(100 * F.col("rto") / F.col("orders"), 1))


def orders_from_json(raw: Column) -> Column:
    """array<struct<order, sku, status>> of a connector's JSON, null if it is no array of objects."""
    return F.from_json(raw, "array<struct<order:string,sku:string,status:string>>", {"mode": "PERMISSIVE"})


def latest_capture(results: DataFrame, suffix: str, tool: str) -> DataFrame:
    """The newest clean result of a connector's tool, by id."""
    clean = results.where(F.endswith("connector_id", F.lit(suffix)) & (F.col("tool") == tool) & (F.col("injection_risk") == 0))
    return clean.orderBy(F.desc("id")).limit(1)


def worst_skus(stats: DataFrame, limit: int = 3) -> DataFrame:
    return stats.where("sku is not null").orderBy(F.desc("rto_rate_pct"), "sku").limit(limit)


def acquisition_cost(spends: DataFrame, spend_col: str, orders_col: str, channel_col: str) -> DataFrame:
    """One row: spend, orders, channels and spend per order (0 without orders)."""
    out = spends.agg(F.round(F.sum(spend_col), 2).alias("spend"), F.sum(orders_col).cast("long").alias("orders"), F.count_distinct(channel_col).alias("channels"))
    return out.withColumn("cac", F.when(F.col("orders") > 0, F.round(F.col("spend") / F.col("orders"), 2)).otherwise(0.0))


def live_map(connectors: DataFrame, results: DataFrame, points: DataFrame) -> DataFrame:
    """Each connector (workspace_id, connector_id) with its results (key ``workspace.connector``) and chunks, 0 where none."""
    key = F.concat_ws(".", "workspace_id", "connector_id")
    seen = results.groupBy(F.col("connector_id").alias("key")).agg(F.count(F.lit(1)).alias("results"), F.sum("injection_risk").cast("long").alias("flagged"), F.max("received_at").alias("last_sync"))
    chunks = points.groupBy(F.col("connector_id").alias("key")).agg(F.count(F.lit(1)).alias("chunks"))
    out = connectors.withColumn("key", key).join(seen, "key", "left").join(chunks, "key", "left")
    return out.select("workspace_id", "connector_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("results", "flagged", "chunks")), "last_sync")


def latest_per_key(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """The row of the largest ``order`` of each key; a partial aggregation, not a sort."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*values), F.col(order)).alias("v"), F.max(order).alias(order))
    return best.select(key, order, "v.*")


def sessions_like(sessions: DataFrame, receipts: DataFrame, intent: str, newest: int = 500, limit: int = 30) -> DataFrame:
    """Of the newest sessions those whose intent shares words with the given one, by overlap, then recency; all for no words."""
    some = sessions.orderBy(F.desc("started_at"), "id").limit(newest)
    terms = intent_terms(F.lit(intent))
    match = F.size(F.array_intersect(terms, intent_terms(F.col("intent"))))
    counts = receipts.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("receipts"))
    out = some.withColumn("match", match).where((F.col("match") > 0) | (F.size(terms) == 0)).join(counts, "id", "left")
    return out.withColumn("receipts", F.coalesce("receipts", F.lit(0))).orderBy(F.desc("match"), F.desc("started_at"), "id").limit(limit)


def with_overflow(docs: DataFrame, order: list[Column], line: Column, most: int = 6) -> DataFrame:
    """(position, line): the first lines and, if there are more, one that says how many."""
    top = docs.withColumn("line", line).orderBy(*order).limit(most)
    top = top.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("position", "line")
    n = docs.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return top.unionAll(n.select(F.lit(most + 1), F.concat(F.lit("+"), (F.col("n") - most).cast("string"), F.lit(" more docs changed in the window"))))


def doc_line(theme: Column, path: Column) -> Column:
    return F.concat(theme, F.lit(": new/updated — "), base_name(path))


def timeline(events: DataFrame, key: str, order: list[str], limit: int = 50) -> DataFrame:
    """Each key's newest events with whether their time follows the one before."""
    newest = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    some = events.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= limit)
    before = F.lag(order[0]).over(Window.partitionBy(key).orderBy(*order))
    return some.withColumn("monotonic", F.coalesce(F.col(order[0]) >= before, F.lit(True)))


def sentinel(edges: DataFrame, points: DataFrame, receipts: DataFrame, costs: DataFrame, briefs: DataFrame, as_of: Column, budget: float = 0.0) -> DataFrame:
    """(name, ok, detail) of five checks, one row each: graph growth, store, validator, cost, brief."""
    age = lambda at: F.unix_timestamp(as_of) - F.unix_timestamp(at)
    grown = edges.agg(F.lit("graph_growth").alias("name"), (F.coalesce(age(F.max("asserted_at")) <= 24 * 3600, F.lit(False)) & (F.count(F.lit(1)) > 0)).alias("ok"), F.concat(F.count(F.lit(1)), F.lit(" edges")).alias("detail"))
    store = points.agg(F.lit("retrieval"), F.count(F.lit(1)) > 0, F.concat(F.count(F.lit(1)), F.lit(" points in store")))
    rate = pass_rate(receipts).select(F.lit("validator_rate"), ~F.col("flagged"), F.concat("passed", F.lit("/"), "total", F.lit(" sentence-receipts grounded")))
    day = F.date_trunc("day", as_of)
    usd = F.round(F.coalesce(F.sum(F.when((F.col("created_at") >= day) & (F.col("created_at") < day + F.expr("INTERVAL 1 DAY")), F.col("cost_usd"))), F.lit(0.0)), 4)
    cost = costs.agg(F.lit("cost"), ~(F.lit(budget > 0) & (usd > budget)), F.concat(F.lit("today $"), F.format_string("%.4f", usd), F.lit(f" / budget ${budget:.2f}")))
    brief = briefs.agg(F.lit("brief_freshness"), F.coalesce(age(F.max("created_at")) < 26 * 3600, F.lit(False)), F.concat(F.count(F.lit(1)), F.lit(" briefs")))
    return grown.unionAll(store).unionAll(rate).unionAll(cost).unionAll(brief)


def artifact_provenance(files: DataFrame, receipts: DataFrame, approvals: DataFrame) -> DataFrame:
    """Files (path, modified) with the newest receipt whose doc_id is the path, and the approval that its run names."""
    latest = latest_per_key(receipts.where("doc_id is not null"), "doc_id", "id", ["run_id", "claim_text"]).withColumnRenamed("doc_id", "path").withColumnRenamed("id", "receipt_id")
    found = files.join(latest, "path", "left").withColumn("approval_id", F.nullif(F.regexp_extract(F.coalesce("run_id", F.lit("")), r"^approval-(\d+)$", 1), F.lit("")).cast("long"))
    return found.join(approvals.select(F.col("id").alias("approval_id"), "action_class", "status"), "approval_id", "left")


def decided(approvals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approvals after decisions (id, decision, at): the first decision on a pending one counts, later ones are refused."""
    first = decisions.groupBy("id").agg(F.min_by("decision", "at").alias("decision"), F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    out = approvals.join(first, "id", "left")
    takes = (F.col("status") == "pending") & F.col("decision").isin("approved", "rejected")
    return out.select("id", F.when(takes, F.col("decision")).otherwise(F.col("status")).alias("status"), F.when(takes, F.col("at")).alias("resolved_at"),
                      (F.coalesce("n", F.lit(0)) - F.when(takes, 1).otherwise(0)).alias("refused"))


def stored_chunks(points: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, text, nth) of stored points (point_id, doc_id, chunk_id, text), numbered within their document; files are not read again."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("point_id")) - 1
    return points.select("doc_id", F.coalesce("chunk_id", F.col("point_id").cast("string")).alias("chunk_id"), "text", nth.alias("nth"))


def valid_specs(specs: DataFrame) -> DataFrame:
    """Specs that a validator has passed; all others are hidden."""
    return specs.where(F.col("validator_pass") == 1)


def artifact_states(folders: DataFrame, files: DataFrame) -> DataFrame:
    """(id, state, n): error where a folder (id, error) could not be read, else empty or loaded by its files (id)."""
    counts = files.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return folders.join(counts, "id", "left").select("id", F.when(F.col("error").isNotNull(), "error").when(n == 0, "empty").otherwise("loaded").alias("state"), n.alias("n"))
