"""Approvals as keyed state: requests and decisions in order of time, the first valid decision of each approval is its last word.

Events (id, kind, decision, actor, at): kind is ``request`` or ``decision``. A decision counts if its approval is pending and
``at`` is no later than ``wait`` after the request; else it is refused with the reason. A request that nobody decides within
``wait`` expires once the watermark is past that. ``at`` alone says whether a decision is in time, so the result does not depend
on how events are dealt into micro-batches, as long as an approval's events come in order of time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: fixed values
DECISIONS = ("approved", "rejected")
EVENTS = "id long, kind string, decision string, actor string, at timestamp"
CHANGES = "id long, status string, actor string, at timestamp, reason string"


def changes_stream(events: DataFrame, wait: dt.timedelta, late: str = "1 hour") -> DataFrame:
    """(id, status, actor, at, reason): each change of an approval (pending, approved, rejected, expired), and each refused decision."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ident, out = int(key[0]), []
        status, asked = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            if status == "pending":
                out.append((ident, "expired", None, asked + wait, None))
                status = "expired"
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "kind", "decision", "actor"], ascending=[True, False, True, True], kind="stable")
            for kind, decision, actor, at in zip(rows["kind"], rows["decision"], rows["actor"], rows["at"], strict=True):
                if kind == "request":
                    if status is None:
                        status, asked = "pending", at.to_pydatetime()
                        out.append((ident, "pending", actor, at, None))
                    continue
                reason = _refusal(status, decision, at.to_pydatetime(), asked, wait)
                if reason is None:
                    status = decision
                out.append((ident, decision if reason is None else "refused", actor, at, reason))
        if status is not None:
            state.update((status, asked))
            if status == "pending":
                state.setTimeoutTimestamp(max(int((asked + wait).replace(tzinfo=dt.timezone.utc).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "status", "actor", "at", "reason"])

    timed = events.withWatermark("at", late)
    return timed.groupBy("id").applyInPandasWithState(step, CHANGES, "status string, asked timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def _refusal(status: str | None, decision: str | None, at: dt.datetime, asked: dt.datetime | None, wait: dt.timedelta) -> str | None:
    if decision not in DECISIONS:
        return "unknown decision"
    if status is None:
        return "not found"
    if status in DECISIONS:
        return f"already {status}"
    return "expired" if at > asked + wait else None


def changes(events: DataFrame, wait: dt.timedelta, until: dt.datetime) -> DataFrame:
    """changes_stream() of a table of all events; requests expire up to ``until``."""
    limit = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(wait.total_seconds()))
    order = Window.partitionBy("id").orderBy("at", F.desc("kind"), "decision", "actor")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_request = F.col("kind") == "request"
    rows = events.withColumns({"asked": F.min(F.when(is_request, F.col("at"))).over(before), "nth": F.row_number().over(order)})
    known = F.col("decision").isin(*DECISIONS)
    valid = ~is_request & F.coalesce(known, F.lit(False)) & F.col("asked").isNotNull() & (F.col("at") <= F.col("asked") + limit)
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    rows = rows.withColumn("settled", F.min_by("decision", F.when(F.col("valid"), F.col("nth"))).over(before))
    reason = (F.when(~F.coalesce(known, F.lit(False)), "unknown decision").when(F.col("asked").isNull(), "not found")
              .when(F.col("settled").isNotNull(), F.concat(F.lit("already "), "settled")).when(~F.col("valid"), "expired"))
    first = is_request & F.col("asked").isNull()
    told = rows.where(first | ~is_request).select("id", F.when(first, "pending").when(reason.isNull(), F.col("decision")).otherwise("refused").alias("status"), "actor", "at", F.when(~is_request, reason).alias("reason"))
    open_ = rows.groupBy("id").agg(F.min(F.when(is_request, F.col("at"))).alias("asked"), F.max("valid").alias("done")).where("not done and asked is not null")
    expired = open_.where(F.col("asked") + limit < F.lit(until)).select("id", F.lit("expired").alias("status"), F.lit(None).cast("string").alias("actor"), (F.col("asked") + limit).alias("at"), F.lit(None).cast("string").alias("reason"))
    return told.unionAll(expired)
