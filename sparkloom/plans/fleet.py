"""Agents for a workspace from templates: all of a workspace's specs are valid, or none is written."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.policy import spec_reasons

_LEAST, _MOST = 2, 41  # characters of an id


def fleet(answers: DataFrame, templates: DataFrame, existing: DataFrame, task_classes: Sequence[str], playbooks: Sequence[str], shown: Callable[[Column], Column] = lambda reasons: reasons) -> DataFrame:
    """Specs (workspace_id, id, version, reasons, accepted) of answers (workspace_id, playbook) and templates (playbook,
    agent, name, task_class, k, focus, role); a spec's version follows the one that is there.

    existing: versions of single specs (id, version), or of whole fleets (workspace_id, playbook, version). shown: how reasons
    are put. Whatever depends on a template or on a workspace alone is worked out there; specs, of which there is one for each
    pair, are only put together, and a workspace is judged by what its playbooks' templates have in common.
    """
    spec = [F.col(c) for c in ("name", "task_class", "k", "focus", "role", "playbook")]
    plain = r"^([a-z0-9-]*)$"
    without = spec_reasons(F.lit("an-id"), *spec, task_classes, playbooks)
    made = templates.select("playbook", "agent", shown(without).alias("_valid_id"), shown(F.concat(F.array(F.lit("id")), without)).alias("_bad_id"), (F.size(without) > 0).alias("_bad"),
                            F.coalesce(F.col("agent").rlike(plain), F.lit(True)).alias("_plain"), F.coalesce(F.length(F.regexp_extract("agent", plain, 1)), F.lit(-1)).alias("_chars"))
    books = made.groupBy("playbook").agg((~F.max("_bad") & F.min("_plain")).alias("_fit"), F.min("_chars").alias("_least"), F.max("_chars").alias("_most"))
    asked = answers.where("workspace_id is not null").select("workspace_id", "playbook").withColumn("_own", F.when(F.col("workspace_id").rlike(r"^[a-z0-9][a-z0-9-]*\z"), F.length("workspace_id") + 1))
    judged = asked.join(books, "playbook").withColumn("_fit", F.coalesce(F.col("_fit") & (F.col("_own") + F.col("_least") >= _LEAST) & (F.col("_own") + F.col("_most") <= _MOST), F.lit(False)))
    asked = asked.join(judged.groupBy("workspace_id").agg(F.min("_fit").alias("accepted")), "workspace_id")
    single = "id" in existing.columns
    if not single:
        asked = asked.join(existing.groupBy("workspace_id", "playbook").agg(F.max("version").alias("_last")), ["workspace_id", "playbook"], "left")
    # a playbook's templates are dealt out, and each part meets all its workspaces: playbooks are few
    parts = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = made.withColumn("_part", F.pmod(F.xxhash64("agent", "_valid_id", "_chars"), F.lit(parts)).cast("int"))
    asked = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # by its estimate the copies of a small table would be a broadcast
    out = made.hint("merge").join(asked.hint("merge"), ["playbook", "_part"]).withColumn("id", F.concat_ws("-", "workspace_id", "agent"))
    if single:
        out = out.join(existing.groupBy("id").agg(F.max("version").alias("_last")), "id", "left")
    valid = F.coalesce(F.col("_plain") & (F.col("_own") + F.col("_chars")).between(_LEAST, _MOST), F.lit(False))
    return out.select("workspace_id", "id", (F.coalesce("_last", F.lit(0)) + 1).alias("version"), F.when(valid, F.col("_valid_id")).otherwise(F.col("_bad_id")).alias("reasons"), "accepted")
