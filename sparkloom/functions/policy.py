"""Rules on tools, tiers, models and specs as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.schemas import RISK_TIERS

# fixed values: verbs
_SPEND = "pay|charge|refund|purchase|spend|transfer"
_WRITE = "create|write|send|update|delete|post|publish|suppress|cancel|set|add|remove|upload"
_RUN = "run|execute|exec|shell|eval|spawn|compile|script"
_READ = "list|get|read|search|fetch|pull|query|describe|count|show"


def _says(text: Column, verbs: str) -> Column:
    return text.rlike(rf"(?i)\b({verbs})\b")


def tool_text(name: Column, description: Column | None = None) -> Column:
    """Name and description with separators as spaces."""
    return F.regexp_replace(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit("")) if description is not None else F.lit("")), r"[_\-./]", " ")


def tool_class(name: Column, description: Column | None = None) -> Column:
    """spend, outbound or none; what has no known verb is outbound."""
    text = tool_text(name, description)
    return F.when(_says(text, _SPEND), "spend").when(_says(text, _WRITE), "outbound").when(_says(text, _READ), "none").otherwise("outbound")


def inferred_tier(name: Column, description: Column | None = None) -> Column:
    """The riskiest tier that a verb suggests; null without one."""
    text = tool_text(name, description)
    return F.when(_says(text, f"{_SPEND}|{_WRITE}"), "external").when(_says(text, _RUN), "exec").when(_says(text, _READ), "read")


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*(F.lit(t) for t in RISK_TIERS)), tier).cast("int")


def riskier(a: Column, b: Column) -> Column:
    """Of two tiers the riskier; an unknown one wins, as a caller's bug must not pass."""
    return F.when(tier_rank(a) == 0, a).when(tier_rank(b) == 0, b).when(tier_rank(a) >= tier_rank(b), a).otherwise(b)


def resolved_tier(declared: Column, name: Column, description: Column | None = None) -> Column:
    inferred = inferred_tier(name, description)
    return F.when(declared.isNull(), F.coalesce(inferred, F.lit("external"))).when(inferred.isNull(), declared).otherwise(riskier(declared, inferred))


def requires_approval(tier: Column) -> Column:
    return tier != "read"


def model_family(model: Column, known: Mapping[str, str] | None = None) -> Column:
    """Vendor or base name without its version; ``known`` names exceptions."""
    base = F.lower(F.split(F.split(model, "/")[0], ":")[0])
    bare = F.regexp_replace(F.regexp_replace(base, r"[\d.]+$", ""), r"[-_.]+$", "")
    bare = F.when(bare == "", base).otherwise(bare)
    bare = F.when(bare == "meta-llama", "llama").otherwise(bare)
    if not known:
        return bare
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), model), bare)


def model_provider(model: Column, local: Sequence[str] = ()) -> Column:
    return F.when(model.isin(*local) | (F.contains(model, F.lit(":")) & ~F.contains(model, F.lit("/"))), "local").otherwise("remote")


def egress_blocked(local_only: Column, provider: Column, has_connector_content: Column) -> Column:
    return local_only & (provider != "local") & has_connector_content


def synthetic_refused(synthetic: Column, workspace: Column, protected: Sequence[str]) -> Column:
    return synthetic & workspace.isin(*protected)


def contained(path: Column, roots: Sequence[str]) -> Column:
    """Whether a path lies in an allowed root and does not climb out."""
    inside = F.exists(F.array(*(F.lit(r.rstrip("/") + "/") for r in roots)), lambda r: F.startswith(path, r))
    return inside & ~path.rlike(r"(^|/)\.\.(/|$)")


def _line_ok(text: Column, most: int) -> Column:
    return F.coalesce(F.length(text).between(1, most) & ~text.rlike(r"[\x00-\x1f]"), F.lit(False))


def spec_reasons(id_: Column, name: Column, task_class: Column, k: Column, focus: Column, role: Column, playbook: Column,
                 task_classes: Sequence[str], playbooks: Sequence[str]) -> Column:
    """Reasons against a spec, none if it is valid."""
    no = lambda ok, reason: F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason))
    return F.filter(F.array(
        no(id_.rlike("^[a-z0-9][a-z0-9-]{1,40}$"), "id"), no(_line_ok(name, 60), "name"), no(task_class.isin(*task_classes), "task_class"),
        no(k.between(3, 12), "k"), no((focus == "") | focus.rlike("^[a-z0-9][a-z0-9 -]{0,79}$"), "focus"), no(_line_ok(role, 140), "role"),
        no(playbook.isin(*playbooks), "playbook")), lambda x: x.isNotNull())


def artifact_kind(path: Column) -> Column:
    """What a file is by its ending."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end.isin("csv", "tsv", "xlsx"), "table").when(end.isin("md", "txt", "pdf", "docx"), "document").when(end.isin("png", "jpg", "svg"), "image").otherwise("file")
