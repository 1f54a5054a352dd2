"""Guarding text: personal data is masked, instruction-like spans are named and neutralised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns by name, in the order in which they are applied
PII = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("aadhaar", r"(?<!\d)(?:\d{4}\s\d{4}\s\d{4}|\d{12})(?!\d)"),
    ("phone", r"(?<![\d])(?:\+?91[\-\s]?|0)?[6-9]\d{4}[\-\s]?\d{5}(?![\d])"),
)
INJECTION = (
    ("ignore_previous", r"ignore\s+(?:all\s+)?(?:the\s+)?previous\s+instructions"),
    ("disregard_above", r"disregard\s+(?:the\s+)?(?:above|previous|prior)"),
    ("forget_instructions", r"forget\s+(?:everything|all|your\s+instructions|the\s+above)"),
    ("you_are_now", r"you\s+are\s+now\s+(?:a|an|the|going)"),
    ("new_instructions", r"new\s+instructions\s*:"),
    ("reveal_prompt", r"(?:reveal|print|show|repeat)\s+(?:your\s+)?(?:system\s+)?prompt"),
    ("system_prompt_ref", r"system\s+prompt"),
    ("jailbreak", r"\b(?:jailbreak|DAN\s+mode)\b"),
    ("override_safety", r"(?:override|bypass|disable)\s+(?:your\s+)?(?:safety|guardrails|restrictions)"),
)
MASK = "[REDACTED-PII]"
SUMMARY_CHARS = 400


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def scrub_pii(text: Column) -> Column:
    """struct<text, found>: the masked text and the number of masks; each pass counts on what the one before left."""
    out = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(0).alias("found"))
    for _, pattern in PII:
        out = _let(out, _pass(pattern))
    return out


def _pass(pattern: str):
    return lambda x: F.struct(F.regexp_replace(x["text"], pattern, MASK).alias("text"), (x["found"] + F.regexp_count(x["text"], F.lit(pattern))).cast("int").alias("found"))


def _finding(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("type"), x.alias("original"))


def pii_findings(text: Column) -> Column:
    """array<struct<type, original>> for a restricted audit sink."""
    now, out = F.coalesce(text, F.lit("")), []
    for kind, pattern in PII:
        out.append(F.transform(F.regexp_extract_all(now, F.lit(f"({pattern})"), F.lit(1)), _finding(kind)))
        now = F.regexp_replace(now, pattern, MASK)
    return F.flatten(F.array(*out))


def scan_injection(text: Column) -> Column:
    """Names of the patterns found, in their order."""
    text = F.coalesce(text, F.lit(""))
    return F.filter(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(n)) for n, p in INJECTION)), lambda x: x.isNotNull())


def neutralise(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for _, pattern in INJECTION:
        out = F.regexp_replace(out, f"(?i){pattern}", "[flagged]")
    return out


def guard(text: Column) -> Column:
    """struct<text, pii_redacted, injection_risk, injection_patterns>; the scan sees the masked text."""
    marked = _let(scrub_pii(text), lambda c: F.struct(c["text"].alias("text"), c["found"].alias("found"), scan_injection(c["text"]).alias("names")))
    return _let(marked, lambda m: F.struct(m["text"].alias("text"), m["found"].alias("pii_redacted"), (F.size(m["names"]) > 0).alias("injection_risk"), m["names"].alias("injection_patterns")))


def context_block(stored_id: Column, guarded: Column) -> Column:
    """The only text of a connector's result that may go on: the masked text, or a reference with a neutral summary."""
    names = guarded["injection_patterns"]
    withheld = F.concat(F.lit("[connector_result_stored:"), stored_id.cast("string"), F.lit("] (flagged: "), F.array_join(names, ", "),
                        F.lit(" — content withheld) summary: "), F.substring(neutralise(guarded["text"]), 1, SUMMARY_CHARS))
    return F.when(guarded["injection_risk"], withheld).otherwise(guarded["text"])


def outbound(text: Column, secrets: list[str] | None = None) -> Column:
    """Text on its way out: masked; withheld if flagged; known secrets blanked."""
    guarded = guard(text)
    clean = guarded["text"]
    for secret in secrets or []:
        clean = F.replace(clean, F.lit(secret), F.lit("[REDACTED-SECRET]"))
    return F.when(guarded["injection_risk"], F.concat(F.lit("[withheld: "), F.array_join(guarded["injection_patterns"], ", "), F.lit("]"))).otherwise(clean)
