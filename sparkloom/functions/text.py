"""Text functions as column expressions; all stay in the JVM unless they say otherwise.

``\\w`` and ``\\b`` are asked for in their Unicode form, so that they mean the same on every Java version.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: words that end a fragment without ending a claim, hedges, negations
ABBREVIATIONS = ("eg", "ie", "etc", "vs", "no", "mr", "ms", "dr", "rs", "approx", "cr")
HEDGE = r"(?i)don't cover|do not cover|no.{0,10}record|not.{0,6}(found|covered)|cannot find"
EVAL_HEDGE = r"(?i)don't cover|do not cover|no.{0,12}record|not.{0,8}(found|covered|available)|cannot (find|confirm|verify)|no (evidence|information|data)|records don't|not.{0,6}in the"
NEGATION = r"(?i)\b(not|no|never|isn't|aren't|don't|doesn't|cannot|incorrect|false|actually|rather|instead|different|differ|differs|separate)\b"
CLAIM_BORDER = r"(?<=[.!?])\s+(?=[A-Z\"'\[])"
THEMES = (("interviews", ("interview",)), ("competitor-notes", ("competitor",)), ("prds", ("prd", "roadmap")))

#: Abbreviations that the dotless comparison can meet ("e.g" and "i.e" never do).
_MERGING = tuple(x for x in ABBREVIATIONS if x not in ("eg", "ie"))


def words(text: Column, least: int) -> Column:
    """Distinct lower-case words of at least ``least`` word characters, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"((?U)\w{{{least},}})"), F.lit(1)))


def content_words(text: Column) -> Column:
    return words(text, 4)


def intent_terms(text: Column) -> Column:
    return words(text, 3)


def split_claims(text: Column) -> Column:
    """Claim sentences. A fragment whose own last word is an abbreviation joins the one before it."""
    parts = F.filter(F.transform(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")), CLAIM_BORDER), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    last = lambda x: F.regexp_replace(F.lower(F.element_at(F.split(x, r"\s+"), -1)), "[^a-z]", "")

    def add(done: Column, part: Column) -> Column:
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), part)))
        return F.when((F.size(done) > 0) & last(part).isin(*_MERGING), joined).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def is_hedge(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(HEDGE)


def fabricated(answer: Column, forbidden: Column) -> Column:
    """Whether a claim states the forbidden pattern without negating it, in an answer that is no hedge."""
    states = F.exists(split_claims(answer), lambda s: F.regexp_like(s, F.concat(F.lit("(?i)"), forbidden)) & ~s.rlike(NEGATION))
    return F.coalesce(answer, F.lit("")).rlike("(?s).") & ~F.coalesce(answer, F.lit("")).rlike(EVAL_HEDGE) & states


def collapse(text: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def snippet(text: Column, chars: int = 150) -> Column:
    return F.substring(collapse(text), 1, chars)


def theme_of(path: Column) -> Column:
    """The first theme one of whose words stands in the path."""
    out = None
    for theme, needles in THEMES:
        hit = F.lower(path).rlike("|".join(needles))
        out = F.when(hit, theme) if out is None else out.when(hit, theme)
    return out.otherwise("other")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def title_hits(title: Column, terms: Column) -> Column:
    """How many terms stand in the title, two at most."""
    return F.least(F.size(F.filter(terms, lambda t: F.contains(F.lower(title), t))), F.lit(2))


def verbatim_window(text: Column, limit: int = 700) -> Column:
    """A clean verbatim window: a ragged start is skipped up to a sentence or line end within 220 characters; a long
    text ends with its last sentence if that is past half of the limit."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    ragged = t.rlike(r"^(?U)[\p{Ll},;:)\]}]")
    border = F.regexp_extract(F.substring(t, 1, 220), r"(?s)^(.*?(?:[.!?]\s+|\n))", 1)
    t = F.when(ragged & (F.length(border) > 0), F.regexp_replace(F.substring(t, F.length(border) + 1, F.lit(1 << 30)), r"^\s+", "")).otherwise(t)
    cut = F.substring(t, 1, limit)
    sentence = F.regexp_extract(cut, r"(?s)^(.*(?:\.(?= |\n)|[!?](?= )))", 1)
    end = F.when(F.length(sentence) - 1 > limit // 2, sentence).otherwise(cut)
    return F.regexp_replace(F.when(F.length(t) > limit, end).otherwise(t), r"\s+$", "")


def loose_json(raw: Column) -> Column:
    """JSON text out of a chatty reply: thoughts and fences dropped, the outermost array preferred to the object."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    array, thing = F.regexp_extract(t, r"(?s)(\[.*\])", 1), F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(array != "", array).when(thing != "", thing)


def marker_hits(text: Column, markers: Sequence[str]) -> Column:
    """How many of the patterns are found."""
    return sum((F.coalesce(text.rlike(f"(?i){m}"), F.lit(False)).cast("int") for m in markers), F.lit(0))


def short_label(label: Column, chars: int = 28) -> Column:
    """The last path part, with an ellipsis beyond ``chars``."""
    name = base_name(label)
    return F.when(F.length(name) > chars, F.concat(F.substring(name, 1, chars - 1), F.lit("…"))).otherwise(name)


def admin_link(store: Column, product_id: Column) -> Column:
    return F.format_string("https://admin.shopify.com/store/%s/products/%s", store, product_id.cast("string"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, 2 * matches / total length; no builtin has it, so it runs after blocking only."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
