"""Identity forms of labels, and money amounts.

Compatibility folding (NFKC) and case folding have no builtin, so the Unicode forms are Arrow-batched UDFs meant for
distinct labels; the ``ascii_`` forms are column expressions and equal to them on ASCII text.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values
MONEY = r"(?i)(?:₹|Rs\.?|INR)\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(crores?|cr|lakhs?|lacs?|thousand|million|billion|mn|bn|[lkmb])?\b"
UNITS = {
    "k": 1e3, "thousand": 1e3, "l": 1e5, "lac": 1e5, "lacs": 1e5, "lakh": 1e5, "lakhs": 1e5, "m": 1e6, "mn": 1e6, "million": 1e6,
    "cr": 1e7, "crore": 1e7, "crores": 1e7, "b": 1e9, "bn": 1e9, "billion": 1e9,
}
MONEY_FLOOR = 1000.0
_POSSESSIVE = r"['’]s\b|['’]$"
_EDGES = " ,.;:!?'\"-—–"


def _key(label: str | None) -> str | None:
    if label is None:
        return None
    bare = re.sub(_POSSESSIVE, "", unicodedata.normalize("NFKC", label)).casefold()
    return " ".join(re.sub(r"[^\w\s]|_", " ", bare).split())


@F.pandas_udf(T.StringType())
def canonical_key(label: pd.Series) -> pd.Series:
    """Identity: folded, without possessive and punctuation."""
    return label.map(_key, na_action="ignore")


@F.pandas_udf(T.StringType())
def alias_key(label: pd.Series) -> pd.Series:
    """A spelling: folded, with possessive and punctuation kept."""
    return label.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split()), na_action="ignore")


@F.pandas_udf(T.StringType())
def display_label(label: pd.Series) -> pd.Series:
    """How an entity is shown: without possessive and edge punctuation."""
    return label.map(lambda x: " ".join(re.sub(_POSSESSIVE, "", unicodedata.normalize("NFKC", x).strip()).split()).strip(_EDGES), na_action="ignore")


def ascii_key(label: Column) -> Column:
    bare = F.lower(F.regexp_replace(label, r"'s\b|'$", ""))
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def ascii_label(label: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(label), r"'s\b|'$", ""), r"\s+", " "))
    return F.regexp_replace(bare, r"""^[ ,.;:!?'"-]+|[ ,.;:!?'"-]+$""", "")


def _compact(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), r"\.$", "")


def format_money(value: Column) -> Column:
    """One spelling for each amount."""
    out = F.when(value >= 1e7, F.concat(F.lit("₹"), _compact(value / 1e7), F.lit("Cr"))).when(value >= 1e5, F.concat(F.lit("₹"), _compact(value / 1e5), F.lit("L")))
    return out.when(value >= 1e3, F.concat(F.lit("₹"), _compact(value / 1e3), F.lit("k"))).when(value.isNotNull(), F.concat(F.lit("₹"), _compact(value)))


def parse_money(label: Column) -> Column:
    """struct<value, magnitude, label, key, qualifies>, or null where no amount with a currency stands."""
    amount = F.regexp_replace(F.regexp_extract(label, MONEY, 1), ",", "")
    unit = F.lower(F.regexp_extract(label, MONEY, 2))
    table = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    value = amount.try_cast("double") * F.coalesce(F.try_element_at(table, unit), F.lit(1.0))
    whole = F.struct(value.alias("value"), F.nullif(unit, F.lit("")).alias("magnitude"), format_money(value).alias("label"),
                     F.format_string("inr:%.2f", value).alias("key"), ((unit != "") | (value >= MONEY_FLOOR)).alias("qualifies"))
    return F.when(label.rlike(MONEY), whole)
