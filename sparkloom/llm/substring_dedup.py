"""Substring dedup by hashing lines, and runs of sentences within and across them.

A text's pieces are the sentences of its lines; a line without sentence ends is one piece. Pieces are normalised (lower
case, runs of space and 0x09-0x0D to one space, trimmed). Units are

* each line, whatever its length, and
* each piece together with the pieces after it, over line ends, until they hold ``min_words`` words, for passages that are
  wrapped at other places or stand inside a paragraph; a sequence of 13 words is commonly taken for an overlap that is no chance.

All units are hashed alike to 128 bits, the digests are grouped over all documents, and the unit of the smallest doc_id stays, in
that document at its first place; the pieces of all others go. Every piece that goes equals one that stays. Removed pieces keep
their offsets in the original text, neighbouring ones as one span. ``min_line_words`` keeps lines of fewer words, as marks that
a corpus repeats on purpose; it is 1 if not given, so that every repeated line goes.

Defined results: blank pieces are no units and stay, but a line of which only blanks are left goes; null texts stay null
without units; ids may have any type that can be ordered; null ids rank after all others and count as one document, as do
rows that share an id; within one document the first occurrence stays; an empty table gives an empty result; other columns
are carried along whatever their names, and columns named as an output are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.llm.arrow import bound_batches, fresh, give_back, map_columns, slices

MIN_WORDS = 13
_PIECE = re.compile(r"[^\n]+?(?:[.!?] +|\n|\Z)|\n")  # all of a text, piece by piece; a line end goes with the piece before
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


def normalise(piece: str) -> str:
    return _BLANK.sub(" ", piece.lower()).strip(" ")


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pieces(text: str) -> tuple[list[str], list[str]]:
    """The pieces of a text, which join to it, and their normal forms."""
    found = _PIECE.findall(text)
    return found, [normalise(x) for x in found]


def units(found: list[str], clean: list[str], min_words: int = MIN_WORDS, min_line_words: int = 1) -> list[tuple[int, int, str]]:
    """(first piece, last piece, key) of each unit, by first piece; blank pieces are passed over."""
    solid = [i for i, x in enumerate(clean) if x]
    sizes = [clean[i].count(" ") + 1 for i in solid]
    out: list[tuple[int, int, str]] = []
    reach: dict[int, int] = {}
    last, words = -1, 0
    for at, i in enumerate(solid):
        while words < min_words and last + 1 < len(solid):
            last += 1
            words += sizes[last]
        if words < min_words:
            break
        reach[i] = solid[last]
        out.append((i, solid[last], " ".join([clean[x] for x in solid[at : last + 1]])))
        words -= sizes[at]
    line: list[int] = []
    for i, piece in enumerate(found):
        if clean[i]:
            line.append(i)
        if line and (i + 1 == len(found) or piece.endswith("\n")):
            if reach.get(line[0]) != line[-1]:  # else it is a unit already
                key = " ".join([clean[x] for x in line])
                if min_line_words < 2 or key.count(" ") + 1 >= min_line_words:
                    out.append((line[0], line[-1], key))
            line = []
    out.sort(key=lambda x: x[0])
    return out


def _unit_rows(docs: DataFrame, id_col: str, text_col: str, min_words: int, min_line_words: int) -> DataFrame:
    """(doc, row, first, last, hi, lo, again): again marks a unit that its own text has shown before."""
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(f"`{text_col}`").alias("row"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    schema = T.StructType([T.StructField("doc", kind), *T._parse_datatype_string("row long, first int, last int, hi long, lo long, again boolean").fields])
    kinds = [to_arrow_type(kind), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, row, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    seen = set()
                    for first, last, key in units(*pieces(text), min_words, min_line_words):
                        digest = xxhash.xxh3_128_intdigest(key)
                        out.append((doc, row, first, last, _long(digest >> 64), _long(digest & ((1 << 64) - 1)), digest in seen))
                        seen.add(digest)
                columns = zip(*out, strict=True) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)
        give_back()

    bound_batches(docs.sparkSession)
    return source.mapInArrow(run, schema)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_line_words: int = 1) -> DataFrame:
    """(doc, row, cut): for each row of the table that loses units, these and the document that keeps each."""
    rows = _unit_rows(docs, id_col, text_col, min_words, min_line_words)
    first = rows.groupBy("hi", "lo").agg(F.min("doc").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # dealt anew, so that the join shuffles both sides and AQE can split the units of a very common line
    first = first.repartition(F.xxhash64("hi"))
    gone = rows.join(first, ["hi", "lo"]).where("again or not (doc <=> keeper)")
    return gone.groupBy("doc", "row").agg(F.collect_set(F.struct("first", "last", "keeper")).alias("cut"))


def without(text: str, lost: list[tuple[int, int, object]]) -> tuple[str, list[tuple[int, int, object]]]:
    """The text without the pieces of the units (first, last, keeper), and the spans (start, length, keeper) that went."""
    found, clean = pieces(text)
    keeper: list = [None] * len(found)
    gone = [False] * len(found)
    for first, last, who in sorted(lost, key=lambda x: x[:2], reverse=True):
        for i in range(first, last + 1):
            gone[i], keeper[i] = True, who
    kept, spans, at = [], [], 0
    line: list[int] = []
    for i, piece in enumerate(found):
        line.append(i)
        if gone[i]:
            if spans and spans[-1][2] == keeper[i] and spans[-1][0] + spans[-1][1] == at:
                spans[-1] = (spans[-1][0], spans[-1][1] + len(piece), keeper[i])
            else:
                spans.append((at, len(piece), keeper[i]))
        at += len(piece)
        if piece.endswith("\n") or i + 1 == len(found):
            left = [k for k in line if not gone[k]]
            if len(left) == len(line) or any(clean[k] for k in left):
                kept.append("".join([found[k] for k in left]).removesuffix("\n"))
            line = []
    if not found or found[-1].endswith("\n"):
        kept.append("")
    return "\n".join(kept), spans


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_line_words: int = 1) -> DataFrame:
    """``docs`` with the text rebuilt and the columns n_removed, chars_removed and removed (spans of the original)."""
    doc, row, cut = (fresh(x, docs) for x in ("cut_doc", "cut_row", "cut_units"))
    found = repeated_units(docs, id_col, text_col, min_words, min_line_words).toDF(doc, row, cut)
    joined = docs.join(found, docs[f"`{id_col}`"].eqNullSafe(found[doc]) & (F.xxhash64(docs[f"`{text_col}`"]) == found[row]), "left").drop(doc, row)

    def rebuild(text: pa.Array, gone: pa.Array) -> list:
        texts, counts, chars, removed = [], [], [], []
        for whole, lost in zip(text.to_pylist(), gone.to_pylist(), strict=True):
            spans: list = []
            if lost:
                whole, spans = without(whole, [(x["first"], x["last"], x["keeper"]) for x in lost])
            texts.append(whole)
            counts.append(len(spans))
            chars.append(sum(x[1] for x in spans))
            removed.append([{"start": a, "length": b, "first_doc_id": c} for a, b, c in spans])
        return [texts, counts, chars, removed]

    keep = [c for c in docs.columns if c != text_col]
    made = f"`{text_col}` string, n_removed bigint, chars_removed bigint, removed array<struct<start:int,length:int,first_doc_id:{docs.schema[id_col].dataType.simpleString()}>>"
    out = map_columns(joined, {"text": text_col, "gone": cut}, made, rebuild, keep)
    return out.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*docs.columns, "n_removed", "chars_removed", "removed"])))


ORACLE_SQL = r"""
WITH cut AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]+?(?:[.!?] +|\n|\z)|\n') AS found FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, unnest(found) AS piece, generate_subscripts(found, 1) AS i FROM cut),
clean AS (SELECT *, trim(regexp_replace(lower(piece), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS own, sum(length(piece)) OVER w - length(piece) AS at_char,
  sum((piece LIKE '%' || chr(10))::INT) OVER w - (piece LIKE '%' || chr(10))::INT AS line FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
solid AS (SELECT doc_id, i, own, len(string_split(own, ' ')) AS words, row_number() OVER w AS s, sum(len(string_split(own, ' '))) OVER w AS so_far FROM clean WHERE own <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
whole AS (SELECT doc_id, list(own ORDER BY s) AS owns FROM solid GROUP BY doc_id),
reach AS (SELECT a.doc_id, a.s, a.i AS a, b.s AS t, b.i AS b FROM (SELECT *, so_far - words + 13 AS need FROM solid) a ASOF JOIN solid b ON a.doc_id = b.doc_id AND a.need <= b.so_far),
units AS (SELECT r.doc_id, r.a, r.b, array_to_string(w.owns[r.s:r.t], ' ') AS unit FROM reach r JOIN whole w USING (doc_id)
  UNION SELECT doc_id, min(i), max(i), string_agg(own, ' ' ORDER BY i) FROM clean WHERE own <> '' GROUP BY doc_id, line),
ranked AS (SELECT *, min(doc_id) OVER (PARTITION BY unit) AS keeper, row_number() OVER (PARTITION BY unit, doc_id ORDER BY a) AS again FROM units),
gone AS (SELECT c.doc_id, c.i, arg_min(g.keeper, (g.a, g.b)) AS keeper FROM clean c JOIN ranked g ON c.doc_id = g.doc_id AND c.i BETWEEN g.a AND g.b WHERE g.again > 1 OR g.doc_id <> g.keeper GROUP BY c.doc_id, c.i),
marked AS (SELECT c.*, g.keeper, g.i IS NOT NULL AS lost FROM clean c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.i = g.i),
lines AS (SELECT doc_id, line, coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE NOT lost), '') AS body FROM marked GROUP BY doc_id, line HAVING NOT bool_or(lost) OR bool_or(NOT lost AND own <> '')),
ended AS (SELECT doc_id, line, regexp_replace(body, '\n$', '') AS body FROM lines UNION ALL SELECT doc_id, 9223372036854775807, '' FROM cut WHERE text = '' OR text LIKE '%' || chr(10)),
kept AS (SELECT doc_id, string_agg(body, chr(10) ORDER BY line) AS text FROM ended GROUP BY doc_id),
runs AS (SELECT doc_id, keeper, at_char, length(piece) AS n, i - row_number() OVER (PARTITION BY doc_id, keeper ORDER BY i) AS run FROM marked WHERE lost),
spans AS (SELECT doc_id, keeper, min(at_char)::BIGINT AS a, sum(n)::BIGINT AS n FROM runs GROUP BY doc_id, keeper, run),
per AS (SELECT doc_id, count(*) AS n_removed, sum(n)::BIGINT AS chars_removed, string_agg(a || '+' || n || '@' || keeper, ';' ORDER BY a) AS removed FROM spans GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(p.n_removed, 0)::BIGINT AS n_removed,
  coalesce(p.chars_removed, 0)::BIGINT AS chars_removed, coalesce(p.removed, '') AS removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN per p USING (doc_id)
"""
