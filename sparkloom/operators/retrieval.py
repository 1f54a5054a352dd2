"""Hybrid retrieval: exact vector search, BM25, rank fusion, pooling by document.

Every ranking ends with the point id, so that results do not depend on the partitioning. A top-k is a bounded heap per
task and a merge of heaps, never a sort of all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import scores
from sparkloom.functions.text import title_hits, verbatim_window
from sparkloom.operators.words import Index, keyword_lists, keyword_search

POOL, PER_DOC, DEDUP_CHARS = 8, 2, 80
QUERY_BLOCK = 2048
_CELLS, _NINTH = 1 << 21, Decimal("1e-9")  # scores held at a time


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Positions from 0 of a result that a limit has made small."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def vector_top_k(points: DataFrame, query: Sequence[float] | Column, k: int, id_col: str = "point_id", vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k most similar points by cosine; ``where`` is applied before scoring, so the k are exact."""
    vec = F.array(*(F.lit(float(x)) for x in query)) if not isinstance(query, Column) else query
    points = points if where is None else points.where(where)
    scored = points.withColumn("score", F.round(scores.cosine(F.col(vec_col), vec), 9)).where("score is not null")
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def pre_ranked(hits: DataFrame, stamp: Column, as_of: Column, id_col: str = "point_id") -> DataFrame:
    """Vector hits by similarity and freshness."""
    mixed = hits.withColumn("pre_score", F.round(scores.pre_rank(F.col("score"), scores.recency(stamp, as_of)), 9))
    return ranked(mixed, [F.desc("pre_score"), F.col(id_col)])


def _fused_each(vector_hits: DataFrame, keyword_hits: DataFrame, limit: int) -> DataFrame:
    """fuse() for each question: (query, point_id, rrf, vscore, raw, fused_rank)."""
    both = vector_hits.select("query", "point_id", "rank", F.col("vscore").cast("double")).unionByName(keyword_hits.select("query", "point_id", "rank", F.lit(None).cast("double").alias("vscore")))
    summed = both.groupBy("query", "point_id").agg(F.sum(scores.rrf(F.col("rank"))).alias("raw"), F.max("vscore").alias("vscore")).withColumn("raw", F.round("raw", 9))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("raw"), "point_id")) - 1
    return summed.withColumn("fused_rank", nth).where(F.col("fused_rank") < limit).withColumn("rrf", F.round("raw", 5))


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion of (point_id, rank, vscore) and (point_id, rank): point_id, rrf, vscore."""
    both = vector_hits.select("point_id", "rank", F.col("vscore").cast("double")).unionAll(keyword_hits.select("point_id", "rank", F.lit(None).cast("double")))
    summed = both.groupBy("point_id").agg(F.sum(scores.rrf(F.col("rank"))).alias("raw"), F.max("vscore").alias("vscore"))
    kept = summed.withColumn("raw", F.round("raw", 9)).orderBy(F.desc("raw"), "point_id").limit(limit)
    return kept.select("point_id", F.round("raw", 5).alias("rrf"), "vscore", "raw")


def first_of_each(hits: DataFrame, source: Column, chunk: Column, text: Column, order: Sequence[Column], each: Sequence[str] = ()) -> DataFrame:
    """Of hits that show the same passage the best one; flagged ones go first of all. each: what tells questions apart."""
    safe = hits.where(~F.coalesce(F.col("injection_risk"), F.lit(False)))
    w = Window.partitionBy(*each, source, chunk, F.substring(F.coalesce(text, F.lit("")), 1, DEDUP_CHARS)).orderBy(*order)
    return safe.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pooled(hits: DataFrame, k: int) -> DataFrame:
    """Hits (source, rrf, fused_rank) by document: documents by their two best hits' sum, two hits of each, k in all."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy("fused_rank"))
    of_doc = Window.partitionBy("source")
    both = hits.withColumn("nth", nth).where(F.col("nth") <= PER_DOC)
    both = both.withColumns({"doc_score": F.round(F.sum("rrf").over(of_doc), 5), "first_rank": F.min("fused_rank").over(of_doc)})
    return both.orderBy(F.desc("doc_score"), "first_rank", "nth").limit(k)


def shown_title(title: Column, source: Column) -> Column:
    """The title, or the file name of the source where there is none."""
    return F.coalesce(F.nullif(title, F.lit("")), F.regexp_extract(F.coalesce(source, F.lit("")), r"([^/]*)$", 1))


def retrieve(points: DataFrame, index: Index, question: str, query_vector: Sequence[float] | Column, as_of: Column, k: int = 6) -> DataFrame:
    """The whole chain over points (point_id, source, title, chunk_index, created_at, text, injection_risk, embedding) and their stored index.

    Returns point_id, source, rrf, vscore, doc_score, fused_rank and position.
    """
    pool = k * POOL
    near = vector_top_k(points.select("point_id", "created_at", "embedding"), query_vector, pool)
    near = pre_ranked(near, F.col("created_at"), as_of).withColumnRenamed("score", "vscore")
    words = ranked(keyword_search(index, question, k * 4), [F.desc("bm25"), F.col("point_id")])
    fused = ranked(fuse(near, words, pool), [F.desc("raw"), F.col("point_id")], "fused_rank")
    shown = points.select("point_id", "source", "title", "chunk_index", "text", "injection_risk")
    hits = shown.join(F.broadcast(fused), "point_id")  # at most ``pool`` rows
    kept = first_of_each(hits, F.col("source"), F.col("chunk_index"), F.col("text"), [F.col("fused_rank")])
    terms = F.array(*(F.lit(t) for t in dict.fromkeys(re.findall(r"\w{4,}", question.lower())))).cast("array<string>")
    bonus = scores.TITLE_BONUS * title_hits(shown_title(F.col("title"), F.col("source")), terms)
    out = pooled(kept.withColumn("rrf", F.round(F.col("rrf") + bonus, 5)), k)
    return ranked(out, [F.desc("doc_score"), F.col("first_rank"), F.col("nth")], "position").select("point_id", "source", "title", "chunk_index", "text", "rrf", "vscore", "doc_score", "fused_rank", "position")


def retrieve_each(points: DataFrame, index: Index, asked: DataFrame, as_of: Column, k: int = 6) -> DataFrame:
    """retrieve() for many questions (query, question, vector) in one plan, each step by question; what it returns, with ``query``.

    Questions are words, or else phrases as a whole; the query syntax is for single ones.
    """
    pool = k * POOL
    of = lambda *order: F.row_number().over(Window.partitionBy("query").orderBy(*order)) - 1
    near = scored_each(points.select("point_id", "embedding"), asked.select("query", F.col("vector").alias("asked")), pool, "point_id").withColumnRenamed("id", "point_id")
    near = near.join(points.select("point_id", "created_at"), "point_id")
    near = near.withColumn("pre_score", F.round(scores.pre_rank(F.col("score"), scores.recency(F.col("created_at"), as_of)), 9)).withColumn("rank", of(F.desc("pre_score"), "point_id"))
    found = keyword_lists(index, asked.select("query", F.col("question").alias("text")), k * 4).withColumn("rank", of(F.desc("bm25"), "point_id"))
    fused = _fused_each(near.withColumnRenamed("score", "vscore"), found, pool)
    hits = fused.join(points.select("point_id", "source", "title", "chunk_index", "text", "injection_risk"), "point_id").join(asked.select("query", "question"), "query")
    kept = first_of_each(hits, F.col("source"), F.col("chunk_index"), F.col("text"), [F.col("fused_rank")], ["query"])
    terms = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"((?U)\w{4,})"), F.lit(1)))
    kept = kept.withColumn("rrf", F.round(F.col("rrf") + scores.TITLE_BONUS * title_hits(shown_title(F.col("title"), F.col("source")), terms), 5))
    of_doc = Window.partitionBy("query", "source")
    both = kept.withColumn("nth", F.row_number().over(of_doc.orderBy("fused_rank"))).where(F.col("nth") <= PER_DOC)
    both = both.withColumns({"doc_score": F.round(F.sum("rrf").over(of_doc), 5), "first_rank": F.min("fused_rank").over(of_doc)})
    out = both.withColumn("position", of(F.desc("doc_score"), "first_rank", "nth")).where(F.col("position") < k)
    return out.select("query", "point_id", "source", "title", "chunk_index", "text", "rrf", "vscore", "doc_score", "fused_rank", "position")


def citations(hits: DataFrame, date: Column) -> DataFrame:
    """How a hit is shown: source, chunk, date, score of three places, snippet."""
    return hits.select("position", F.coalesce("source", "title", F.lit("unknown")).alias("source"), F.coalesce("chunk_index", F.lit(0)).alias("chunk"),
                       F.substring(date, 1, 10).alias("date"), F.round("vscore", 3).alias("score"), F.substring(F.coalesce("text", F.lit("")), 1, 400).alias("snippet"))


def find_docs(hits: DataFrame, k: int = 5) -> DataFrame:
    """Hits (source, position, vscore, chunk_index) by document: the first hit ranks it, its best score and two chunks are kept."""
    two = F.slice(F.array_sort(F.collect_list(F.struct("position", "chunk_index"))), 1, 2)
    docs = hits.groupBy("source").agg(F.min("position").alias("best_rank"), F.round(F.max("vscore"), 3).alias("best_score"), F.transform(two, lambda x: x["chunk_index"]).alias("chunks"))
    return docs.orderBy("best_rank").limit(k)


def extractive_answer(hits: DataFrame) -> DataFrame:
    """The passage with the highest vector score as a clean window; no vector score counts as -1."""
    order = F.struct(F.coalesce("vscore", F.lit(-1.0)), -F.col("position"))
    return hits.agg(F.max_by("point_id", order).alias("point_id"), F.max_by("text", order).alias("text")).select("point_id", verbatim_window(F.col("text")).alias("answer"))


def vector_top_k_each(points: DataFrame, asked: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(query, id, n): the k most similar points of each of a stated set of queries (query, asked), exact."""
    return scored_each(points, asked, k, id_col, vec_col).select("query", "id", "n")


def scored_each(points: DataFrame, asked: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """vector_top_k_each() with the score.

    Queries meet the points in blocks of both, each pair of blocks in one task as a product of matrices; only k rows a query
    leave a task. There is a block for every QUERY_BLOCK queries, and blocks of points for about two tasks a partition. Scores
    are those of scores.cosine(), rounded alike.
    """
    tasks = 2 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = max(1, -(-asked.count() // QUERY_BLOCK))
    p = max(1, -(-tasks // q))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select("query", "asked").withColumns({"qa": deal("query", q), "pa": F.explode(F.sequence(F.lit(0), F.lit(p - 1)))})
    right = points.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).withColumns({"pa": deal("id", p), "qa": F.explode(F.sequence(F.lit(0), F.lit(q - 1)))})
    kinds = T.StructType([T.StructField("query", left.schema["query"].dataType), T.StructField("id", right.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    block = lambda queries, rows: _nearest(queries, rows, k)
    best = left.groupBy("qa", "pa").cogroup(right.groupBy("qa", "pa")).applyInArrow(block, kinds)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return best.withColumn("n", nth).where(F.col("n") <= k)


def _matrix(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length the rows' numbers and their vectors; rows that are null or hold a null have no score with any other."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets, values = flat.offsets.to_numpy(), flat.values
    ends = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    whole = flat.is_valid().to_numpy(zero_copy_only=False) & (ends[offsets[1:]] == ends[offsets[:-1]])
    numbers, sizes = values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(offsets)
    out = {}
    for size in np.unique(sizes[whole & (sizes > 0)]):
        rows = np.flatnonzero(whole & (sizes == size))
        out[int(size)] = (rows, numbers[offsets[rows][:, None] + np.arange(size)])
    return out


def _products(a: np.ndarray, b: np.ndarray, of: np.ndarray | slice = slice(None), with_: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Inner products of some rows with some others, summed in the order that scores.dot() has."""
    total = 0.0
    for x, y in zip(a.T, b.T, strict=True):
        total = total + x[of] * y[with_]
    return total


def _rounded(score: np.ndarray) -> np.ndarray:
    """Half up at nine places of a number's shortest decimal form, as Spark rounds."""
    values, at = np.unique(score, return_inverse=True)
    one = lambda x: float(Decimal(repr(x)).quantize(_NINTH, ROUND_HALF_UP)) + 0.0 if math.isfinite(x) else x
    return np.array([one(float(x)) for x in values])[at]


def _nearest(queries: pa.Table, points: pa.Table, k: int) -> pa.Table:
    """(query, id, score): for each query of a block the k best points of a block."""
    ids, found = points["id"].combine_chunks(), []
    by_id = np.empty(len(ids), dtype=np.int64)  # positions in the order of ids
    by_id[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    stored = _matrix(points["vec"])
    with np.errstate(all="ignore"):
        for size, (own, asked) in _matrix(queries["asked"]).items():
            rows, vectors = stored.get(size, (None, None))
            if rows is None:
                continue
            norms, asked_norms = np.sqrt(_products(vectors, vectors)), np.sqrt(_products(asked, asked))
            step = max(1, _CELLS // len(rows))
            for begin in range(0, len(own), step):
                part = slice(begin, begin + step)
                norm = asked_norms[part, None] * norms
                near = (asked[part] @ vectors.T) / norm
                near[np.isnan(near)] = np.inf  # the largest one, as in Spark
                near[~((norm > 0) | np.isnan(norm))] = -np.inf
                # sums in another order differ far less than two scores that are equal in nine places
                least = np.partition(near, -k, axis=1)[:, -k, None] - 3e-9 if len(rows) > k else -np.inf
                i, j = np.nonzero((near >= least) & (near > -np.inf))
                score = _rounded(_products(asked[part], vectors, i, j) / (norms[j] * asked_norms[part][i]))
                order = np.lexsort((by_id[rows[j]], -np.where(np.isnan(score), np.inf, score), i))
                order = order[np.arange(len(i)) - np.searchsorted(i, i) < k]  # i is sorted, before and after
                found.append((own[part][i[order]], rows[j[order]], score[order]))
    q, p, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({"query": queries["query"].combine_chunks().take(pa.array(q)), "id": ids.take(pa.array(p)), "score": score})


def gate(hits: DataFrame, markers: Sequence[str], date: Column, top: int = 3) -> DataFrame:
    """One row: whether a marker stands in one of the ``top`` first passages, whether all hits have a breadcrumb, and both."""
    found = F.col("position") < top
    marked = F.greatest(*(F.contains(F.lower("text"), F.lit(m.lower())) for m in markers), F.lit(False))
    crumb = (F.coalesce("source", F.lit("")) != "") & (F.coalesce(date, F.lit("")) != "")
    out = hits.agg(F.coalesce(F.max(found & marked), F.lit(False)).alias("marker_in_top"), F.coalesce(F.min(crumb), F.lit(False)).alias("breadcrumb"))
    return out.withColumn("passed", F.col("marker_in_top") & F.col("breadcrumb"))


def top_k_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query, overlap): share of the k ids (query, id) that two result lists have in common."""
    rows = a.select("query", "id", F.lit(1).alias("side")).unionAll(b.select("query", "id", F.lit(2).alias("side")))
    met = rows.groupBy("query", "id").agg(F.max(F.col("side") == 1).alias("in_a"), (F.count_distinct("side") == 2).alias("in_both"))
    named = F.col("query").isNotNull() & F.col("id").isNotNull()
    return met.where("in_a").groupBy("query").agg((F.count_if(F.col("in_both") & named) / F.lit(k)).alias("overlap"))
