"""Scores, hashes and their arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
RRF_K = 60
W_SIMILARITY, W_RECENCY = 0.6, 0.10
HALF_LIFE_DAYS = 90.0
TITLE_BONUS = 0.008
BM25_K1, BM25_B, BM25_FLOOR = 1.2, 0.75, 1e-6


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def idf(n_docs: Column, df: Column) -> Column:
    raw = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(BM25_FLOOR)).otherwise(raw)


def bm25_term(idf_: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    """One term's share; more is better."""
    return idf_ * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean_length))


def rrf(rank0: Column) -> Column:
    return F.lit(1.0) / (F.lit(float(RRF_K)) + rank0)


def recency(stamp: Column, as_of: Column) -> Column:
    """Half-life decay from the first ten characters of a date; 0 without a date, 1 for the future."""
    day = F.try_to_timestamp(F.substring(stamp, 1, 10), F.lit("yyyy-MM-dd"))
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(as_of) - F.unix_timestamp(day)) / 86400.0)
    return F.when(day.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), age / HALF_LIFE_DAYS))


def pre_rank(similarity: Column, recency_: Column) -> Column:
    return W_SIMILARITY * similarity + W_RECENCY * recency_


def pmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.log2(n_ab * n / (n_a * n_b))), 4)


def npmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    p = n_ab / n
    raw = F.greatest(F.lit(0.0), F.log2(n_ab * n / (n_a * n_b))) / -F.log2(p)
    return F.when(p >= 1, F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 4))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.66, "high").when(confidence >= 0.33, "medium").otherwise("low")


def retrieval_confidence(score: Column, has_chunk: Column) -> Column:
    """A supporting chunk's similarity within 0..1; 0.5 for a keyword-only one, 0 without a chunk."""
    return F.when(~has_chunk, F.lit(0.0)).when(score.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are per million tokens; unknown prices cost nothing."""
    return (tokens_in * F.coalesce(price_in, F.lit(0.0)) + tokens_out * F.coalesce(price_out, F.lit(0.0))) / 1e6


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays, three places; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.round(F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union), 3)


def point_id(chunk_id: Column) -> Column:
    """63 bits of the id's SHA-256."""
    return F.shiftrightunsigned(F.conv(F.substring(F.sha2(chunk_id, 256), 1, 16), 16, -10).cast("long"), 1)


def chunk_id(doc_id: Column, index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", doc_id.cast("string"), index.cast("string"), text), 256)


def demo_product_id(sku: Column) -> Column:
    return F.conv(F.substring(F.sha2(sku, 256), 1, 12), 16, 10).cast("long")
