"""A training corpus from ``documents``: language ID, near-dedup, substring dedup, mixing, tokens.

Each stage is one operator over all that the stage before it kept. Rows are written to the shared checkpoint folder after
each stage, and a stage's folder is deleted once no later one reads it.

Defined results: a null or empty text, or one without letters, has no language and goes in the first stage, as do texts in
which no language has half of the evidence; of rows that share a doc_id each is judged by itself, and near duplicates keep
the smallest doc_id; null languages and sources are values like others; an empty table gives an empty result; extra
columns are carried along to the last stage whatever their names, which returns doc_id, lang, source and the tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import langid, minhash, mixing, queries, substring_dedup
from sparkloom.llm import sentencepiece as pieces
from sparkloom.llm.arrow import fresh
from sparkloom.session import new_folder, remove_folder

#: A text is rejected if no letter is found or no language has half of the evidence.
LEAST_LANGUAGE_SCORE = 0.5

#: Word 5-shingle sets of this similarity or more are near duplicates; 64 bands of 6 miss such a pair with a probability of some 4e-9.
NEAR_PERCENT, NEAR_BANDS, NEAR_ROWS = 80, 64, 6


def _beside(docs: DataFrame, made: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's rows with the columns of ``docs``; those named as one that it makes are set aside meanwhile."""
    aside = {c: fresh(f"aside_{c}", docs) for c in docs.columns if c.lower() in made}
    return stage(docs.withColumnsRenamed(aside)).select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model is sure of; lang becomes the predicted one."""
    lang, score = fresh("found_lang", docs), fresh("found_score", docs)
    found = langid.identify(docs, langid.LanguageModel.fit(docs), lang_col=lang, score_col=score)
    kept = found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).withColumn("lang", F.col(lang))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS, rows=NEAR_ROWS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has."""
    clean = _beside(docs, ("n_removed", "chars_removed", "removed"), substring_dedup.dedup_substrings)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return _beside(docs, ("size", "source_size", "target", "copies", "taken"), lambda rows: mixing.emit(mixing.mix(rows)))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's whole text, with digests of the ids and of the text that they decode to."""
    encoded = pieces.encode(docs, queries.model_path(), decoded_col="decoded", keep=["doc_id", "lang", "source"])
    return queries.digests(encoded).select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language_id", language_id), ("minhash_near_dedup", near_dedup), ("substring_dedup", substring), ("mixing", mix_sources), ("sentencepiece", tokenize)]

#: Encoding cannot be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared checkpoint folder and read again."""
    base = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            if k:
                remove_folder(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
