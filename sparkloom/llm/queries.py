"""The registered queries of this subpackage; each reads its whole table through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import ann, divergence, html_extract, langid, media, minhash, mixing, periodic_runs, quality, simhash, substring_dedup, toxicity
from sparkloom.llm import sentencepiece as pieces
from sparkloom.session import table


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer files are on the driver; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = media.read_media(media.write_media(docs).drop("text"))
    payload = F.col("payload")
    return files.select("doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
                        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
                        F.sha2("media", 256).alias("media_sha256"), media.feature().alias("feature"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.ToxicityModel.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", langid.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(pieces.encode(docs, model_path(), decoded_col="decoded", keep=["doc_id"])).drop("ids", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """The token columns of a table with ids and decoded."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(joined, 256), "decoded_sha256": F.sha2("decoded", 256)})


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs, langid.LanguageModel.fit(docs))
    return out.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.QualityModel.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs, model)
    return out.select("doc_id", langid.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "top_passage")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat(x["start"], F.lit("+"), x["length"], F.lit("@"), x["first_doc_id"])), ";")
    return out.withColumn("removed", spans)


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` in which the words of about every tenth text repeat from some word on; which, and how, follows from doc_id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n, words = F.floor(h / 10), F.size("w").cast("long"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    a = g % n
    p = 1 + ((n - a) / (3 + g % 8)).cast("long")
    at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    made = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.element_at("w", (at(i) + 1).cast("int")))
    chosen = docs.withColumn("w", F.when(h % 10 == 0, words))
    return chosen.withColumn("text", F.when(F.size("w") > 0, F.array_join(made, " ")).otherwise(F.col("text"))).drop("w")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", periodic_runs.best_run())
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))), "")
    best = F.col("best")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_media_columns": op2_media_columns,
    "op3_toxicity": op3_toxicity,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_language_id": op7_language_id,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
}
ORACLE_SQL = {"op9_mixing": mixing.ORACLE_SQL, "op10_substring_dedup": substring_dedup.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL}
