"""Passes over stored chunks in claimed batches of documents, with a ledger from which a run goes on where it was cut short.

A batch is claimed before it is worked on, and settled by its rows in the ledger; a claim that is not settled is finished first.
All that a batch stores is written once under its number and follows from its claim, so a run that is killed anywhere and run again
leaves the ledger and the tables of one run. Documents that fail are settled for this run and taken again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import scores
from sparkloom.operators import entities as ents
from sparkloom.operators import graph
from sparkloom.session import new_folder, numbered, remove_folder, written
from sparkloom.sources.batches import BatchedTable

PASSES = ("deterministic", "llm")  # fixed values
CHUNKS_PER_DOC = 3
BATCH_DOCS, MOST_BATCHES, _FILES = 10_000, 8, 16
_TRIPLE = ("subject", "subject_type", "predicate", "object", "object_type")

#: Of one chunk's text: triples as mappings. May raise: the document then fails, and no other.
Complete = Callable[[str], Iterable[Mapping[str, str]]]


def completed(chunks: DataFrame, complete: Complete) -> DataFrame:
    """(doc_id, n, subject, .., object_type, error) of chunks (doc_id, chunk_index, text), a document's chunks in order; one row with the error where it fails."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            found = [t for text in frame.sort_values("chunk_index")["text"] for t in complete(text)]
            rows = [(key[0], n, *(None if t.get(c) is None else str(t.get(c)) for c in _TRIPLE), None) for n, t in enumerate(found)]
        except Exception as e:
            rows = [(key[0], 0, *[None] * len(_TRIPLE), f"{type(e).__name__}: {e}"[:500])]
        return pd.DataFrame(rows, columns=["doc_id", "n", *_TRIPLE, "error"])

    # a few chunks for each document
    return chunks.select("doc_id", "chunk_index", "text").groupBy("doc_id").applyInPandas(run, "doc_id string, n int, " + ", ".join(f"{c} string" for c in _TRIPLE) + ", error string")


class Backfill:
    """The ledger and the results of the passes over chunks (doc_id, chunk_index, text)."""

    def __init__(self, spark: SparkSession, path: str, complete: Complete | None = None, stopwords: Sequence[str] = ents.EDGE_WORDS, buckets: int = 64) -> None:
        self.spark, self.complete, self.stopwords = spark, complete, stopwords
        table = lambda name, schema, key: BatchedTable(spark, f"{path.rstrip('/')}/{name}", schema, key, buckets)
        self._runs = table("runs", "run string", "run")
        self._claims = table("claims", "doc_id string, pass string", "doc_id")
        self._ledger = table("ledger", "doc_id string, pass string, status string, attempts int, entities long, edges long, error string", "doc_id")
        self._mentions = table("mentions", "doc_id string, canonical_key string, type string, label string, confidence double, entity_id long", "doc_id")
        self._pairs = table("pairs", "doc_id string, a long, b long", "doc_id")
        self._triples = table("triples", "doc_id string, subject string, subject_type string, predicate string, object string, object_type string, confidence double", "doc_id")

    def ledger(self) -> DataFrame:
        """The last row of each document and pass."""
        names = self._ledger.schema.names
        last = self._ledger.read().groupBy("doc_id", "pass").agg(F.max_by(F.struct(*names[2:]), "batch").alias("x"))
        return last.select("doc_id", "pass", "x.*")

    def _last(self, table: BatchedTable, pass_name: str) -> DataFrame:
        """Rows of the batch that has settled a document last, of those that are done."""
        done = self._ledger.read().where(F.col("pass") == pass_name).groupBy("doc_id").agg(F.max_by("status", "batch").alias("status"), F.max("batch").alias("batch")).where("status = 'done'")
        return table.read().join(done.select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").select(*table.schema.names)

    def mentions(self) -> DataFrame:
        return self._last(self._mentions, "deterministic")

    def pairs(self) -> DataFrame:
        return self._last(self._pairs, "deterministic")

    def triples(self) -> DataFrame:
        return self._last(self._triples, "llm")

    def run(self, chunks: DataFrame, pass_name: str, run: str, limit: int | None = None, batch_docs: int | None = None, chunks_per_doc: int = CHUNKS_PER_DOC) -> int:
        """Works through what a pass has not settled, at most ``limit`` documents by id, in batches; how many documents it has settled.

        run: the run's name; under the same name it goes on, and does not take again what has failed in it. batch_docs: documents
        in a batch, BATCH_DOCS by default, or what makes MOST_BATCHES of the run if that is more.
        """
        if pass_name not in PASSES or (pass_name == "llm" and not self.complete):
            raise ValueError(f"no such pass: {pass_name}")
        chunks = chunks.withColumn("doc_id", F.col("doc_id").cast("string")).select("doc_id", "chunk_index", "text")
        begun = self._runs.read().where(F.col("run") == run).agg(F.min("batch")).head()[0]
        if begun is None:
            begun = max(self._runs.last(), self._claims.last()) + 1
            self._runs.put(begun, self.spark.createDataFrame([(run,)], "run string"))
        for number in [n for n, _ in self._claims.folders() if n > self._ledger.last()]:
            claim = self._claims.read(only=number).select("doc_id")
            self._settle(chunks.join(claim, "doc_id", "left_semi"), number, chunks_per_doc)
        ledger = self._ledger.read().where(F.col("pass") == pass_name)
        mine = ledger.where(F.col("batch") >= begun).count()
        settled = ledger.where(F.col("status").isin("done", "skipped") | (F.col("batch") >= begun)).select("doc_id").distinct()
        todo = chunks.select("doc_id").distinct().join(settled, "doc_id", "left_anti")
        # what is left to do is put in order once, and its texts are dealt to their batches once, so that no batch reads all of them
        placed = numbered(todo if limit is None else todo.orderBy("doc_id").limit(max(0, limit - mine)), "doc_id")
        total = placed.count()
        if not total:
            return mine
        size = batch_docs or max(BATCH_DOCS, -(-total // MOST_BATCHES))
        placed = placed.withColumn("part", F.floor(F.col("at") / size).cast("int"))
        folder = new_folder(self.spark, "todo")
        dealt = chunks.join(placed.select("doc_id", "part"), "doc_id").repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(_FILES)))
        dealt.write.partitionBy("part").parquet(folder)
        for part in range(-(-total // size)):
            number = max(begun, self._claims.last() + 1)
            self._claims.put(number, placed.where(F.col("part") == part).select("doc_id", F.lit(pass_name).alias("pass")))
            own = self.spark.read.schema(T.StructType([*chunks.schema.fields, T.StructField("part", T.IntegerType())])).parquet(folder).where(F.col("part") == part)
            self._settle(own.select(chunks.columns), number, chunks_per_doc)
        remove_folder(self.spark, folder)
        return mine + total

    def _settle(self, own: DataFrame, number: int, chunks_per_doc: int) -> None:
        """Stores the results of a claim, whose chunks are given, and its rows in the ledger."""
        claim = self._claims.read(only=number).select("doc_id", "pass")
        pass_name = claim.head()["pass"]
        texts, folder = written(own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n\n").alias("text")), "texts")
        empty = texts.where(F.trim(F.regexp_replace("text", r"\s+", " ")) == "").select("doc_id", F.lit(True).alias("empty"))
        if pass_name == "llm":
            chosen = graph.representative_chunks(own.join(empty, "doc_id", "left_anti"), chunks_per_doc)
            found = completed(chosen, self.complete).cache()
            kept = graph.grounded_triples(found.where("error is null").drop("error"), texts)
            self._triples.put(number, kept)
            stored = self._triples.read(only=number)
            ends = stored.select("doc_id", F.explode(F.array("subject", "object")).alias("end"))
            errors = found.where("error is not null").select("doc_id", "error")
            counts = (ends.groupBy("doc_id").agg(F.count_distinct(F.lower("end")).alias("entities")), stored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges")))
        else:
            mentions = ents.mentions(texts, self.stopwords).withColumn("entity_id", scores.point_id(F.concat_ws("|", "canonical_key", "type")))
            self._mentions.put(number, mentions)
            stored = self._mentions.read(only=number)
            self._pairs.put(number, graph.co_mentions(stored.select(*self._mentions.schema.names)))
            errors = claim.limit(0).select("doc_id", F.lit("").alias("error"))
            counts = (stored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entities")), self._pairs.read(only=number).groupBy("doc_id").agg(F.count(F.lit(1)).alias("edges")))
        before = self._ledger.read(before=number).groupBy("doc_id", "pass").agg(F.max("attempts").alias("before"))
        rows = claim.join(empty, "doc_id", "left").join(errors, "doc_id", "left").join(before, ["doc_id", "pass"], "left").join(counts[0], "doc_id", "left").join(counts[1], "doc_id", "left")
        status = F.when(F.col("empty"), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("done")
        self._ledger.put(number, rows.select("doc_id", "pass", status.alias("status"), (F.coalesce("before", F.lit(0)) + 1).alias("attempts"), F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("edges", F.lit(0)).alias("edges"), "error"))
        if pass_name == "llm":
            found.unpersist()
        remove_folder(self.spark, folder)
