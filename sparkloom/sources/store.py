"""Sinks: idempotent upserts by key over Parquet folders in buckets of the key, appends, and artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.session import remove_folder, written


class BucketedTable:
    """A Parquet table in folders by the hash of a key; a write reads and overwrites only the buckets of its keys.

    Buckets are swapped by Spark's dynamic partition overwrite once all are written. A job that dies before that leaves the
    table as it was; one that dies while they are swapped is run again with the same rows, which gives the same table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.key = key or self.schema[0].name

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop("_bucket")

    def _change(self, keys: DataFrame, change) -> None:
        touched = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())  # as many as there are buckets, at most
        if not touched:
            return
        old = self._stored().where(F.col("_bucket").isin(touched)).drop("_bucket")
        new = change(old).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))
        # written before the table is touched, as it is read from the table
        new, folder = written(new.withColumn("_bucket", self._bucket()).repartition(len(touched), "_bucket"), "buckets")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        left = {r[0] for r in new.select("_bucket").distinct().collect()}
        for bucket in set(touched) - left:
            remove_folder(self.spark, f"{self.path}/_bucket={bucket}")
        remove_folder(self.spark, folder)

    def upsert(self, new: DataFrame, keys: Sequence[str], order: str | None = None) -> None:
        """keys must hold the table's key."""
        if self.key not in keys:
            raise ValueError(f"{self.key} is not among the keys")
        self._change(new, lambda old: upserted(old, new, keys, order))

    def replace_by(self, new: DataFrame, values: DataFrame | None = None) -> None:
        """All rows of the new rows' (or the given) keys are replaced by the new rows."""
        gone = (values if values is not None else new).select(self.key).distinct()
        self._change(gone, lambda old: old.join(gone, self.key, "left_anti").unionByName(new, allowMissingColumns=True))

    def delete(self, values: DataFrame) -> None:
        gone = values.select(self.key).distinct()
        self._change(gone, lambda old: old.join(gone, self.key, "left_anti"))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Old rows without those of new keys, and of the new rows the last one of each key by ``order``."""
    by = [F.desc(order)] if order else [F.desc(c) for c in new.columns if c not in keys] or [F.desc(keys[0])]
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(last.select(old.columns))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """An artifact of some thousand rows as one CSV file with a header; one task writes it."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_markdown(quotes: DataFrame, path: str, title: str) -> None:
    """An artifact of some thousand rows (quote, source) as one Markdown file, quotes verbatim; one task sorts and writes it."""
    line = F.concat(F.lit("> "), F.replace("quote", F.lit("\n"), F.lit("\n> ")), F.lit("\n>\n> — "), "source", F.lit("\n"))
    head = quotes.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(f"# {title}\n").alias("value"))
    lines = head.unionAll(quotes.select(F.lit(1), line).where(line.isNotNull())).repartition(1).sortWithinPartitions("part", "value")
    lines.select("value").write.mode("overwrite").text(path)


def copy_verified(source: DataFrame, target_path: str, key: str) -> DataFrame:
    """Copies a table and returns (rows_in, rows_out, missing) from reading it again."""
    source.write.mode("overwrite").parquet(target_path)
    copied = source.sparkSession.read.parquet(target_path)
    missing = source.select(key).join(copied.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return source.agg(F.count(F.lit(1)).alias("rows_in")).crossJoin(copied.agg(F.count(F.lit(1)).alias("rows_out"))).crossJoin(missing)
