"""Tables that grow by batches: a folder of Parquet files for each batch, in folders by the hash of a key.

A batch is written once, and only in the buckets that its rows fall into; what earlier batches have written stays as it is.
Readers see whole batches only (Spark's success mark), and a base into which earlier ones were merged hides these.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.session import remove_folder


class BatchedTable:
    """Rows of numbered batches. ``key`` says which bucket a row is stored in; rows whose key is null name it in ``bucket``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T._parse_datatype_string(schema)

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def folders(self) -> list[tuple[int, str]]:
        """(batch, folder) of what readers see, oldest first: the last base that is whole, and the whole batches after it."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        whole = [x.getPath().getName() for x in files.listStatus(top) if files.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        numbered = [(int(name.rpartition("-")[2]), name.startswith("base"), f"{self.path}/{name}") for name in whole]
        base = max((n for n, is_base, _ in numbered if is_base), default=-1)
        return [(n, p) for n, is_base, p in sorted(numbered) if (n == base if is_base else n > base)]

    def last(self) -> int:
        """The number of the last batch, -1 if there is none."""
        return max((n for n, _ in self.folders()), default=-1)

    def put(self, batch: int, rows: DataFrame, dealt: bool = False) -> None:
        """Stores a batch, unless it is there; a batch that was cut short is written anew. dealt: rows are partitioned by ``bucket`` already."""
        if batch <= self.last():
            return
        placed = rows if "bucket" in rows.columns else rows.withColumn("bucket", self.bucket(self.key))
        placed = placed.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema), "bucket")
        self._write(placed, f"batch-{batch}", dealt)

    def _write(self, placed: DataFrame, name: str, dealt: bool = False) -> None:
        ordered = (placed if dealt else placed.repartition("bucket")).sortWithinPartitions("bucket", *self.schema.names[:2])
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def read(self, buckets: Sequence[int] | None = None, before: int | None = None, only: int | None = None) -> DataFrame:
        """All rows with ``bucket`` and ``batch``, or those of some buckets, or of the batches before one, or of one whose folder alone is listed."""
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        parts = [self.spark.read.schema(schema).parquet(p).withColumn("batch", F.lit(n)) for n, p in self.folders() if (before is None or n < before) and (only is None or n == only)]
        found = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema).withColumn("batch", F.lit(-1))
        return found if buckets is None else found.where(F.col("bucket").isin(list(buckets)))

    def merge(self, combine: Callable[[DataFrame], DataFrame]) -> None:
        """One base of what combine() makes of all rows (with bucket and batch); the merged folders are deleted after it is whole."""
        old = self.folders()
        if len(old) < 2:
            return
        self._write(combine(self.read()).select(*self.schema.names, "bucket"), f"base-{old[-1][0]}")
        for _, path in old:
            remove_folder(self.spark, path)
