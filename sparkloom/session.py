"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that is set, or that of ``spark.checkpoint.dir``.

    With neither, a local session gets a temporary folder of its own; on a cluster, whose executors do not see it, that is
    an error, and so is a folder set by hand below the driver's own temporary one. (A ``file:`` folder may be a shared mount.)
    """
    context = spark.sparkContext
    local = context.master.startswith("local[") or context.master == "local"
    now = context._jsc.sc().getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if now.isDefined():
        own = now.get().rsplit("/", 1)[0]
        if not local and not shared and own.removeprefix("file:").startswith(tempfile.gettempdir()):
            raise RuntimeError(f"{own} is not seen by the executors: set spark.checkpoint.dir to a shared folder")
        return own
    if not shared and not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared = shared or "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def new_folder(spark: SparkSession, prefix: str) -> str:
    """A path below the shared folder that nothing else uses; Spark makes it on the first write."""
    return f"{shared_folder(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_folder() named, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, prefix: str) -> tuple[DataFrame, str]:
    """``df`` written to a new folder below the shared one and read again, and that folder, for remove_folder()."""
    path = new_folder(df.sparkSession, prefix)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns it without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *order: Column | str, name: str = "at") -> DataFrame:
    """``df`` with its rows' positions (from 0) in an order, as ``name``; rows that tie are told apart by nothing else.

    Rows are range partitioned and sorted, and the partitions' sizes are added up: the only window runs over one row for
    each partition.
    """
    part, base = f"{name}_part", f"{name}_base"
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    ranged = ranged.withColumns({part: F.shiftright(name, 33), name: F.col(name).bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(base)).select(part, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    # as many rows as there are partitions, whatever the input
    return ranged.join(F.broadcast(sizes), part).withColumn(name, F.col(name) + F.col(base)).drop(part, base)
