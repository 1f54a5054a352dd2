"""Row-wise Python over Arrow batches, with columns carried along."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 1 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """At the end of a task: free memory returns to the system, as the worker lives on and the executor counts it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its memory
        ctypes.CDLL(None).malloc_trim(0)


def bound_batches(spark: SparkSession, most: int = 2 * SLICE_BYTES) -> None:
    """Lowers the session's Arrow batches to ``most`` bytes, as texts can be long; a smaller setting stays.

    Batches are held by Spark's and by Python's process at once, in and out, for each task.
    """
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(_LIMIT).lower()).groups()
    now = int(number) << " kmgt".index(unit or " ") * 10
    if now > most or now <= 0:
        spark.conf.set(_LIMIT, str(most))


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes, so that a few long texts do not pile up in a worker."""
    rows = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the tables has, whatever case Spark compares in."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_columns(df: DataFrame, needs: dict[str, str], adds: str, fn: Callable[..., list], keep: list[str] | None = None, done: Callable[[], None] | None = None) -> DataFrame:
    """``df`` with the columns of ``adds`` (DDL) made by ``fn``; a kept column of the same name is replaced.

    fn gets one Arrow array for each name in ``needs`` (parameter name: column) and returns one list or array for each
    added column. keep: the columns to carry along, all by default. done: called at the end of each task, to let go of what
    should not stay in the worker, which serves other queries next.
    """
    added = T._parse_datatype_string(adds)
    carried = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    inner = [*carried, *(c for c in dict.fromkeys(needs.values()) if c not in carried)]
    source = df.select(*(df[f"`{c}`"] for c in inner))
    bound_batches(df.sparkSession)
    schema = T.StructType([source.schema[c] for c in carried] + list(added))
    arrow = to_arrow_schema(added)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                made = fn(**{k: part.column(inner.index(c)) for k, c in needs.items()})
                columns = [part.column(inner.index(c)) for c in carried]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            pa.default_memory_pool().release_unused()
        if done:
            done()
        give_back()

    return source.mapInArrow(run, schema)
