"""Approximate nearest neighbours by shifted space-filling curves.

Distinct vectors are projected by random rotations onto a few dimensions, shifted, and ordered along Hilbert curves, one
for each rotation, by Spark's range partitioning. On each curve a query meets the vectors within ``window`` rows to either
side of its own place; the windows of all curves are scored in double precision and merged.

How many curves are needed, and how wide a window, depends on the vectors and on their number, so both are measured unless
given: a hash-chosen sample of at most ``SAMPLE`` queries is compared with all vectors, and for each number of curves the
least window is found that holds ``TARGET`` of their true neighbours. The cheapest pair is taken, by the rows scored for
all queries and the vectors shipped for each curve. Vectors with structure get narrow windows; noise in many dimensions
gets windows over much of the table, as no index can do much better, and the work then grows with the square of it.

Tasks stay bounded whatever the window: a curve is cut into segments of rows, a segment's vectors go to one task for each
group of segments that queries come from, and scores are made for runs of neighbouring queries.

Equal vectors are one class from the start: the k + 1 smallest ids stand for all copies, which is all that a result can
name, so that a vector with very many copies fills neither a window nor a task.

Defined results: vectors that are null, empty, zero, or hold null or non-finite numbers take no part, nor do null ids;
vectors are compared with those of their own length only; ties go to the smaller id; rows that share an id and a vector
are one; with fewer than k candidates all that are found are returned; an empty table gives an empty result; other columns are
not read, so their names do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.arrow import fresh
from sparkloom.llm.hilbert import hilbert_keys
from sparkloom.session import cut, numbered

CURVES, DIMS, BITS = 16, 15, 4  # curves at most; dimensions and bits of each
TARGET = 0.93  # share of the sample's neighbours that the windows must hold
SAMPLE = 256  # queries that the windows are measured on
SEGMENT = 8192  # rows of a curve that a task holds vectors of
SHIPPED = 100  # scores that cost as much as a vector shipped to its place on a curve
_SPAN = 8.0  # standard deviations that the grid covers, with a shift of one
_CELLS = 1 << 20  # scores held at once
_DEAL = 16  # segments whose queries meet a segment in one task


def _usable(vec: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & ~F.coalesce(F.exists(vec, bad), F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def _classes(usable: DataFrame, k: int) -> DataFrame:
    """(rep, ids, vec): one row per distinct vector with its k + 1 smallest ids. Only so many rows a task are shuffled."""
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = usable.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "ids", "vec")


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def curve_keys(vectors: DataFrame, scale: float, curves: int, dims: int, bits: int, seed: int) -> DataFrame:
    """(rep, size, curve, key) for every vector and curve."""

    def run(batches):
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column("vec")))
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                points = _matrix(part.column("vec"))
                for curve in range(curves):
                    rng = np.random.default_rng((seed, int(size), curve))
                    axes = np.linalg.qr(rng.normal(size=(int(size), min(dims, int(size)))))[0]
                    unit = np.clip((points @ axes / scale + (_SPAN - 1) / 2 + rng.uniform(size=axes.shape[1])) / _SPAN, 0, 1 - 1e-12)
                    keys = hilbert_keys((unit * (1 << bits)).astype(np.int64), bits)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(np.full(n, size), pa.int32()), pa.array(np.full(n, curve), pa.int32()), pa.array(keys, pa.int64())], names=["rep", "size", "curve", "key"])

    return vectors.select("rep", "vec").mapInArrow(run, "rep long, size int, curve int, key long")


def _placed(keyed: DataFrame) -> DataFrame:
    """(rep, size, curve, at): the row at which each vector stands on each curve of its length."""
    rows = numbered(keyed, "size", "curve", "key", "rep").select("rep", "size", "curve", "at")
    # a row for each curve and length of vectors
    first = F.broadcast(rows.groupBy("size", "curve").agg(F.min("at").alias("first")))
    return rows.join(first, ["size", "curve"]).select("rep", "size", "curve", (F.col("at") - F.col("first")).alias("at"))


def best(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best points of each query by inner product, ties to smaller ids: (query id, point id, score)."""
    out: tuple[list, list, list] = ([], [], [])
    rows = max(16, _CELLS // max(1, len(points)))
    step = max(1, len(points) // max(2048, 4 * k))
    for at in range(0, len(queries), rows):
        some = queries[at : at + rows]
        score = some @ points.T
        # the k-th best of some points is a lower bound for that of all
        least = np.partition(score[:, ::step], -k, axis=1)[:, -k] if k < len(points) else np.full(len(some), -np.inf)
        least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)
        owner, near = np.nonzero(score >= least[:, None])
        exact = np.einsum("ij,ij->i", points[near], some[owner])
        q, c, value = _first(query_ids[at : at + rows][owner], ids[near], exact, k)
        for column, values in zip(out, (q, c, value), strict=True):
            column.append(values)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def best_in_windows(queries: np.ndarray, query_ids: np.ndarray, places: np.ndarray, points: np.ndarray, ids: np.ndarray, at: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As best(), for queries at ``places`` of a curve and the points of a segment of it, both in the curve's order.

    Neighbouring queries, up to a quarter of a window apart, are scored together against all that their windows hold.
    """
    out: tuple[list, list, list] = ([], [], [])
    i = 0
    while i < len(queries):
        j = int(np.searchsorted(places, places[i] + max(window // 4, 1), "right"))
        low, high = np.searchsorted(at, (places[i] - window, places[j - 1] + window + 1))
        if low < high:
            for column, values in zip(out, best(queries[i:j], query_ids[i:j], points[low:high], ids[low:high], k), strict=True):
                column.append(values)
        i = j
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def _first(q: np.ndarray, c: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each q."""
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[keep], c[keep], score[keep]


def _true_neighbours(classes: DataFrame, sample: list, k: int) -> DataFrame:
    """(q, size, c): the k nearest of each vector of a small sample, by one scan of all vectors."""
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["vec"]) for r in sample}:
        own = [r for r in sample if len(r["vec"]) == size]
        asked[size] = np.array([r["vec"] for r in own], float), np.array([r["rep"] for r in own], np.int64)

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column("vec")))
            for size in set(np.unique(sizes).tolist()) & asked.keys():
                part = batch.filter(pa.array(sizes == size))
                found = best(*asked[size], _matrix(part.column("vec")), part.column("rep").to_numpy(), k + 1)
                both = [np.concatenate(x) for x in zip(held[size], found, strict=True)] if size in held else found
                held[size] = _first(*both, k + 1)
        for size, (q, c, score) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.full(len(q), size), pa.int32()), pa.array(c, pa.int64()), pa.array(score, pa.float64())], names=["q", "size", "c", "score"])

    found = classes.select("rep", "vec").mapInArrow(run, "q long, size int, c long, score double").where("q <> c")
    nth = F.row_number().over(Window.partitionBy("q", "size").orderBy(F.desc("score"), "c"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).select("q", "size", "c")


def cheapest(gaps: np.ndarray, n: int, asks: int) -> tuple[int, int, float]:
    """(curves, window, share of the true neighbours found) from the rows between sampled pairs on each curve.

    gaps: a row for each pair, a column for each curve.
    """
    choices = []
    nearest = np.minimum.accumulate(gaps, axis=1)
    for curves in range(1, gaps.shape[1] + 1):
        window = max(1, int(np.sort(nearest[:, curves - 1])[int(np.ceil(TARGET * len(gaps))) - 1]))
        choices.append((curves * (asks * min(n, 2 * window + 1) + n * SHIPPED), curves, window))
    _, curves, window = min(choices)
    return curves, window, float((nearest[:, curves - 1] <= window).mean())


def measured_windows(classes: DataFrame, placed: DataFrame, asked: DataFrame, k: int, n: int, curves: int) -> tuple[int, int, float]:
    """cheapest() for a sample of the queries; some SAMPLE * k * curves numbers come to the driver."""
    sample = asked.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).join(classes, "rep").select("rep", "vec").collect()
    true = F.broadcast(cut(_true_neighbours(classes, sample, k)))
    own = placed.join(F.broadcast(true.select(F.col("q").alias("rep"), "size").distinct()), ["rep", "size"]).select(F.col("rep").alias("q"), "size", "curve", F.col("at").alias("from"))
    far = placed.withColumnRenamed("rep", "c").join(true, ["c", "size"]).join(own, ["q", "size", "curve"])
    gaps = far.groupBy("q", "size", "c").pivot("curve", list(range(curves))).agg(F.min(F.abs(F.col("at") - F.col("from")))).drop("q", "size", "c").collect()
    if not gaps:
        return 1, 1, 1.0
    return cheapest(np.array([list(r) for r in gaps], np.int64), n, asked.count())


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES,
           dims: int = DIMS, bits: int = BITS, window: int | None = None, segment: int = SEGMENT, seed: int = 6, measured: list | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query row, its own id excepted.

    is_query: a condition on ``vectors``. window: rows to each side on every one of ``curves``; measured if None, together with
    how many of the curves are used. measured: a list that gets (curves, window, share found, distinct vectors).
    """
    mark = fresh("asks", vectors)
    usable = vectors.where(_usable(F.col(f"`{vec_col}`")) & F.col(f"`{id_col}`").isNotNull()).withColumn(mark, F.coalesce(is_query, F.lit(False)))
    usable = usable.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec"), F.col(mark).alias("q"))
    classes = cut(_classes(usable.select("id", "vec"), k))
    queries = cut(usable.where("q").select("id", "vec").distinct().join(classes.select("vec", "rep"), "vec").select("id", "rep"))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size("vec")
    mean, n = classes.agg(F.avg(square), F.count(F.lit(1))).head()

    asked = queries.select("rep").distinct()
    placed = cut(_placed(curve_keys(classes, float(np.sqrt(mean or 1.0)), curves, dims, bits, seed)))
    share = None
    if window is None:
        curves, window, share = measured_windows(classes, placed, asked, k, n, curves)
    if measured is not None:
        measured.append((curves, window, share, n))

    step = min(segment, max(256, window))
    rows = placed.where(F.col("curve") < curves).join(classes.select("rep", "vec"), "rep").withColumn("seg", F.floor(F.col("at") / step).cast("long"))
    reach = -(-window // step)
    dealing = (lambda x: F.floor(x / _DEAL).cast("long")) if 2 * reach + 1 > _DEAL else lambda x: F.lit(0).cast("long")
    columns = ("size", "curve", "seg", "deal", "rep", "vec", "at", "asks")
    offer = rows.withColumns({"asks": F.lit(False), "deal": F.explode(F.sequence(dealing(F.col("seg") - reach), dealing(F.col("seg") + reach)))})
    ask = rows.join(asked, "rep", "left_semi").withColumns({"asks": F.lit(True), "deal": dealing(F.col("seg"))})
    ask = ask.withColumn("seg", F.explode(F.sequence(F.floor((F.col("at") - window) / step).cast("long"), F.floor((F.col("at") + window) / step).cast("long"))))
    dealt = offer.select(*columns).unionAll(ask.select(*columns))

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        asks = table["asks"].to_numpy(zero_copy_only=False)
        points, ids, at = _matrix(table["vec"]), table["rep"].to_numpy(), table["at"].to_numpy()
        found = best_in_windows(points[asks], ids[asks], at[asks], points[~asks], ids[~asks], at[~asks], window, k + 1)
        return pa.table({"q": pa.array(found[0], pa.int64()), "c": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    scored = dealt.groupBy("size", "curve", "seg", "deal").applyInArrow(score, "q long, c long, score double")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    # the same pair found on several curves has the same rank
    top = scored.withColumn("r", F.dense_rank().over(by_score)).where(F.col("r") <= k + 1).drop("r").distinct()
    named = top.join(classes.select(F.col("rep").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("id"))
    lists = named.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))), 1, k + 1).alias("found"))
    own = queries.join(lists, queries["rep"] == lists["q"])
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    out = own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
