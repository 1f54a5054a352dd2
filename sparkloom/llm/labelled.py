"""A bounded sample of labelled texts for fitting a classifier on the driver, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.langid import held_out

FIT_CHARS = 20_000  # longer texts are not drawn for fitting, which bounds a sample's bytes; they are scored like others


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, rest: int, per_class: int, id_col: str = "doc_id", text_col: str = "text"):
    """(texts, labels, weights): about ``per_class`` ids of each class, chosen by a hash, and 3 * per_class rows at most.

    Only rows whose crc32(id) modulo ``mod`` is not ``rest`` are used. Rows without label or text, and texts of more than
    ``FIT_CHARS`` characters, teach nothing; of an id's labels the largest counts; of rows that share an id as many come along
    as the limit on rows leaves, by a hash of id and text. The weights restore the classes' shares among all training labels.
    The chosen ids (some 10 bytes each, about 2 * per_class) are broadcast, so no text is shuffled.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, mod, rest))
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    draw, keep = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 20)), F.lit(False)
    for label, n in counts.items():
        keep = keep | ((F.col("_label") == label) & (draw < int(min(1.0, per_class / n) * (1 << 20)) + 1))
    chosen = F.broadcast(known.where(keep))
    own = docs.where(F.length(text_col) <= FIT_CHARS).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    drawn = own.join(chosen, "_id").orderBy(F.xxhash64("_id", "_text"), "_id", "_text").limit(3 * per_class)
    found = drawn.toPandas().sort_values(["_id", "_text"], kind="stable")
    texts, y = found["_text"].tolist(), found["_label"].to_numpy(np.float64)
    total = sum(counts.values())
    weight = np.ones(len(y))
    for label, n in counts.items():
        weight[y == label] = n / total / max(1e-9, (y == label).mean()) if len(y) else 1
    return texts, y, weight


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    if not len(y):
        return beta
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6]) * len(y) / 100
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        gradient = x.T @ (weight * (p - y)) + penalty @ beta
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        beta = beta - step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
