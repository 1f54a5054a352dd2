"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages: runs of lines, and pieces of long lines, of some ``PASSAGE_CHARS`` characters each. Every
passage is encoded from how it is written (shares of letter cases, digits, spaces and single signs, word lengths, variety
of words, and whether its lines were seen before in the document) and from its words, hashed to ``WORD_BUCKETS`` shares.
A hidden layer encodes it further, gated attention (tanh times sigmoid) gives it a weight among its document's passages,
and the weighted sum of the encodings is the document's, from which the score is read. All layers are learnt together
from document labels.

Defined results: a null, empty or blank text is one empty passage; without training rows every score is 0.5; repeated
rows get the same score, texts of any length are read as a whole, and an empty table gives an empty result; other columns are carried along, and columns named as an output are replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from sparkloom.llm.arrow import map_columns
from sparkloom.llm.labelled import labelled_sample, sigmoid

PER_CLASS = 2_500  # training documents of each class at most
PASSAGE_CHARS = 300  # lines are joined until a passage has so many
HIDDEN, GATE = 16, 8
_SIGNS = "|%$#*&!?.,;:-_\"'()/@<>=+~"
_KIND = np.zeros(256, np.intp)  # 0 others, 1 lower, 2 upper, 3 digit, 4 space, 5 other bytes of UTF-8, then signs
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[[32, *range(9, 14)]] = 4
for _i, _c in enumerate(_SIGNS):
    _KIND[ord(_c)] = 6 + _i
_N_KINDS = 6 + len(_SIGNS)
WORD_BUCKETS = 32
N_FEATURES = _N_KINDS + 8 + WORD_BUCKETS
_PIECE = re.compile(r".{1,%d}(?:\s+|$)|.{%d}" % (PASSAGE_CHARS, PASSAGE_CHARS), re.DOTALL)  # up to a space, or anywhere in a very long word
_KEPT = 300_000  # remembered words per task, some 30 MB


class _Buckets(dict):
    """Where a lower-case word is counted; words are hashed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > _KEPT:
            self.clear()
        self[word] = at = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return at


def passages(text: str | None, chars: int = PASSAGE_CHARS) -> list[list[str]]:
    """Runs of lines and of pieces of long lines; one empty run for a text without lines."""
    out: list[list[str]] = []
    size = 0
    for line in (text or "").split("\n"):
        for piece in _PIECE.findall(line) if len(line) > 2 * chars else (line,):
            if not out or size >= chars:
                out.append([])
                size = 0
            out[-1].append(piece)
            size += len(piece)
    return out


def encode_document(text: str | None, buckets: _Buckets) -> np.ndarray:
    """Features of each passage."""
    runs = passages(text)
    out = np.zeros((len(runs), N_FEATURES), np.float32)
    seen: set[str] = set()
    for row, lines in zip(out, runs, strict=True):
        whole = "\n".join(lines)
        raw = np.frombuffer(whole.encode(), np.uint8)
        n = max(1, len(raw))
        row[:_N_KINDS] = np.sqrt(np.bincount(_KIND[raw], minlength=_N_KINDS) / n)
        words = whole.split()
        count = max(1, len(words))
        row[_N_KINDS + 8 :] = np.sqrt(np.bincount(np.fromiter(map(buckets.__getitem__, words), np.intp, len(words)), minlength=WORD_BUCKETS) / count)
        row[_N_KINDS : _N_KINDS + 8] = (
            np.log1p(len(raw)) / 8,
            len(raw) / count / 12,
            len(set(words)) / count,
            sum(x in seen for x in lines if x) / len(lines),
            np.log1p(count / len(lines)) / 4,
            not words,
            len(runs) == 1,
            min(1.0, len(runs) / 40),
        )
        seen.update(lines)
    return out


class QualityModel:
    """Layers of the network, by name; some 30 kB."""

    def __init__(self, layers: dict[str, np.ndarray]) -> None:
        self.layers = layers

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, mod: int = 5, rest: int = 0, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
        return cls.fit_texts(*labelled_sample(docs, labels, "quality", mod, rest, per_class, id_col, text_col))

    @classmethod
    def fit_texts(cls, texts: list[str], y: np.ndarray, weight: np.ndarray, epochs: int = 30, rate: float = 0.01, seed: int = 0) -> QualityModel:
        rng = np.random.default_rng(seed)
        buckets = _Buckets()
        bags = [encode_document(x, buckets) for x in texts]
        every = np.concatenate(bags) if bags else np.zeros((1, N_FEATURES), np.float32)
        layers = {
            "mean": every.mean(axis=0), "scale": every.std(axis=0) + 0.05,
            "w": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
            "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "a": rng.normal(0, GATE**-0.5, GATE),
            "c": np.zeros(HIDDEN), "d": np.zeros(1),
        }
        model = cls(layers)
        if not bags:
            return model
        names = ("w", "b", "v", "u", "a", "c", "d")
        first, second = ({k: np.zeros_like(layers[k]) for k in names} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), 64):
                some = order[at : at + 64]
                gradient = model._gradient([bags[i] for i in some], y[some], weight[some])
                step += 1
                for k in names:
                    g = gradient[k] + 1e-4 * layers[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    layers[k] = layers[k] - rate * 0.93**epoch * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return model

    def _forward(self, bags: list[np.ndarray]) -> dict[str, np.ndarray]:
        p = self.layers
        sizes = np.array([len(x) for x in bags])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        bag = np.repeat(np.arange(len(bags)), sizes)
        x = np.clip((np.concatenate(bags) - p["mean"]) / p["scale"], -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        alpha = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(alpha[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "alpha": alpha, "z": z, "starts": starts, "bag": bag, "score": sigmoid(z @ p["c"] + p["d"])}

    def _gradient(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.layers, self._forward(bags)
        out = weight * (f["score"] - y) / len(bags)
        dz = out[:, None] * p["c"]
        h, alpha, bag = f["h"], f["alpha"], f["bag"]
        dalpha = (dz[bag] * h).sum(axis=1)
        de = alpha * (dalpha - np.add.reduceat(alpha * dalpha, f["starts"])[bag])
        gate = de[:, None] * p["a"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = (alpha[:, None] * dz[bag] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h**2)
        return {"c": f["z"].T @ out, "d": out.sum(keepdims=True), "a": (f["t"] * f["s"]).T @ de, "v": h.T @ dt, "u": h.T @ ds, "w": f["x"].T @ dh, "b": dh.sum(axis=0)}

    def predict(self, texts: list[str | None], buckets: _Buckets) -> tuple[list[float], list[int]]:
        """Score, and the number of the passage with the largest weight."""
        if not texts:
            return [], []
        f = self._forward([encode_document(x, buckets) for x in texts])
        stops = [*f["starts"][1:], len(f["alpha"])]
        return f["score"].tolist(), [int(np.argmax(f["alpha"][a:b])) for a, b in zip(f["starts"], stops, strict=True)]


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score (that the label is 1) and top_passage (which passage weighs most)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.layers)

    buckets = _Buckets()

    def fn(text):
        own, texts = QualityModel(shared.value), text.to_pylist()
        found = [own.predict(texts[at : at + 256], buckets) for at in range(0, len(texts), 256)]
        return [[s for x, _ in found for s in x], [k for _, x in found for k in x]]

    return map_columns(docs, {"text": text_col}, "score double, top_passage int", fn)
