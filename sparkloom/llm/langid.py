"""Language ID by words first, then by shorter and shorter character n-grams.

A known word adds its log frequency in each language. An unseen word falls back to its n-grams of the longest length
of which the model knows any, at a fixed cost per step back. The score is the best language's share after a softmax over
the mean evidence per word.

The model is fitted on labelled texts whose crc32(doc_id) is not held out: a sample of about ``max_docs`` rows of
``FIT_CHARS`` characters at most, chosen by a hash of id and text and limited to twice as many, so that rows and bytes are
bounded. All words and n-grams of the sample are known; they are kept as sorted 64-bit hashes beside a matrix of log
frequencies, some 30 bytes each, which is broadcast.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if there was nothing to learn from; rows
without text or language teach nothing, and of repeated rows each does; of languages that tie the first by name is taken; repeated
rows get the same language, texts of any length are read as a whole, and an empty table gives an empty result; other columns are carried along, and columns named as an output are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import bound_batches, give_back, map_columns, slices

MAX_DOCS = 8_000  # labelled documents that the model is fitted on, about; twice as many at most
FIT_CHARS = 20_000  # longer texts are not drawn for fitting; they are identified like others
GRAMS = (5, 4, 3, 2, 1)
BACKOFF = 0.4  # natural log units of evidence lost at each step back, as in stupid backoff
SHARPNESS = 8.0
_KEPT = 200_000  # remembered words per task, some 40 MB
_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: str, mod: int = 4, rest: int = 2):
    """crc32 of the id as text, modulo ``mod``, is ``rest``; a null id counts as the text "null"."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")), F.lit(mod)) == rest


def _counts(train: DataFrame) -> DataFrame:
    """(lang, size, gram, n): size 0 are words, others n-grams within words padded by a space."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1 << 20):  # what a slice counts is some 20 MB at most
                out: Counter = Counter()
                words: Counter = Counter()
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words.update((lang, w) for w in _WORD.findall(text.lower()))
                for (lang, w), n in words.items():
                    out[lang, 0, w] += n
                    padded = f" {w} "
                    for size in GRAMS:
                        for i in range(len(padded) - size + 1):
                            out[lang, size, padded[i : i + size]] += n
                keys = zip(*out, strict=True) if out else ((), (), ())
                lang, size, gram = map(list, keys)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(gram, pa.string()), pa.array(out.values(), pa.int64())], names=["lang", "size", "gram", "n"])
        give_back()

    bound_batches(train.sparkSession)
    return train.mapInArrow(run, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def _hash(size: int, gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram.encode(), size)


class LanguageModel:
    """Log frequencies of words (size 0) and n-grams in each language, less their mean over the languages.

    keys: sorted hashes of (size, gram); rows: the evidence of each for every language.
    """

    def __init__(self, langs: list[str], keys: np.ndarray, rows: np.ndarray) -> None:
        self.langs, self.keys, self.rows = langs, keys, rows

    @classmethod
    def fit(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> LanguageModel:
        train = docs.where(~held_out(id_col)).where((F.length(text_col) <= FIT_CHARS) & F.col(lang_col).isNotNull())
        share = min(1.0, max_docs / max(1, train.count()))
        draw = F.xxhash64(id_col, text_col)
        sample = train.where(F.pmod(draw, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(draw, id_col, text_col, lang_col).limit(2 * max_docs)
        # the sample is bounded; dealt anew, its counting does not depend on how the table is cut into files
        dealt = sample.repartition(docs.sparkSession.sparkContext.defaultParallelism, F.xxhash64(id_col, text_col)).select(lang_col, text_col)
        counts = _counts(dealt).persist()
        try:
            whole = counts.groupBy("lang", "size").agg(F.sum("n").alias("n")).toArrow().to_pylist()
            totals = {(r["lang"], r["size"]): r["n"] for r in whole}
            langs = sorted({x for x, _ in totals})
            per_lang = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)]
            found = counts.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("langs"), *per_lang).toArrow()
        finally:
            counts.unpersist()
        return cls.of_counts(langs, totals, found["size"].to_pylist(), found["gram"].to_pylist(), [found[f"n{i}"].to_numpy() for i in range(len(langs))])

    @classmethod
    def of_counts(cls, langs: list[str], totals: dict[tuple[str, int], int], sizes: list[int], grams: list[str], per_lang: list[np.ndarray]) -> LanguageModel:
        """From the counts of each (size, gram) in each language and the sums over all grams of a size."""
        if not grams:
            return cls(langs, np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32))
        base = {s: [totals.get((x, s), 0) + 1 for x in langs] for s in (0, *GRAMS)}
        evidence = np.log((np.column_stack(per_lang) + 0.5) / np.array([base[s] for s in sizes]))
        keys = np.fromiter(map(_hash, sizes, grams), np.uint64, len(grams))
        order = np.argsort(keys)
        return cls(langs, keys[order], (evidence - evidence.mean(axis=1, keepdims=True))[order].astype(np.float32))

    def _find(self, size: int, grams: list[str]) -> np.ndarray:
        """Row numbers of the grams, -1 for those that the model does not know."""
        wanted = np.fromiter((_hash(size, x) for x in grams), np.uint64, len(grams))
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def words(self, words: list[str]) -> np.ndarray:
        """Evidence of lower-case words for each language, a row each: known ones first, the rest by shorter and shorter n-grams."""
        out = np.zeros((len(words), max(1, len(self.langs))), np.float32)
        if not len(self.keys):
            return out
        at = self._find(0, words)
        out[at >= 0] = self.rows[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for step, size in enumerate(GRAMS, 1):
            if not len(left):
                break
            padded = [f" {words[i]} " for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [max(0, len(p) - size + 1) for p in padded])
            at = self._find(size, [p[i : i + size] for p in padded for i in range(len(p) - size + 1)])
            owner, at = owner[at >= 0], at[at >= 0]
            n = np.bincount(owner, minlength=len(left))
            sums = np.column_stack([np.bincount(owner, self.rows[at, k], len(left)) for k in range(len(self.langs))])
            done = n > 0
            out[left[done]] = sums[done] / n[done, None] * math.exp(-BACKOFF * step)
            left = left[~done]
        return out


class _Scorer(dict):
    """Rows of a growing table by word as written; each word is worked out once."""

    def __init__(self, model: LanguageModel) -> None:
        super().__init__()
        self.model, self.table, self.n = model, np.zeros((1024, max(1, len(model.langs))), np.float32), 0

    def _learn(self, words: list[str]) -> None:
        while self.n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n : self.n + len(words)] = self.model.words([w.lower() for w in words])
        self.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        self.n += len(words)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        if self.n > _KEPT:
            self.clear()
            self.n = 0
        split = [_WORD.findall(x) if x else [] for x in texts]
        self._learn(list({w for words in split for w in words} - self.keys()))
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        for i, words in enumerate(split):
            if words and self.model.langs:
                evidence = self.table[np.fromiter(map(self.__getitem__, words), np.intp, len(words))].mean(axis=0, dtype=np.float64) * SHARPNESS
                share = np.exp(evidence - evidence.max())
                best = int(np.argmax(share))
                langs[i], scores[i] = self.model.langs[best], float(share[best] / share.sum())
        return langs, scores


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; words are compared in lower case."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.keys, model.rows))
    own: list[_Scorer] = []

    def fn(text):
        if not own:
            own.append(_Scorer(LanguageModel(*shared.value)))
        return list(own[0].predict(text.to_pylist()))

    return map_columns(docs, {"text": text_col}, f"`{lang_col}` string, `{score_col}` double", fn)
