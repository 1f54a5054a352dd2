"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Token labels come from document labels: a word of a toxic training document is labelled toxic if the word, or a prefix or
suffix of it, is found in toxic training documents far more often than in others. The field has two states; a token's
emission is a sum of hashed weights of its word and affixes, fitted with the transitions by gradient ascent on the
likelihood of labelled lines. A document's features are its largest marginal, the sum of its marginals and its length; a
logistic regression on training documents that the field has not seen turns them into a score.

Marginals come from forward-backward passes over whole texts. With two states a pass is a product of 2 x 2 matrices, so the
texts of a batch are laid end to end with a token between them that can only be clean, cut into short blocks, and all blocks
advance together. A text begins and ends outside a toxic span. Tokens are those of the original text, lowered one by one,
so that offsets hold whatever lower case does to a text's length.

Defined results: a null, empty or wordless text has no spans and gets the score of a document without evidence; without
training rows every score is 0; repeated rows get the same score, texts of any length are read as a whole, and an empty table gives
an empty result; other columns are carried along, and columns named as an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from sparkloom.llm.arrow import map_columns
from sparkloom.llm.labelled import fit_logistic, labelled_sample, sigmoid

PER_CLASS = 2_000  # training documents of each class at most
BUCKETS = 1 << 16
WINDOW = 48  # tokens of a training sequence: longer lines are cut into consecutive ones
_STEP = 64  # tokens of a block of a pass
_KEPT = 500_000  # remembered words per task, some 60 MB
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """The word and its affixes; shorter affixes say more about word formation, longer ones about the word."""
    return [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n), *(f"${word[-n:]}" for n in (4,) if len(word) > n)]


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


class ToxicityModel:
    """Weights of the field and of the document score; about 0.5 MB."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, start: np.ndarray, score: np.ndarray) -> None:
        self.weights, self.chain, self.start, self.score = weights, chain, start, score

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, mod: int = 4, rest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
        texts, y, weight = labelled_sample(docs, labels, "toxic", mod, rest, per_class, id_col, text_col)
        return cls.fit_texts(texts, y, weight)

    @classmethod
    def fit_texts(cls, texts: list[str], y: np.ndarray, weight: np.ndarray) -> ToxicityModel:
        model = cls(np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(2), np.array([0.0, 0.0, 0.0, -40.0]))
        if not len(texts):
            return model
        lines = [[[w.lower() for w in _WORD.findall(x)] for x in text.split("\n")] for text in texts]
        half = np.arange(len(texts)) % 2 == 0
        toxic = _toxic_features([x for x, h in zip(lines, half, strict=True) if h], y[half])
        model._fit_chain([(x, t) for x, h, t in zip(lines, half, y, strict=True) if h], toxic)
        rest = ~half if (~half).any() else half
        tagger = Tagger(model)
        x = np.array([tagger.document(p, len(p)) for p in tagger.marginals([text for text, r in zip(texts, rest, strict=True) if r])])
        model.score = fit_logistic(x, y[rest], weight[rest])
        return model

    def _fit_chain(self, docs: list[tuple[list[list[str]], float]], toxic: set[str], epochs: int = 6, rate: float = 0.3) -> None:
        rng = np.random.default_rng(0)
        known: dict[str, tuple[np.ndarray, int]] = {}

        def look(word: str) -> tuple[np.ndarray, int]:
            if word not in known:
                features = word_features(word)
                known[word] = np.array([_bucket(f) for f in features] + [BUCKETS] * (5 - len(features))), int(any(f in toxic for f in features))
            return known[word]

        sequences = []
        for lines, label in docs:
            # of toxic documents, windows without a toxic word may be either
            for words in (line[i : i + WINDOW] for line in lines for i in range(0, len(line), WINDOW)):
                states = np.array([look(w)[1] if label else 0 for w in words])
                if not label or states.any():
                    sequences.append((np.array([look(w)[0] for w in words]), states))
        if not sequences:
            return
        weights, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
        chain, chain_squares = np.array([[0.0, -2.0], [0.0, -1.0]]), np.full((2, 2), 1e-6)
        bias, bias_square = -3.0, 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(sequences))
            for at in range(0, len(order), 128):
                batch = [sequences[i] for i in order[at : at + 128]]
                longest = max(len(s) for _, s in batch)
                index = np.full((len(batch), longest, 5), BUCKETS)
                state = np.zeros((len(batch), longest), int)
                there = np.zeros((len(batch), longest), bool)
                for i, (f, s) in enumerate(batch):
                    index[i, : len(s)], state[i, : len(s)], there[i, : len(s)] = f, s, True
                emission = np.where(there, weights[index].sum(axis=2) + bias, -30.0)
                one, two = forward_backward(emission, chain)
                error = np.where(there, one - state, 0.0)
                gradient = np.bincount(index.ravel(), np.repeat(error.ravel(), 5), BUCKETS + 1) / len(batch)
                gradient[BUCKETS] = 0
                gradient += 1e-4 * weights
                pair = there[:, 1:] & there[:, :-1]
                seen = np.array([[np.sum(pair & (state[:, :-1] == a) & (state[:, 1:] == b)) for b in (0, 1)] for a in (0, 1)])
                steps = (two * pair[:, :, None, None]).sum(axis=(0, 1)) - seen
                squares += gradient**2
                weights -= rate * gradient / np.sqrt(squares)
                chain_squares += (steps / len(batch)) ** 2
                chain -= 0.1 * rate * steps / len(batch) / np.sqrt(chain_squares)
                g = error.sum() / len(batch)
                bias_square += g**2
                bias -= 0.1 * rate * g / np.sqrt(bias_square)
        self.weights, self.chain, self.start = weights[:BUCKETS], chain, np.array([0.0, bias])


def _toxic_features(docs: list[list[list[str]]], y: np.ndarray, least: int = 3, odds: float = 2.5) -> set[str]:
    """Features of at least ``least`` toxic documents whose log odds of a toxic one are above ``odds``."""
    counts = (Counter(), Counter())
    for lines, label in zip(docs, y, strict=True):
        counts[int(label)].update({f for words in lines for w in set(words) for f in word_features(w)})
    n, t = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    return {f for f, c in counts[1].items() if c >= least and np.log((c + 0.5) / (t + 1)) - np.log((counts[0][f] + 0.5) / (n + 1)) >= odds}


def forward_backward(emission: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch of chains (rows) whose state 1 has these emissions and state 0 has 0: marginals of state 1, and of pairs."""
    n, t = emission.shape
    score = np.stack([np.zeros_like(emission), emission], axis=2)
    ahead, back = np.empty((n, t, 2)), np.zeros((n, t, 2))
    ahead[:, 0] = score[:, 0]
    for i in range(1, t):
        ahead[:, i] = np.logaddexp(ahead[:, i - 1, :1] + chain[0], ahead[:, i - 1, 1:] + chain[1]) + score[:, i]
    for i in range(t - 2, -1, -1):
        on = back[:, i + 1] + score[:, i + 1]
        back[:, i] = np.logaddexp(on[:, :1] + chain[:, 0], on[:, 1:] + chain[:, 1])
    both = ahead + back
    whole = np.logaddexp(both[:, 0, 0], both[:, 0, 1])
    pairs = np.exp(ahead[:, :-1, :, None] + chain + (score + back)[:, 1:, None, :] - whole[:, None, None, None]) if t > 1 else np.zeros((n, 0, 2, 2))
    return np.exp(both[:, :, 1] - whole[:, None]), pairs


def chain_marginals(emission: np.ndarray, chain: np.ndarray, step: int = _STEP) -> np.ndarray:
    """Marginals of state 1 of one long chain; a token with an emission of minus infinity separates what is on its sides.

    Odds of the two sums are carried, in blocks of ``step`` tokens that advance together: first every block's matrix, then
    the odds at each block's border, one by one, then all tokens from there.
    """
    n = len(emission)
    blocks = -(-n // step)
    e = np.full(blocks * step, -np.inf)
    e[:n] = np.clip(emission, None, 50)
    e = np.exp(e).reshape(blocks, step)
    to = np.exp(chain)

    def odds(e: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Odds of state 1 before each token's own emission; the pass comes from the left."""
        m = np.tile(np.eye(2), (blocks, 1, 1))  # (sum to 0, sum to 1) after the block, by state before it
        for i in range(step):
            m = m @ to
            m[:, :, 1] *= e[:, i, None]
            m /= m.max(axis=(1, 2), keepdims=True)
        border, now = np.zeros(blocks), 0.0
        for k, ((a, b), (c, d)) in enumerate(m.tolist()):
            border[k] = now
            now = min((b + now * d) / max(a + now * c, 1e-300), 1e300)
        out, r = np.empty((blocks, step)), border
        for i in range(step):
            out[:, i] = (to[0, 1] + r * to[1, 1]) / (to[0, 0] + r * to[1, 0])
            r = out[:, i] * e[:, i]
        return out

    ahead, back = odds(e, to), odds(e[::-1, ::-1], to.T)[::-1, ::-1]
    both = (ahead * e * back).reshape(-1)[:n]
    return both / (1 + both)


class Tagger(dict):
    """Emissions by word as written (worked out once) and what follows from them."""

    def __init__(self, model: ToxicityModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        self[word] = value = float(self.model.weights[[_bucket(f) for f in word_features(word.lower())]].sum() + self.model.start[1])
        return value

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text the marginals of its tokens."""
        if len(self) > _KEPT:
            self.clear()
        gap, runs, ends = np.array([-np.inf]), [np.array([-np.inf])], []
        for text in texts:
            words = _WORD.findall(text) if text else []
            runs += [np.fromiter(map(self.__getitem__, words), float, len(words)), gap]
            ends.append(len(words) + 1)
        p = chain_marginals(np.concatenate(runs), self.model.chain)
        stops = np.cumsum(ends)
        return [p[b - n + 1 : b] for b, n in zip(stops.tolist(), ends, strict=True)]

    @staticmethod
    def document(marginals: np.ndarray, n_words: int) -> np.ndarray:
        top = np.clip(marginals.max(initial=1e-4), 1e-4, 1 - 1e-4)
        return np.array([np.log(top / (1 - top)), np.log1p(marginals.sum()), np.log1p(n_words)])

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """Of each text its score, and the spans (start, end in code points, mean marginal) of runs of tokens that are likelier toxic than not."""
        found = self.marginals(texts)
        scores = sigmoid(np.array([self.document(p, len(p)) for p in found]).reshape(-1, 3) @ self.model.score[:-1] + self.model.score[-1])
        spans = []
        for x, p in zip(texts, found, strict=True):
            hot = np.flatnonzero(p >= 0.5)
            spans.append(list(_spans(x, dict(zip(hot.tolist(), p[hot].tolist(), strict=True)))) if len(hot) else [])
        return list(zip(scores.tolist(), spans, strict=True))


def _spans(text: str, toxic: dict[int, float]) -> Iterator[tuple[int, int, float]]:
    start = end = None
    run: list[float] = []
    for i, m in enumerate(_WORD.finditer(text)):
        if i in toxic:
            start, end = m.start() if start is None else start, m.end()
            run.append(toxic[i])
        elif run:
            yield start, end, sum(run) / len(run)
            start, run = None, []
    if run:
        yield start, end, sum(run) / len(run)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score and toxic_spans."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.chain, model.start, model.score))
    own: list[Tagger] = []

    def fn(text):
        if not own:
            own.append(Tagger(ToxicityModel(*shared.value)))
        found = own[0].score(text.to_pylist())
        return [[s for s, _ in found], [[{"start": a, "end": b, "p": p} for a, b, p in spans] for _, spans in found]]

    return map_columns(docs, {"text": text_col}, "score double, toxic_spans array<struct<start:int,end:int,p:double>>", fn)
