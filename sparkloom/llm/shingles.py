"""Word shingles of whole UTF-8 texts as 64-bit hashes, computed over Arrow buffers with numpy.

A word is a run of bytes outside space and 0x09-0x0D; A-Z are lowered. A text's set holds the hashes of its distinct
runs of ``k`` words; a text of fewer words is one shingle, the whole sequence; no words give the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are hashed in runs of about this many bytes, so that scratch arrays stay small
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed))


class _Powers:
    """Powers of the odd base and of its inverse modulo 2**64, long enough for the longest text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)
            self.down = np.cumprod(np.full(n, inverse, np.uint64), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, and how many words each text has. ends: where each text ends."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    black = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = True
    edge[ends] = True
    first = black.copy()
    first[1:] &= ~black[:-1] | edge[1:-1]
    last = black.copy()
    last[:-1] &= ~black[1:] | edge[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _POWERS.to(len(data) + 1)
    run = np.cumsum(_LOWER[data] * up[: len(data)], dtype=np.uint64)
    before = np.where(start > 0, run[start - 1], np.uint64(0))
    hashes = mix((run[stop] - before) * down[start] + (stop - start).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes (uint64); null and wordless texts give empty arrays."""
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    null = np.asarray(texts.is_null())
    lengths = np.where(null, 0, np.diff(off))
    weights, tail = seeds(k, 7), seeds(k, 11)
    at = 0
    while at < len(texts):
        total = np.cumsum(lengths[at:])
        to = at + max(1, int(np.searchsorted(total, CHUNK_BYTES, "right")))
        ends = total[: to - at]
        if null[at:to].any():
            data = np.concatenate([raw[off[i] : off[i + 1]] for i in range(at, to) if not null[i]] or [raw[:0]])
        else:
            data = raw[off[at] : off[to]]
        hashes, counts = _words(data, ends)
        n = len(hashes)
        joined = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            joined += hashes[j : n - k + 1 + j] * weights[j] if n >= k else np.zeros(0, np.uint64)
        joined = mix(joined)
        stop = np.cumsum(counts)
        for b, c in zip(stop, counts, strict=True):
            if c >= k:
                yield np.unique(joined[b - c : b - k + 1])
            elif c:
                yield mix((hashes[b - c : b] * weights[:c]).sum(dtype=np.uint64, keepdims=True) ^ tail[c])
            else:
                yield np.zeros(0, np.uint64)
        at = to


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """Two sums over a set's hashes, as signed longs: equal sets, equal fingerprints."""
    a = mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix(values ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


class FastSimilaritySketch:
    """Sketches of ``t`` coordinates by rounds of hashed bin placement.

    In round i < t every element is placed in a hashed bin with value i plus a hashed fraction; in round t + j every
    element goes to bin j. A coordinate keeps its smallest value, so each one is filled after 2t rounds at most, and
    the share of equal coordinates of two sketches estimates the Jaccard similarity with Chernoff-type bounds
    (Dahlgaard, Knudsen, Thorup: Fast Similarity Sketching, FOCS 2017). About ln(t) * t / n rounds are needed, so they
    are placed in one vectorised step and the rest only if a bin is still empty.
    """

    def __init__(self, t: int = 384, seed: int = 1) -> None:
        self.t, self.seeds = t, seeds(2 * t, seed)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        t, n = self.t, len(values)
        out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
        if not n:
            return out
        done, step = 0, max(1, int(np.ceil(t * (np.log(t) + 1.5) / n)))
        while done < t:
            rounds = np.arange(done, min(t, done + step), dtype=np.uint64)
            x = mix(values[None, :] ^ self.seeds[done : done + len(rounds), None])
            place = (rounds[:, None] << np.uint64(52)) | (x >> np.uint64(12))
            np.minimum.at(out, (((x & np.uint64(0xFFFFFFFF)) * np.uint64(t)) >> np.uint64(32)).ravel().astype(np.intp), place.ravel())
            done += len(rounds)
            if (out != np.iinfo(np.uint64).max).all():
                return out
        for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
            out[j] = np.uint64((t + int(j)) << 52) | (mix(values ^ self.seeds[t + j]).min() >> np.uint64(12))
        return out
