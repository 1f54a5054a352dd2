"""Periodic runs of words: grouping of suffixes by Lyndon prefixes, Lyndon roots, extension into runs.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping that period; those
of at least ``min_words`` words and ``min_periods`` periods are reported. A word seen fewer than ``min_periods`` times in a
text lies in no such run, so the stretches between these words are segments of their own, and runs do not reach out of them.
For each segment:

1. The first phase of Baier's suffix sorter groups its suffixes by their longest Lyndon prefixes: groups are taken in
   descending order, and the blocks before their members take these in, which moves them to new groups right above their
   old ones. What is left is the Lyndon array, the length of each group's prefix. It is made under the order of the words
   and under the reverse one.
2. The Lyndon root of a run is the longest Lyndon word at its place under one of both orders. So each root is compared with
   the words that follow it and extended both ways by the longest common extensions, which yields the runs, each one once.

Work is linear in a text's words but for the extensions of roots that do not make a run. A word is dropped from the collapsed
text if a run holds it after that run's first period.

Defined results: a null text has no runs and stays null; an empty one, or one of fewer than ``min_words`` words, has no runs;
texts of any length are read as a whole; repeated rows are judged each by itself, and an empty table gives an empty result;
of runs that tie all are reported, by start and then period; other columns are carried along whatever their names, and columns
named as an output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import map_columns

MIN_WORDS, MIN_PERIODS = 24, 3
_STEP = 64


def lyndon_array(ranks: Sequence[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, by grouping suffixes in descending order of their groups.

    Blocks tile the sequence; a block is a Lyndon word, and all blocks of a group are equal. When the highest group left is
    taken, its blocks are final, and the block before each stretch of them (a lower one) takes the stretch in. Blocks of one
    group that have taken in the same go to one new group above their old one, those that took in more of them above.
    """
    n = len(ranks)
    symbols = sorted(set(ranks))
    number = {x: k for k, x in enumerate(symbols)}
    group = [number[x] for x in ranks]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * len(symbols)  # of a group's prefix
    below = list(range(-1, len(symbols) - 1))
    above = list(range(1, len(symbols) + 1))
    before = list(range(-1, n))  # at each place, where the block that ends there begins
    group.append(-1)  # beyond the end, lower than all; also what place -1 reads
    now = len(symbols) - 1
    while now >= 0:
        size = length[now]
        moved: dict[tuple[int, int], list[int]] = {}
        for i in members[now]:
            if group[i] != now:
                continue  # has gone to a higher group
            head = before[i]
            if group[head] == now:
                continue  # within a stretch
            end, count = i + size, 1
            while group[end] == now:
                end += size
                count += 1
            if end < n:
                before[end] = head
            if head >= 0:
                key = (group[head], count)
                if key in moved:
                    moved[key].append(head)
                else:
                    moved[key] = [head]
        for key in sorted(moved, reverse=True):  # more copies first: later ones go in between
            old, count = key
            new = len(length)
            heads = moved[key]
            members.append(heads)
            length.append(length[old] + count * size)
            for head in heads:
                group[head] = new
            up = above[old]  # there is one: what takes others in is below them
            above.append(up)
            below.append(old)
            above[old] = below[up] = new
        members[now] = []
        now = below[now]
    return [length[g] for g in group[:n]]


def _right(s: Sequence[int], a: int, b: int) -> int:
    """How far the sequences from a < b agree."""
    n, at, step = len(s), 0, _STEP
    while b + at + step <= n and s[a + at : a + at + step] == s[b + at : b + at + step]:
        at += step
        step *= 2
    while step > 0:
        if b + at + step <= n and s[a + at : a + at + step] == s[b + at : b + at + step]:
            at += step
        step //= 2
    return at


def _left(s: Sequence[int], a: int, b: int) -> int:
    """How far the sequences that end before a < b agree."""
    at, step = 0, _STEP
    while a - at - step >= 0 and s[a - at - step : a - at] == s[b - at - step : b - at]:
        at += step
        step *= 2
    while step > 0:
        if a - at - step >= 0 and s[a - at - step : a - at] == s[b - at - step : b - at]:
            at += step
        step //= 2
    return at


def runs(ranks: list[int], min_words: int = 2, min_periods: int = 2) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence; at least two periods, as runs have."""
    n, out = len(ranks), set()
    top = max(ranks, default=0)
    sure = min_periods > 2  # the first root of a run begins within its first period, so whole periods follow it
    for order in (ranks, [top - x for x in ranks]):
        reached: dict[int, int] = {}  # where the last run found of each period ends
        for i, q in enumerate(lyndon_array(order)):
            if i + q <= reached.get(q, 0) or i + min_periods * q > n + q or (sure and (i + 2 * q > n or ranks[i] != ranks[i + q] or ranks[i + q - 1] != ranks[i + 2 * q - 1])):
                continue  # of a run that is found, or of none
            right = _right(ranks, i, i + q)
            if right < (min_periods - 2) * q:
                continue
            left = _left(ranks, i, i + q)
            if left + right < q:
                continue
            reached[q] = i + q + right
            if left + q + right >= max(min_words, min_periods * q):
                out.add((i - left, left + q + right, q))
    return out


def word_runs(words: list[bytes], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """The runs of a text's words, by start and then period."""
    if len(words) < min_words:
        return []
    common = {w for w, n in Counter(words).items() if n >= min_periods}
    found = []
    for part in re.finditer(b"\1{%d,}" % min_words, bytes(map(common.__contains__, words))):
        number: dict[bytes, int] = {}
        ranks = [number.setdefault(w, len(number)) for w in words[part.start() : part.end()]]
        found += [(part.start() + a, b, q) for a, b, q in runs(ranks, min_words, min_periods)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    keep = bytearray(b"\1") * len(words)
    for start, length, period in found:
        keep[start + period : start + length] = bytes(length - period)
    return [w for w, ok in zip(words, keep, strict=True) if ok]


def periodic_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``docs`` with its texts' runs (start, length, period, in words) and the texts without what the runs repeat.

    Words are runs of characters outside space and 0x09-0x0D; those of the collapsed text are joined by one space.
    """

    def find(text: pa.Array) -> list:
        spans, short = [], []
        for whole in text.cast(pa.binary()).to_pylist():
            words = (whole or b"").split()  # of bytes: at exactly these characters
            found = word_runs(words, min_words, min_periods)
            spans.append([{"start": a, "length": b, "period": q} for a, b, q in found])
            short.append(None if whole is None else b" ".join(collapse(words, found)).decode())
        return [spans, short]

    return map_columns(docs, {"text": text_col}, f"`{runs_col}` array<struct<start:bigint,length:bigint,period:bigint>>, `{collapsed_col}` string", find)


def best_run(runs_col: str = "runs") -> Column:
    """The run of the greatest length by period, compared exactly; of ties the first, then that of the shortest period."""

    def beats(a: Column, b: Column) -> Column:
        by_ratio = F.signum(a["length"] * b["period"] - b["length"] * a["period"])
        return (by_ratio > 0) | ((by_ratio == 0) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))

    return F.aggregate(F.col(runs_col), F.element_at(F.col(runs_col), F.when(F.size(runs_col) > 0, F.lit(1))), lambda best, x: F.when(beats(x, best), x).otherwise(best))
