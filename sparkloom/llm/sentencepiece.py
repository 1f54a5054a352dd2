"""Encoding and decoding with the vocabulary of a SentencePiece BPE model, by a table of prefixes.

For each prefix of a text the merges leave one last token, whatever follows. An Aho-Corasick automaton gives every
vocabulary entry that ends at a position; the entry is the prefix's last token if it may stand after the last token of
the prefix before it, and two tokens may stand side by side if merging their joined text gives back just these two. The
ids are then read backwards from the whole text's last token.

Vocabulary entries hold the space mark only in front, so words are independent and their ids are kept in a bounded
table. Marks in a row share one score in such models: those runs are merged leftmost first, as the library breaks ties.

Defined results: a null text is an empty one and gives the end id alone (if asked for); characters outside the
vocabulary become their UTF-8 bytes' ids; an empty table gives an empty result; other columns are carried along, and
columns named as an output are replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sparkloom.llm.arrow import map_columns

MARK = "▁"
_KEPT_WORDS = 300_000  # remembered words per task, some 60 MB
_KEPT_LENGTH = 48
_KEPT_PAIRS = 500_000
_KEPT_RUNS = 1_000


class PrefixTokenizer:
    """Reads the model file's protobuf through the library's own message class; all encoding is done here."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("a BPE model without text normalisation is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.end = next((i for i, p in enumerate(proto.pieces) if p.piece == "</s>"), -1)
        self.control = frozenset(i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL)
        byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte = [byte[i] for i in range(256)] if len(byte) == 256 else None
        self.byte_of = {i: b for b, i in byte.items()}
        # ids whose text depends on nothing around them; all but the first piece's leading space
        self.plain = ["" if i in self.control else chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.slow = frozenset({self.unk, *(i for i, b in self.byte_of.items() if b > 127)})
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.split_by_mark = not any(MARK in p.lstrip(MARK) for p in self.score)
        if not self.split_by_mark or any(p.startswith(MARK * 2) and p.strip(MARK) for p in self.score):
            raise ValueError("pieces with a space mark inside are not supported")
        # tokens that merging their own text gives back; with the last merge's two parts
        self.automaton = ahocorasick.Automaton()
        self.parts: dict[str, tuple[str, str] | None] = {}
        for piece in sorted(self.score, key=len):
            if piece.strip(MARK) or len(piece) == 1:
                merged, last = self._merge(piece)
                if merged == [piece]:
                    self.parts[piece] = last
                    self.automaton.add_word(piece, (len(piece), self.id[piece]))
        self.automaton.make_automaton()
        self.sizes = [len(p) for p in self.pieces]
        self.pairs: list[dict[int, bool]] = [{} for _ in self.pieces]
        self.n_pairs = 0
        self.mark_runs: dict[int, tuple[int, ...]] = {}
        self.known = _Words(self)

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merges from scratch: best score first, leftmost among equals. Also the last merge's two parts."""
        symbols, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        alive, heap, last = [True] * len(symbols), [], None

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(symbols) and (both := symbols[i] + symbols[j]) in self.score:
                heapq.heappush(heap, (-self.score[both], i, j, both))

        for i in range(len(symbols) - 1):
            push(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not (alive[i] and alive[j] and after[i] == j and symbols[i] + symbols[j] == both):
                continue
            last = (symbols[i], symbols[j])
            symbols[i], alive[j], after[i] = both, False, after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [s for s, a in zip(symbols, alive, strict=True) if a], last

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging a's text followed by b's gives back [a, b].

        Both are taken apart from their last merge down, on the sides that touch: a merge across the border would have
        come before the younger of the two parts that it uses was made.
        """
        if self.n_pairs >= _KEPT_PAIRS:
            for row in self.pairs:
                row.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        known = self.pairs[a][b] = self._compatible(self.pieces[a], self.pieces[b])
        return known

    def _compatible(self, a: str, b: str) -> bool:
        score, parts = self.score, self.parts
        limit = float("-inf")  # a merge across the border below this score comes too late
        while True:
            both = score.get(a + b)
            if both is not None and both > limit:
                return False
            pa, pb = parts.get(a), parts.get(b)
            if pa is None and pb is None:
                return True
            # undo the later merge; where the scores are equal, the right one, as the left comes first
            if pb is None or (pa is not None and score[a] < score[b]):
                limit = max(limit, score[a])
                a = pa[1]
                # on equal scores the border merge, which stands right of a's, loses
            else:
                limit = max(limit, score[b])
                b = pb[0]
                if (s := score.get(a + b)) is not None and s == limit:
                    return False  # it stands left of b's merge

    def _word(self, text: str) -> tuple[int, ...]:
        """Ids of a text without marks but for one in front, by its prefixes."""
        last: list[int | None] = [None] * (len(text) + 1)
        pairs, compatible = self.pairs, self.compatible
        for at, (size, piece) in self.automaton.iter(text):  # all entries that end at a place come in a row
            at += 1
            if last[at] is not None:
                continue
            if before := at - size:
                left = last[before]
                if left is not None:  # else a character outside the vocabulary, which joins nothing
                    fits = pairs[left].get(piece)
                    if not (compatible(left, piece) if fits is None else fits):
                        continue
            last[at] = piece
        ids: list[int] = []
        at = len(text)
        while at:
            piece = last[at]
            if piece is not None:
                ids.append(piece)
                at -= self.sizes[piece]
            else:
                at -= 1
                ids.extend([self.byte[b] for b in reversed(text[at].encode())] if self.byte else [self.unk])
        return tuple(reversed(ids))

    def _marks(self, n: int) -> tuple[int, ...]:
        """Ids of a run of marks."""
        found = self.mark_runs.get(n)
        if found is None:
            if len(self.mark_runs) >= _KEPT_RUNS:
                self.mark_runs.clear()
            found = self.mark_runs[n] = tuple(self.id.get(x, self.unk) for x in self._merge(MARK * n)[0])
        return found

    def _segment(self, text: str) -> tuple[int, ...]:
        """Ids of marks followed by other characters: all marks but the last stand alone, and the last one too where it joins nothing."""
        marks = len(text) - len(text.lstrip(MARK))
        if marks == len(text):
            return self._marks(marks)
        if marks < 2:
            return self._word(text)
        rest = self._word(text[marks - 1 :])
        if rest[0] == self.id.get(MARK):
            return self._marks(marks) + rest[1:]
        return self._marks(marks - 1) + rest

    def packed(self, text: str | None, add_end: bool = False) -> bytes:
        """The ids as native 32-bit integers."""
        out = b""
        if text:
            if len(self.known) > _KEPT_WORDS:
                self.known.clear()
            out = b"".join(map(self.known.__getitem__, self.words.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))))
        return out + pack("i", self.end) if add_end else out

    def encode(self, text: str | None, add_end: bool = False) -> list[int]:
        """The library's encode(text, add_eos=add_end)."""
        return memoryview(self.packed(text, add_end)).cast("i").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode(ids): byte ids join to characters, broken bytes become U+FFFD, one leading space goes."""
        ids = ids if isinstance(ids, list) else list(ids)
        if self.slow.isdisjoint(ids):
            text = "".join(map(self.plain.__getitem__, ids))
            if self.dummy_prefix and text.startswith(" "):
                first = next(i for i in ids if i not in self.control)
                text = text[1:] if first not in self.byte_of else text
            return text
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i == self.unk:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.pieces[i].replace(MARK, " ") if out or not self.dummy_prefix else self.pieces[i].removeprefix(MARK).replace(MARK, " "))
        if run:
            out.append(_utf8(run))
        return "".join(out)


class _Words(dict):
    """Packed ids by word, worked out on first sight; long words are not kept."""

    def __init__(self, tokenizer: PrefixTokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        ids = self.tokenizer._segment(word)
        out = pack(f"{len(ids)}i", *ids)
        if len(word) <= _KEPT_LENGTH:
            self[word] = out
        return out


def _utf8(run: bytearray) -> str:
    """Each byte that is part of no whole character becomes one U+FFFD, as in the library."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_LOADED: dict[int, PrefixTokenizer] = {}


def _tokenizer(model) -> PrefixTokenizer:
    """One per task and model."""
    key = model.id if hasattr(model, "id") else id(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PrefixTokenizer(model.value)
    return _LOADED[key]


def _forget() -> None:
    _LOADED.clear()


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", add_end: bool = True, decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the ids of each whole text. model_path is read by the driver; its 0.5 MB are broadcast.

    decoded_col: also the text that decode() makes of the ids, in the same pass. keep: the columns to carry, all by default.
    """
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())

    def fn(text):
        own = _tokenizer(model)
        packed = [own.packed(x, add_end) for x in text.to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        return [ids, [own.decode(memoryview(x).cast("i").tolist()) for x in packed]] if decoded_col else [ids]

    return map_columns(df, {"text": text_col}, f"`{ids_col}` array<int>" + (f", `{decoded_col}` string" if decoded_col else ""), fn, keep, _forget)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of each id list; null for null."""
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())

    def fn(ids):
        own, null = _tokenizer(model), np.asarray(ids.is_null())
        lengths = np.asarray(pc.fill_null(pc.list_value_length(ids), 0))
        flat = pc.fill_null(ids.flatten(), own.unk).to_numpy().tolist()
        out, at = [], 0
        for n, none in zip(lengths.tolist(), null.tolist(), strict=True):
            out.append(None if none else own.decode(flat[at : at + n]))
            at += n
        return [out]

    return map_columns(df, {"ids": ids_col}, f"`{text_col}` string", fn, done=_forget)
