"""Byte-level BPE by backtracking over longest matches, in linear time.

Bytes become Latin-1 characters, so that a pyahocorasick automaton over all
token strings finds every match of a piece in one pass.  The encoder takes the
longest token at each position and keeps it if the merges would leave it and the
token before it side by side; that is decided once for each pair of tokens and
remembered.  Else it tries the next shorter token there, and where none is left
it takes the last token back and never comes to that position again.  The ids
are those that the merges give one by one.

Defined cases: null and empty texts have no ids; an id that the ranks lack
raises ValueError; repeated rows give repeated results; texts of any length are encoded
whole; an empty table gives an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import map_slices, texts
from tidewell.llm.tokens import UNIT

#: Bytes of units and pairs of tokens that a worker keeps; longer units than ``UNIT_BYTES`` are encoded anew.
CACHE_BYTES, CACHE_PAIRS, UNIT_BYTES = 96 << 20, 500_000, 64


class BacktrackingBPE:
    """``ranks``: token bytes to rank; every single byte is a token."""

    def __init__(self, ranks: dict[bytes, int], cache_pairs: int = CACHE_PAIRS):
        import ahocorasick

        self.token = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.token[i] = t
        self.size = [len(t) for t in self.token]
        #: The longest token that is a proper prefix of the token, or -1.
        self.shorter = [next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), -1) for t in self.token]
        self.known: dict[tuple[int, int], bool] = {}
        self.cache_pairs = cache_pairs
        self.halves: list[tuple[int, int] | None] = [None] * len(self.token)
        self.merged: dict[tuple[int, int], int] = {}
        for t in sorted(ranks, key=ranks.get):
            i, left = ranks[t], self.shorter[ranks[t]]
            while left >= 0:
                right = ranks.get(t[self.size[left] :], i)
                if left < i and right < i and self._side_by_side(left, right):
                    self.halves[i] = left, right
                    self.merged[left, right] = i
                    break
                left = self.shorter[left]
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()

    def _side_by_side(self, a: int, b: int) -> bool:
        """Whether no merge takes place across the border of tokens ``a`` and ``b``.

        The merges that made the two tokens are undone from the last one on;
        whenever two tokens that touch the border could have merged before that
        undone merge, the border would not have stayed.
        """
        limit = len(self.token)
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                return False
            split_a, split_b = self.halves[a], self.halves[b]
            if split_a is None and split_b is None:
                return True
            # Ranks are the order of merges: the later one is undone first; on the right side a merge of equal rank comes later.
            if split_b is None or (split_a is not None and a > b):
                limit, a = a, split_a[1]
            else:
                limit, b = b + 1, split_b[0]

    def compatible(self, a: int, b: int) -> bool:
        if (held := self.known.get((a, b))) is None:
            if len(self.known) >= self.cache_pairs:
                self.known.clear()
            held = self.known[a, b] = self._side_by_side(a, b)
        return held

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - self.size[i]
            if longest[start] < 0 or self.size[i] > self.size[longest[start]]:
                longest[start] = i
        if n and self.size[longest[0]] == n:
            return [longest[0]]
        out: list[int] = []
        open_ = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            if token < 0:
                open_[at] = 0
                if not out:
                    raise ValueError("a byte has no token")
                token = out.pop()
                at -= self.size[token]
                token = self.shorter[token]
            elif open_[at + self.size[token]] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at += self.size[token]
                token = longest[at] if at < n else -1
            else:
                token = self.shorter[token]
        return out


class Encoder:
    """Whole texts: each match of ``pattern`` is a piece of its own."""

    def __init__(self, path: str, pattern: str, cache_bytes: int = CACHE_BYTES):
        import regex

        with open(path, "rb") as f:
            self.bpe = BacktrackingBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.split = regex.compile(pattern).findall
        self.units: dict[str, bytes] = {}
        self.cache_bytes, self.held_bytes = cache_bytes, 0

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        units = UNIT.findall(text)
        parts = list(map(self.units.get, units))
        try:
            return b"".join(parts)
        except TypeError:
            return b"".join([self._unit(u) if p is None else p for u, p in zip(units, parts, strict=True)])

    def _unit(self, unit: str) -> bytes:
        if (got := self.units.get(unit)) is None:
            pieces = [piece.encode() for piece in self.split(unit)]
            got = np.array([i for piece in pieces for i in self.bpe.encode_piece(piece)], "<u4").tobytes()
            if sum(map(len, pieces)) <= UNIT_BYTES:
                self.held_bytes += 250 + 4 * len(unit) + len(got)
                if self.held_bytes > self.cache_bytes:
                    self.units.clear()
                    self.held_bytes = 0
                self.units[unit] = got
        return got

    def decode(self, ids: bytes) -> bytes:
        token = self.bpe.token
        try:
            return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])
        except IndexError:
            raise ValueError("an id has no token") from None


@functools.lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, pattern)


def _mapped(df: DataFrame, column: str, into: str, kind: pa.DataType, sql: str, function) -> DataFrame:
    keep = [c for c in df.columns if c not in (column, into)]

    def start():
        one = function()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([one(x) for x in batch.column(0).to_pylist()], kind)], [*keep, into])

        return step

    return map_slices(df.select(column, *keep), start, ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), f"`{into}` {sql}"]))


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """The other columns, and the ids of ``text``."""

    def function():
        encode = encoder(path, pattern).encode
        return lambda x: encode(x or "")

    return _mapped(df, text, into, pa.binary(), "binary", function)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The other columns, and the bytes that ``ids`` stand for; null ids stay null."""

    def function():
        decode = encoder(path, pattern).decode
        return lambda x: None if x is None else decode(x)

    return _mapped(df, ids, into, pa.binary(), "binary", function)
