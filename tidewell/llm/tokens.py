"""Token ids of whole texts by a public tokenizer file, through a bounded cache of units.

A unit is a piece of text whose ids don't depend on what stands around it: a
white-space-delimited word where the tokenizer drops white space, else a word
with the one space before it, or a run of white space.  Texts repeat their
words, so most units come from a dictionary; new ones are split, mapped to
the byte alphabet and merged by the file's own model, hundreds at a time.

The cache is bounded in bytes and never keeps a unit of over ``UNIT_BYTES``, so
texts without spaces take no more memory than others.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import xxhash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of units and their ids that a worker keeps, with what each entry takes besides; longer units than ``UNIT_BYTES`` are encoded anew.
CACHE_BYTES, UNIT_BYTES, ENTRY_BYTES = 160 << 20, 64, 200

#: Bytes of the ids of whole texts that a worker keeps, by the texts' 128-bit hashes: copies are encoded once.
COPY_BYTES = 40 << 20

#: The characters with the Unicode property White_Space, and the contractions of both patterns.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

#: What a text with other white space than one space or line break between words holds, unless it is at the text's ends.
UNEVEN = ("  ", " \n", "\n ", "\n\n", *"\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))
UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Units of these characters alone are split here; their case, normal form and classes are the same in every Unicode version.
PLAIN = re.compile("[ -~À-ÿ]*")
PLAIN_LINES = re.compile("[ -~À-ÿ\n]*")
LETTER = "a-zA-ZÀ-ÖØ-öø-ÿ"
#: For units in lines of their own.
PRETOKEN = {
    "byte": re.compile(f"{CONTRACTIONS}| ?[{LETTER}]+| ?[0-9]+| ?[^ {LETTER}0-9\n]+| +"),
    "word": re.compile(f"{CONTRACTIONS}|[{LETTER}]+|[0-9]|[^ {LETTER}0-9\n]+"),
}
BULK = 200


@functools.cache
def byte_alphabet() -> str:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from 256 on; line breaks stay."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    alphabet = [chr(b if b in printable else next(rest)) for b in range(256)]
    alphabet[10] = "\n"  # never within a unit that is mapped here
    return "".join(alphabet)


class CachedTokenizer:
    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = "byte" if self.whole.normalizer is None else "word"
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.merges.encode_special_tokens = True
        vocabulary = self.whole.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token) - 4 * (self.kind == "word" and len(token) > 4 and token.endswith("</w>"))
        self.cache = _Cache()
        self.copies: dict[bytes, bytes] = {}
        self.copy_bytes = 0
        self.cache_bytes, self.held_bytes = cache_bytes, 0

    def units(self, text: str) -> list:
        """Keys of the text's units in the cache: a word stands for itself after a space, bytes for any other unit."""
        if self.kind == "word":
            return text.encode().split()
        if not text or text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, UNEVEN)):
            return [u[1:] if u[0] == " " and not u.isspace() else u.encode() for u in UNIT.findall(text)]
        out: list = []
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = words[0].encode()
            out += words
            out.append(b"\n")
        out.pop()
        return out

    def strings(self, units: list) -> list[str]:
        return [f" {u}" if isinstance(u, str) else u.decode() for u in units]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cache, out, late = self.cache, [], []
        marks = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
        for i, text in enumerate(texts):
            if (held := self.copies.get(marks[i])) is not None:
                out.append(held)
                continue
            ids = list(map(cache.__getitem__, self.units(text)))
            if cache.new:
                out.append(b"")
                late.append((i, ids))
            else:
                out.append(b"".join(ids))
        if cache.new:
            new = self.encode_units(list(cache.new))
            for u, place in cache.new.items():
                place += new[u]
            for i, ids in late:
                out[i] = b"".join(ids)
            cache.new = {}
            kept = {u: x for u, x in new.items() if len(u) <= UNIT_BYTES}
            size = sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY_BYTES * len(kept)
            # A full cache keeps what it has: the units that came early are the frequent ones.
            if len(kept) == len(new) and self.held_bytes + size <= self.cache_bytes:
                cache.update(kept)
                self.held_bytes += size
        for mark, ids in zip(marks, out, strict=True):
            if mark not in self.copies and len(ids) <= COPY_BYTES // 64:
                self.copy_bytes += len(ids) + ENTRY_BYTES
                if self.copy_bytes > COPY_BYTES:
                    self.copies.clear()
                    self.copy_bytes = len(ids) + ENTRY_BYTES
                self.copies[mark] = ids
        return out

    def encode_units(self, units: list) -> dict:
        out, other = {}, []
        for at in range(0, len(units), BULK):
            some = units[at : at + BULK]
            strings = self.strings(some)
            lines = "\n".join(strings)
            if not PLAIN_LINES.fullmatch(lines) or lines.count("\n") >= len(some) or any(map(str.isspace, strings)):
                plain = [(u, s) for u, s in zip(some, strings, strict=True) if PLAIN.fullmatch(s) and not s.isspace()]
                held = {u for u, _ in plain}
                other += [(u, s) for u, s in zip(some, strings, strict=True) if u not in held]
                some, lines = [u for u, _ in plain], "\n".join([s for _, s in plain])
            if some:
                if (ids := self._merge(lines)) is None:
                    other += zip(some, lines.split("\n"), strict=True)
                else:
                    out.update(zip(some, ids, strict=True))
        for (u, _), e in zip(other, self.whole.encode_batch_fast([s for _, s in other], add_special_tokens=False), strict=True):
            out[u] = np.array(e.ids, "<u4").tobytes()
        return out

    def _merge(self, lines: str) -> list[bytes] | None:
        """The ids of units of plain characters, which ``lines`` holds one a line; None if they can't be told apart."""
        pieces = "\n".join(PRETOKEN[self.kind].findall(lines.lower() if self.kind == "word" else lines))
        mapped = pieces.encode().decode("latin-1").translate(byte_alphabet())
        ids = np.array(self.merges.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
        strings = lines.split("\n")
        ends = np.cumsum(list(map(len, strings)) if lines.isascii() else [len(s.encode()) for s in strings])
        at = np.cumsum(self.width[ids])
        cut = np.searchsorted(at, ends) + 1
        if not len(at) or not np.array_equal(at[np.minimum(cut, len(at)) - 1], ends):
            return None
        data, last = ids.tobytes(), 0
        return [data[4 * a : 4 * b] for a, b in zip([last, *cut[:-1].tolist()], cut.tolist(), strict=True)]


class _Cache(dict):
    """Ids of units; one that isn't held gets an empty place in ``new``, which its ids are written to before texts are joined."""

    def __init__(self):
        super().__init__()
        self.new: dict = {}

    def __missing__(self, unit) -> bytearray:
        if (place := self.new.get(unit)) is None:
            place = self.new[unit] = bytearray()
        return place


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    """One for each Python worker and file."""
    return CachedTokenizer(path)
