"""Language identification by unigrams that are summed over all segmentations.

Each language has probabilities of the pieces of a fixed public vocabulary.  A
word's probability is the sum over all ways to cut it into pieces, by the
forward algorithm; a text's is the product over its words (runs without white
space, lower case, with the mark of a word's start).  The probabilities are
learned by expectation-maximisation over the counted words of each language.

Learning reads a bounded sample: about ``DOCUMENTS`` documents of each language,
those with the least hash of their key.  Scoring is one pass over the texts.

Defined cases: null texts and those without a letter are ``und`` with score 0;
equal posteriors go to the first language in alphabetical order; documents with
a null language aren't learned from; without any language all are ``und``;
repeated rows get equal results; an empty table gives an empty table.  Other columns
pass through, whatever their names; those called like the two results are replaced
(``into`` names them).  Texts count whole.  A character that the vocabulary lacks is a
piece of its own kind.  Learning (not scoring) cuts words of over ``WORD_CHARS``.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Workspace, fresh, map_slices, quoted, texts

DOCUMENTS, ROUNDS, WORD_CHARS, SMOOTHING = 3000, 3, 64, 0.1
#: Words that a worker keeps, of at most ``CACHE_CHARS`` characters; words and characters that are counted at a time.
CACHE_WORDS, CACHE_CHARS, FLUSH_WORDS, FLUSH_CHARS = 700_000, 64, 200_000, 1 << 26
MARK, TINY = "▁", 1e-150
#: Words of at most so many characters are summed many at a time; their probabilities need no scaling.
BULK_CHARS, BULK_WORDS = 24, 8192


class Pieces:
    """A trie of the vocabulary; number 0 stands for an unknown character."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = sp.get_piece_size() + 1
        self.trie: dict = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
                continue
            node = self.trie
            for c in sp.id_to_piece(i):
                node = node.setdefault(c, {})
            node[""] = i + 1

    def lattice(self, word: str) -> list[list[tuple[int, int]]]:
        """For each position the (end, piece) of the pieces that start there."""
        out, n = [], len(word)
        for i in range(n):
            node, found = self.trie, []
            for j in range(i, n):
                if (node := node.get(word[j])) is None:
                    break
                if (piece := node.get("")) is not None:
                    found.append((j + 1, piece))
            if not found or found[0][0] != i + 1:
                found.append((i + 1, 0))
            out.append(found)
        return out


    def edges(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of the lattices of words of fewer than 64 characters, by start."""
        out: list[int] = []
        add, trie = out.append, self.trie
        for k, word in enumerate(found):
            n = len(word)
            for i in range(n):
                at, node = k << 6 | i, trie.get(word[i])
                if node is None:
                    add((at << 6 | i + 1) << 20)
                    continue
                piece = node.get("")
                add((at << 6 | i + 1) << 20 | (piece or 0))
                for j in range(i + 1, n):
                    if (node := node.get(word[j])) is None:
                        break
                    if (piece := node.get("")) is not None:
                        add((at << 6 | j + 1) << 20 | piece)
        x = np.array(out, np.int64)
        x = x[np.argsort(x >> 26 & 63, kind="stable")]
        return x >> 32, x >> 26 & 63, x >> 20 & 63, x & 0xFFFFF


@functools.lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(path)


def words(text: str) -> list[str]:
    return text.lower().split()


def forward(lattice: list[list[tuple[int, int]]], theta: list[float]) -> float:
    """log of the sum over all segmentations; sums are scaled where they get small."""
    alpha, held = [1.0] + [0.0] * len(lattice), 0.0
    for i, found in enumerate(lattice):
        a = alpha[i]
        if a < TINY:
            held += math.log(a)
            for j in range(i + 1, min(len(alpha), i + 65)):  # no piece reaches further
                alpha[j] /= a
            a = 1.0
        for j, piece in found:
            alpha[j] += a * theta[piece]
    return held + math.log(alpha[-1])


def expected(lattice: list[list[tuple[int, int]]], theta: list[float], weight: float, into: dict[int, float]) -> None:
    """Add ``weight`` times the expected number of each piece."""
    n = len(lattice)
    alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, found in enumerate(lattice):
        for j, piece in found:
            alpha[j] += alpha[i] * theta[piece]
    if not (total := alpha[n]):
        return
    for i in range(n - 1, -1, -1):
        b, a = 0.0, alpha[i] * weight / total
        for j, piece in lattice[i]:
            x = theta[piece] * beta[j]
            b += x
            into[piece] = into.get(piece, 0.0) + a * x
        beta[i] = b


@dataclass
class Model:
    vocabulary: str
    languages: list[str]
    prior: np.ndarray  # log shares
    theta: np.ndarray  # (languages, pieces)


def count_words(docs: DataFrame, group: str, text: str) -> DataFrame:
    """(group, word, n), summed in each task before the shuffle; a task holds a bounded number of words."""
    kind = docs.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Counter(), 0

        def out() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())], [group, "word", "n"])

        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                held.update((g, w[i : i + WORD_CHARS]) for w in words(t) for i in range(0, len(w), WORD_CHARS))
                size += len(t)
                if len(held) > FLUSH_WORDS or size > FLUSH_CHARS:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    return docs.select(group, text).mapInArrow(run, f"`{group}` {kind}, word string, n long").groupBy(group, "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: str, work: Workspace, key: str = "doc_id", text: str = "text", lang: str = "lang", documents: int = DOCUMENTS, rounds: int = ROUNDS, learn: Column | None = None) -> Model:
    """Learn from the rows of ``docs`` for which ``learn`` holds; ``lang`` is a string column."""
    learn = F.lit(True) if learn is None else learn
    rows = docs.filter(learn & F.col(lang).isNotNull())
    shares = sorted(map(tuple, rows.groupBy(lang).count().collect()))  # a row for each language
    if not shares:
        return Model(vocabulary, [], np.zeros(0), np.zeros((0, 0)))
    languages = [s for s, _ in shares]
    total = sum(n for _, n in shares)
    part = F.create_map(*[F.lit(x) for s, n in shares for x in (s, min(1.0, documents / n))])
    chosen = rows.filter((F.abs(F.xxhash64(key, F.lit(11))) % 1_000_003) / F.lit(1_000_003.0) < part[F.col(lang)])
    counted = work.write(count_words(chosen.select(F.col(lang).alias("g"), F.col(text).alias("t")), "g", "t"), "words")
    n = pieces(vocabulary).n
    theta = np.full((len(languages), n), 1.0 / n)
    for _ in range(rounds):
        number, held = {s: i for i, s in enumerate(languages)}, theta

        def run(batches: Iterator[pa.RecordBatch], number=number, held=held) -> Iterator[pa.RecordBatch]:
            lattice, rows, sums = pieces(vocabulary).lattice, held.tolist(), [{} for _ in number]
            for batch in batches:
                for g, w, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    expected(lattice(MARK + w), rows[number[g]], k, sums[number[g]])
            flat = [(i, p, e) for i, s in enumerate(sums) for p, e in s.items()]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in flat], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["l", "p", "e"])

        sums = counted.mapInArrow(run, "l long, p long, e double").groupBy("l", "p").agg(F.sum("e").alias("e")).toPandas()  # pieces times languages at most
        theta = np.full((len(languages), n), SMOOTHING)
        theta[sums["l"].to_numpy(), sums["p"].to_numpy()] += sums["e"].to_numpy()
        theta /= theta.sum(1, keepdims=True)
    work.drop("words")
    return Model(vocabulary, languages, np.log(np.array([k for _, k in shares]) / total), theta)


class Scorer:
    """Log probabilities of texts in each language, by a bounded cache of words."""

    def __init__(self, model: Model, cache_words: int = CACHE_WORDS):
        self.model, self.rows, self.columns = model, model.theta.tolist(), np.ascontiguousarray(model.theta.T)
        self.at: dict[str, int] = {}
        self.logs, self.used = np.zeros((1024, len(model.languages))), 0
        self.cache_words = cache_words
        self.pieces = pieces(model.vocabulary)

    def words(self, found: list[str]) -> np.ndarray:
        """One row of logarithms for each word, which are summed over all segmentations many words at a time."""
        out = np.zeros((len(found), len(self.rows)))
        short = [i for i, w in enumerate(found) if len(w) < BULK_CHARS]
        for k in range(0, len(short), BULK_WORDS):
            some = short[k : k + BULK_WORDS]
            marked = [MARK + found[i] for i in some]
            word, start, end, piece = self.pieces.edges(marked)
            alpha = np.zeros((len(some), BULK_CHARS + 1, len(self.rows)))
            alpha[:, 0] = 1.0
            cut = np.searchsorted(start, np.arange(BULK_CHARS + 1))
            for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                # Pieces that start at one place of a word end at different ones.
                alpha[word[a:b], end[a:b]] += alpha[word[a:b], i] * self.columns[piece[a:b]]
            out[some] = np.log(alpha[np.arange(len(some)), [len(w) for w in marked]])
        for i in set(range(len(found))).difference(short):
            lattice = self.pieces.lattice(MARK + found[i])
            out[i] = [forward(lattice, t) for t in self.rows]
        return out

    def texts(self, given: list[str]) -> np.ndarray:
        """One row for each text."""
        split = [words(t) for t in given]
        distinct = set().union(*split)
        new = list(distinct.difference(self.at))
        if self.used + len(new) > self.cache_words:
            self.at.clear()
            self.used, new = 0, list(distinct)
        if self.used + len(new) > len(self.logs):
            self.logs = np.concatenate([self.logs[: self.used], np.zeros((max(len(new), self.used), self.logs.shape[1]))])
        self.logs[self.used : self.used + len(new)] = self.words(new)
        self.at.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)
        get, out = self.at.__getitem__, np.zeros((len(given), len(self.rows)))
        for i, found in enumerate(split):
            if found:
                out[i] = self.logs[list(map(get, found))].sum(0)
        for w in [w for w in new if len(w) > CACHE_CHARS]:
            del self.at[w]
        return out


def predict(df: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``df`` with (by default) ``lang_pred`` and ``score``, the posterior of that language."""
    keep = [c for c in df.columns if c not in into]
    letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))

    def start():
        scorer = Scorer(model) if model.languages else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            has = [i for i, x in enumerate(batch.column(1).to_pylist()) if x and scorer is not None]
            names, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            if has:
                for i, z in zip(has, scorer.texts(batch.column(0).take(pa.array(has)).to_pylist()) + model.prior, strict=True):
                    best = int(z.argmax())
                    names[i], scores[i] = model.languages[best], float(1 / np.exp(z - z[best]).sum())
            return pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, *into])

        return step

    kinds = ", ".join([*([quoted(df, *keep)] if keep else []), f"`{into[0]}` string, `{into[1]}` double"])
    held = fresh(df, "_text", "_letter")
    return map_slices(df.select(F.col(f"`{text}`").alias(held[0]), letter.alias(held[1]), *[f"`{k}`" for k in keep]), start, kinds)
