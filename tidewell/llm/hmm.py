"""A hidden Markov language model.

Tokens are the words of a text (A-Z in lower case) and one end.  Latent states
emit symbols: up to ``WORDS`` of the most frequent words of the training texts, the end,
and ``CLASSES`` classes (by their last bytes) for all other words.  Within a class a
word has its smoothed relative frequency, one share being kept for all words
that weren't seen.  So every text has one exact probability: the forward
recursion's, times those of its words within their classes.

Counts of all training words are summed by Spark and written as a table.  The
texts are encoded once, written, and each round of Baum-Welch is one pass over
the written symbols: tasks add up expected counts of their sequences by scaled
forward and backward recursions, Spark sums them by symbol, and the driver gets
one row for each symbol, a number that doesn't depend on the corpus.  Fewer than
``KNOWN`` words, all above a least count, are known to every task; other words meet
their counts in a join; none of them
can be in more than a ``KNOWN``-th part of all tokens, so no key is hot.

Defined cases: a null or empty text is its end alone; a null key counts as the
empty text where rows are split; repeated rows are counted and scored each; equal
counts are ranked by the word's bytes; without training texts all counts are 0
and the formulas hold as they are; an empty table gives an empty table; texts of any
length are scored whole; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SLICE_ROWS, Workspace, texts

STATES, ROUNDS, WORDS, KNOWN, CLASSES, SUFFIX, SEED = 8, 4, 1 << 14, 1 << 16, 512, 3, 5
FLUSH_WORDS, FLUSH_CHARS, BATCH_TOKENS = 250_000, 1 << 26, 400_000
#: Learning (not scoring) takes longer texts as several sequences.
LEARN_TOKENS = 1 << 16
#: Counts up to it stand for themselves in the histogram, greater ones share a bin with those at most 1.6 % apart.
PLAIN_COUNTS, BINS = 1024, 64
END = b""


def tokens(text: str) -> list[bytes]:
    """Words between the bytes 32 and 9 to 13, A-Z in lower case, and the end."""
    return [*text.encode().lower().split(), END]


@dataclass(frozen=True)
class Sizes:
    """Words with a symbol of their own, words whose counts every task holds, classes of the other words, words counted at a time."""

    words: int = WORDS
    known: int = KNOWN
    classes: int = CLASSES
    flush: int = FLUSH_WORDS

    def word_class(self, word: bytes) -> int:
        return zlib.crc32(word[-SUFFIX:]) % self.classes


def count_tokens(df: DataFrame, text: str, flush: int = FLUSH_WORDS) -> DataFrame:
    """(word, c) of all texts; summed in each task before the shuffle, with a bounded number of words held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Counter(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for t in texts(batch.column(0).slice(at, SLICE_ROWS)):
                    held.update(tokens(t))
                    size += len(t)
                    if len(held) > flush or size > FLUSH_CHARS:
                        yield out()
                        held.clear()
                        size = 0
        if held:
            yield out()

    return df.select(text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    total: int  # N
    distinct: int  # V
    known: dict[bytes, int]  # word to its rank; the end has rank 0
    base: np.ndarray  # log10 of the smoothed share of each rank
    within: np.ndarray  # log10 of its share within its class, 0 for symbols of their own
    symbol: np.ndarray  # symbol of each rank
    room: np.ndarray  # log10 of what a class's counts are divided by
    frequency: np.ndarray  # tokens of each symbol
    sizes: Sizes = Sizes()

    @property
    def rare(self) -> float:
        """log10 of what all counts are divided by."""
        return float(np.log10(self.total + self.distinct + 1))


def vocabulary(counts: DataFrame, sizes: Sizes = Sizes()) -> Vocabulary:
    """From the written counts: the most frequent words, and sums over all others by class."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = counts.filter(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    # The least count whose words, with all more frequent ones, are few enough: from a histogram of a few thousand bins.
    bin_ = F.when(F.col("c") <= PLAIN_COUNTS, F.col("c")).otherwise(PLAIN_COUNTS + 1 + F.floor(F.log(F.col("c") / F.lit(float(PLAIN_COUNTS))) * BINS)).cast("long")
    others = counts.filter(F.length("word") > 0)
    bins = others.groupBy(bin_.alias("b")).agg(F.count("*").alias("k")).toPandas().sort_values("b", ascending=False)
    kept = bins["b"][bins["k"].cumsum() < sizes.known]
    top = others.filter(bin_ >= int(kept.min())).toPandas() if len(kept) else others.limit(0).toPandas()  # fewer rows than known
    ranked = sorted(zip(map(bytes, top["word"]), top["c"].tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    words, c = [END, *(w for w, _ in ranked)], np.array([end, *(k for _, k in ranked)], np.int64)
    own = min(sizes.words, len(words))
    suffix = F.crc32(F.expr(f"substring(word, -{SUFFIX}, {SUFFIX})")) % sizes.classes
    by = counts.groupBy(suffix.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
    sums, kinds = np.zeros(sizes.classes, np.int64), np.zeros(sizes.classes, np.int64)
    sums[by["k"].to_numpy(np.int64)], kinds[by["k"].to_numpy(np.int64)] = by["n"], by["v"]
    klass = np.array([sizes.word_class(w) for w in words])
    seen = (c > 0)[:own]
    sums -= np.bincount(klass[:own], c[:own], sizes.classes).astype(np.int64)
    kinds -= np.bincount(klass[:own], seen, sizes.classes).astype(np.int64)
    room = np.log10(sums + kinds + 1.0)
    logs = np.log10(c + 1.0)
    rank = np.arange(len(words))
    symbol = np.where(rank < own, rank, sizes.words + klass)
    frequency = np.zeros(sizes.words + sizes.classes)
    frequency[:own], frequency[sizes.words:] = c[:own], sums
    return Vocabulary(int(n), int(v), {w: i for i, w in enumerate(words)}, logs - np.log10(n + v + 1.0), np.where(rank < own, 0.0, logs - room[klass]), symbol, room, frequency, sizes)


def encode(df: DataFrame, words: Vocabulary, text: str, *keep: str) -> DataFrame:
    """``keep``, the symbols, sums over the known words, and the other words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = words.known.get, np.append(words.base > -words.rare + 1e-12, False)
        base, within, symbol = np.append(words.base, -words.rare), np.append(words.within, 0.0), np.append(words.symbol, 0)
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part, rows = batch.slice(at, SLICE_ROWS), []
                for t in texts(part.column(0)):
                    found = tokens(t)
                    r = np.array([rank(w, -1) for w in found])
                    s, other = symbol[r], np.flatnonzero(r < 0).tolist()
                    inside = float(within[r].sum())
                    if other:
                        rare = [found[i] for i in other]
                        klass = np.array([words.sizes.word_class(w) for w in rare])
                        s[other] = words.sizes.words + klass
                        inside -= float(words.room[klass].sum())
                        rare = [{"word": w, "n": n} for w, n in Counter(rare).items()]
                    rows.append((s.astype("<u2").tobytes(), len(found), int(seen[r].sum()), float(base[r].sum()), inside, rare if other else []))
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), kind), strict=True)] if rows else []
                if rows:
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], [*keep, "symbols", "n_tokens", "n_known", "base", "within", "rare"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(text, *keep).mapInArrow(run, f"{kinds}, symbols binary, n_tokens long, n_known long, base double, within double, rare array<struct<word: binary, n: long>>")


# ---- recursions over many sequences at once


@dataclass
class Model:
    start: np.ndarray  # (STATES,)
    move: np.ndarray  # (STATES, STATES)
    emit: np.ndarray  # (symbols, STATES); each column sums to 1


def batches_of(sequences: list[np.ndarray], most: int = BATCH_TOKENS) -> Iterator[np.ndarray]:
    """Places of the sequences, longest first, in groups of about ``most`` symbols."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    group, held = [], 0
    for i in order:
        group.append(i)
        held += len(sequences[i])
        if held >= most:
            yield np.array(group)
            group, held = [], 0
    if group:
        yield np.array(group)


class Lattice:
    """Sequences (longest first, none empty) laid out by time: at time t the first ``active[t]`` still run."""

    def __init__(self, sequences: list[np.ndarray]):
        length = np.array([len(s) for s in sequences])
        self.active = len(length) - np.searchsorted(np.sort(length), np.arange(length[0]), side="right")
        self.at = np.append(0, np.cumsum(self.active))
        flat = np.concatenate(sequences).astype(np.int64)
        who, when = np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        self.place = self.at[when] + who
        self.symbol = np.empty(len(flat), np.int64)
        self.symbol[self.place] = flat
        self.who = who

    def forward(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scaled alphas, scales, emissions), by place."""
        emit = m.emit[self.symbol]
        alpha, scale = np.empty_like(emit), np.empty(len(emit))
        row = m.start[None, :]
        for t, n in enumerate(self.active.tolist()):
            a, b = self.at[t], self.at[t] + n
            x = (row if t == 0 else row[:n] @ m.move) * emit[a:b]
            s = x.sum(1)
            x /= s[:, None]
            alpha[a:b], scale[a:b], row = x, s, x
        return alpha, scale, emit

    def log_likelihood(self, m: Model) -> np.ndarray:
        """Natural logarithm of each sequence's probability; only the last alphas are held."""
        out, row = np.zeros(self.active[0]), m.start[None, :]
        for t, n in enumerate(self.active.tolist()):
            x = (row if t == 0 else row[:n] @ m.move) * m.emit[self.symbol[self.at[t] : self.at[t] + n]]
            s = x.sum(1)
            out[:n] += np.log(s)
            row = x / s[:, None]
        return out

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(start, move, emission counts, log likelihood) of all sequences."""
        alpha, scale, emit = self.forward(m)
        beta, later = np.ones_like(alpha), np.zeros_like(alpha)
        for t in range(len(self.active) - 2, -1, -1):
            n, a, b = self.active[t + 1], self.at[t], self.at[t + 1]
            z = emit[b : b + n] * beta[b : b + n] / scale[b : b + n, None]
            later[b : b + n] = z
            beta[a : a + n] = z @ m.move.T
        t = np.repeat(np.arange(len(self.active)), self.active)
        back = np.arange(len(t)) - self.at[t] + self.at[np.maximum(t - 1, 0)]
        first = self.active[0]
        move = (alpha[back[first:]].T @ later[first:]) * m.move
        gamma = alpha * beta
        counts = np.stack([np.bincount(self.symbol, gamma[:, k], len(m.emit)) for k in range(gamma.shape[1])], 1)
        return gamma[:first].sum(0), move, counts, float(np.log(scale).sum())


def first_model(words: Vocabulary, states: int = STATES, seed: int = SEED) -> Model:
    """States that tend to stay, each with its own random slant on the words' frequencies."""
    rng = np.random.default_rng(seed)
    emit = (words.frequency[:, None] + 0.1) * np.exp(rng.normal(0, 1, (len(words.frequency), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def sequences_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


def baum_welch_round(encoded: DataFrame, m: Model, words: Vocabulary) -> Model:
    """One round over the written sequences."""
    states = len(m.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(m.emit)
        for batch in batches:
            found = [x[i : i + LEARN_TOKENS] for x in sequences_of(batch.column(0)) for i in range(0, len(x), LEARN_TOKENS)]
            for group in batches_of(found):
                s, a, e, _ = Lattice([found[i] for i in group]).expected(m)
                start, move, emit = start + s, move + a, emit + e
        some = np.flatnonzero(emit.any(1))
        rows = np.concatenate([start[None], move, emit[some]])
        at = np.concatenate([np.arange(-1 - states, 0), some])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(states))], ["s", *(f"e{k}" for k in range(states))])

    names = [f"e{k}" for k in range(states)]
    summed = encoded.select("symbols").mapInArrow(run, ", ".join(["s long", *(f"{x} double" for x in names)])).groupBy("s").agg(*[F.sum(x).alias(x) for x in names]).toPandas().sort_values("s")
    at, rows = summed["s"].to_numpy(), summed[names].to_numpy()
    if not len(at):
        return m
    head = {int(i): r for i, r in zip(at[at < 0], rows[at < 0], strict=True)}
    emit = np.repeat(((words.frequency + 1) / (words.frequency + 1).sum())[:, None], states, 1)  # one token's worth of the plain frequencies
    emit[at[at >= 0]] += rows[at >= 0]
    move = np.stack([head[i] for i in range(-states, 0)]) + 1 / states
    start = head[-1 - states] + 1 / states
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def likelihood(encoded: DataFrame, m: Model, *keep: str) -> DataFrame:
    """``keep`` and ``log10`` of each sequence of symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sequences_of(batch.column(0))
            out = np.zeros(len(found))
            for group in batches_of(found):
                out[group] = Lattice([found[i] for i in group]).log_likelihood(m) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], [*keep, "log10"])

    kinds = ", ".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keep)
    return encoded.select("symbols", *keep).mapInArrow(run, f"{kinds}, log10 double")


def score(df: DataFrame, work: Workspace, learn: Column, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, sizes: Sizes = Sizes()) -> DataFrame:
    """key, learned (``learn`` of the row), n_tokens, n_known, train_tokens, base_score and score of each text."""
    rows = df.select(key, text, learn.alias("learned"))
    counts = work.write(count_tokens(rows.filter("learned"), text, sizes.flush), "counts")
    words = vocabulary(counts, sizes)
    encoded = work.write(encode(rows, words, text, key, "learned").withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = first_model(words)
    for _ in range(rounds):
        model = baum_welch_round(encoded.filter("learned"), model, words)
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    sums = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum("n").alias("seen")).withColumnRenamed("row", "r")
    scored = likelihood(encoded, model, "row", key, "learned", "n_tokens", "n_known", "base", "within")
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(sums, F.col("row") == F.col("r"), "left").select(
        key,
        "learned",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("log10") + F.col("within") + logs).alias("score"),
    )
