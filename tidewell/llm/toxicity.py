"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the character n-grams that occur in its words (letters
only, lower case, with marks at both ends), hashed into ``DIMENSIONS``.  For each
feature r = log of the smoothed share of toxic documents with it over that of
the others; the ones with the most evidence stay (two for each row of
the rarer class, ``FEATURES`` at most), and a logistic
regression learns weights for the presence values scaled by r.

Learning reads a bounded sample: about ``LABELLED`` labelled rows, those whose key's
hash lies in a share of its range.  Only they, reduced to the kept features, reach the
driver.  Scoring is one pass over the texts.

Defined cases: null and empty texts have no features and get the score of the
intercept; rows with a null label or key aren't learned from, and of repeated
labels of a key the largest counts; without labelled rows of both classes every
score is the smoothed share of toxic rows; repeated rows get equal scores; an empty
table gives an empty table.  Other columns pass through, whatever their names; one
called like the result is replaced (``into`` names it).  Texts count whole.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import fresh, map_slices, quoted, texts

LABELLED, DIMENSIONS, FEATURES, GRAMS, ALPHA = 24_000, 1 << 18, 4096, (3, 4, 5, 6), 0.5
#: Words that a worker keeps, of at most ``CACHE_CHARS`` characters.
CACHE_WORDS, CACHE_CHARS = 500_000, 64
WORD = re.compile(r"[^\W\d_]+")


def grams(word: str) -> set[int]:
    data = f"<{word}>"
    return {zlib.crc32(data[i : i + n].encode()) % DIMENSIONS for n in GRAMS for i in range(max(1, len(data) - n + 1))}


class Features:
    """Feature numbers of texts, by a bounded cache of words.  ``kept``: feature to its number, or None for all."""

    def __init__(self, kept: dict[int, int] | None = None):
        self.kept = kept
        self.words: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        if (got := self.words.get(word)) is None:
            got = tuple(grams(word) if self.kept is None else {k for g in grams(word) if (k := self.kept.get(g)) is not None})
            if len(word) > CACHE_CHARS:
                return got
            if len(self.words) >= (CACHE_WORDS if self.kept is not None else CACHE_WORDS // 10):
                self.words.clear()
            self.words[word] = got
        return got

    def text(self, text: str) -> set[int]:
        out: set[int] = set()
        for w in set(WORD.findall(text.lower())):
            if got := self.word(w):
                out.update(got)
        return out


@dataclass
class Model:
    kept: dict[int, int]
    weight: np.ndarray
    intercept: float

    def score(self, found: list[set[int]]) -> np.ndarray:
        z = np.array([self.weight[list(f)].sum() if f else 0.0 for f in found]) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def labelled_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """(text, label) of about ``most`` labelled keys."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("y"))
    share = most / max(1, known.count())
    chosen = known.filter(F.abs(F.xxhash64("k", F.lit(7)) % 1_000_003) / F.lit(1_000_003.0) < share).groupBy("k").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(f"`{key}`").alias("d"), F.col(f"`{text}`").alias("t"))
    return rows.join(F.broadcast(chosen), F.col("d") == F.col("k")).select("t", "y")  # about `most` rows are broadcast


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = LABELLED, steps: int = 120) -> Model:
    rows = labelled_rows(docs, labels, key, text, label, most)

    def count(batches):
        features, by = Features(), np.zeros((2, DIMENSIONS), np.int64)
        seen = np.zeros(2, np.int64)
        for batch in batches:
            for t, y in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                by[int(y > 0), list(features.text(t))] += 1
                seen[int(y > 0)] += 1
        g = np.flatnonzero(by.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(g, -1)), pa.array(np.append(by[0, g], seen[0])), pa.array(np.append(by[1, g], seen[1]))], ["g", "n0", "n1"])

    got = rows.mapInArrow(count, "g long, n0 long, n1 long").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas().to_numpy()
    seen = got[got[:, 0] == -1][:, 1:].sum(0) if len(got) else np.zeros(2, np.int64)
    got = got[got[:, 0] >= 0]
    prior = float(np.log((seen[1] + 0.5) / (seen[0] + 0.5)))
    if not seen.all():
        return Model({}, np.zeros(0), prior)
    got = got[np.argsort(got[:, 0])]
    share = (got[:, 1:] + ALPHA) / (seen + 2 * ALPHA)
    r = np.log(share[:, 1] / share[:, 0])
    # Evidence: how far the share of toxic documents with the feature is from the share without, in standard errors.
    both = (got[:, 1:].sum(1) + 2 * ALPHA) / (seen.sum() + 4 * ALPHA)
    evidence = np.abs(share[:, 1] - share[:, 0]) / np.sqrt(both * (1 - both) * (1 / seen[0] + 1 / seen[1]) + 1e-12)
    best = np.argsort(-evidence, kind="stable")[: min(FEATURES, max(256, 2 * int(seen.min())))]  # few labels don't bear many weights
    kept, r = {int(g): i for i, g in enumerate(got[best, 0])}, r[best]

    def reduce(batches):
        features = Features(kept)
        for batch in batches:
            made = [np.array(sorted(features.text(t)), "<u2").tobytes() for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array([int(y > 0) for y in batch.column(1).to_pylist()], pa.int32())], ["f", "y"])

    table = rows.mapInArrow(reduce, "f binary, y int").toPandas()
    y = table["y"].to_numpy(float)
    index = np.frombuffer(b"".join(table["f"]), "<u2").astype(np.int64)
    doc = np.repeat(np.arange(len(y)), [len(f) // 2 for f in table["f"]])
    w, b = np.full(len(best), 0.05), prior
    values = r[index]
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(doc, w[index] * values, len(y)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        g = np.append(np.bincount(index, d[doc] * values, len(w)) + 1e-5 * w, d.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model(kept, w * r, float(b))


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """All columns of ``df`` and the probability that its label is 1."""
    keep = [c for c in df.columns if c != into]

    def start():
        features = Features(model.kept)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features.text(t) for t in texts(batch.column(0))]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.score(found), pa.float64())], [*keep, into])

        return step

    kinds = ", ".join([*([quoted(df, *keep)] if keep else []), f"`{into}` double"])
    return map_slices(df.select(F.col(f"`{text}`").alias(*fresh(df, "_text")), *[f"`{k}`" for k in keep]), start, kinds)
