"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a run of at least ``CANDIDATE_CHARS`` characters of the token
alphabet that holds a digit.  The network (numpy) sees the characters of the
candidate and of its surrounding context: embedded character classes, a
convolution, the maximum over the candidate and the maximum over the context,
and a linear layer.  It is trained on labelled findings; a held-out part of them
calibrates its scores (Platt) and sets the threshold, the highest that still
recalls ``RECALL`` of the held-out secrets.

Patterns' spans always stay; the network adds candidates that no pattern touches and,
of runs that one touches, the parts outside it from ``PART_CHARS`` characters on.  A
candidate longer than the inner part of a window is seen by its two ends and by
overlapping windows over all of it, and the highest score counts.

Defined cases: null and empty texts have no spans; null keys are kept; repeated
rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import map_slices, texts

#: Kinds in the order in which equal starts are listed, with the least length of the whole match (assign: of its second group).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{32}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "model")

CANDIDATE_CHARS = 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.~@-])[A-Za-z0-9+/_=.~@-]{16,}+")
RUN = re.compile(r"[A-Za-z0-9+/_=.~@-]+")
DIGIT = re.compile(r"[0-9]")
#: Least length of what is left of a run beside a pattern's span.
PART_CHARS = 4
CONTEXT, INNER = 24, 48
RECALL, FINDINGS, SEED = 0.99, 6000, 7


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, by start and then kind; leftmost, without overlaps within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if HEX_RUN.search(text):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    if not DIGIT.search(text):
        return []
    return [(m.start(), m.end()) for m in CANDIDATE.finditer(text) if DIGIT.search(m[0])]


def outside(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The candidates that ``base`` (sorted spans) doesn't touch, and the parts outside it of the runs that it touches."""
    if not base:
        return candidates(text)
    covered: list[list[int]] = []
    for a, b, _ in base:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    out, k = [], 0
    for m in RUN.finditer(text):
        (a, b), at, touched = m.span(), m.start(), False
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        j = k
        while j < len(covered) and covered[j][0] < b:
            touched = True
            if covered[j][0] - at >= PART_CHARS:
                out.append((at, covered[j][0]))
            at, j = covered[j][1], j + 1
        if b - at >= (PART_CHARS if touched else CANDIDATE_CHARS) and (touched or DIGIT.search(m[0])):
            out.append((at, b))
    return out


# ---- the network


def _classes() -> np.ndarray:
    """Class of each code point below 128; 0 is padding, 1 everything else."""
    out = np.ones(128, np.uint8)
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.~@-:;\"'<>()[]{}, \n#&?!%$*|"):
        out[ord(c)] = k + 2
    return out


CLASS = _classes()
CLASSES = int(CLASS.max()) + 1
TAPS, FILTERS = 5, 24
WIDTH = 2 * CONTEXT + INNER


def window(text: str, start: int, end: int, length: int = 0) -> np.ndarray:
    """Classes of the context before, of the candidate's first and last characters, and of the context after.

    A candidate longer than the inner part is shown by its two ends.  Last comes the candidate's true length,
    ``length`` if the window only shows a part of it.
    """
    before, after, inner = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT], text[start:end]
    if len(inner) > INNER:
        inner = inner[: INNER // 2] + inner[-INNER // 2 :]
    out = np.zeros(WIDTH + 1, np.uint16)
    out[WIDTH] = min(length or end - start, 65535)
    for at, part in ((CONTEXT - len(before), before), (CONTEXT, inner), (CONTEXT + INNER, after)):
        codes = np.frombuffer(part.encode("utf-32-le", "replace"), "<u4")
        out[at : at + len(codes)] = np.where(codes < 128, CLASS[np.minimum(codes, 127)], 1)
    return out


def views(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """What the windows of a candidate show: all of it (of a long one, the two ends), and overlapping parts of a long one."""
    if end - start <= INNER:
        return [(start, end)]
    return [(start, end), *((a, a + INNER) for a in range(start, end - INNER, INNER // 2)), (end - INNER, end)]


@dataclass
class Network:
    taps: np.ndarray  # (TAPS, CLASSES, FILTERS)
    bias: np.ndarray
    weight: np.ndarray  # (2 * FILTERS + 2,)
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, positions of the maxima) of windows ``x``."""
        n = WIDTH - TAPS + 1
        h = np.broadcast_to(self.bias, (len(x), n, FILTERS)).copy()
        for k in range(TAPS):
            h += self.taps[k][x[:, k : k + n]]
        inner = np.zeros(n, bool)
        inner[CONTEXT - TAPS // 2 : CONTEXT + INNER - TAPS // 2] = True
        a, b = h[:, inner].argmax(1) + CONTEXT - TAPS // 2, np.flatnonzero(~inner)[h[:, ~inner].argmax(1)]
        at = np.concatenate([a, b], 1)
        top = np.maximum(np.take_along_axis(h, at.reshape(len(x), 2, FILTERS), 1).reshape(len(x), -1), 0)
        length = np.log1p(x[:, WIDTH:]) / np.log1p(INNER)
        return np.concatenate([top, length, np.ones((len(x), 1))], 1), at

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        out = np.empty(len(x))
        for at in range(0, len(x), 1024):
            z = self.pooled(x[at : at + 1024])[0] @ self.weight
            out[at : at + 1024] = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -60, 60)))
        return out


def train(windows: np.ndarray, labels: np.ndarray, epochs: int = 6, seed: int = SEED, recall: float = RECALL) -> Network:
    """Fit on four fifths of the labelled windows; calibrate and set the threshold on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(windows))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    net = Network(rng.normal(0, 0.2, (TAPS, CLASSES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS + 2))
    params = [net.taps, net.bias, net.weight]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            x, y = windows[batch], labels[batch]
            f, at = net.pooled(x)
            d = (1 / (1 + np.exp(-np.clip(f @ net.weight, -60, 60))) - y) / len(y)
            back = d[:, None] * net.weight[: 2 * FILTERS] * (f[:, : 2 * FILTERS] > 0)
            taps, filters = np.zeros_like(net.taps), np.tile(np.arange(FILTERS), 2)
            for k in range(TAPS):
                np.add.at(taps[k], (np.take_along_axis(x, at + k, 1), np.broadcast_to(filters, at.shape)), back)
            grads = [taps, back.sum(0).reshape(2, FILTERS).sum(0), f.T @ d + 1e-4 * net.weight]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z, y = np.concatenate([net.pooled(windows[i])[0] @ net.weight for i in np.array_split(held, max(1, len(held) // 1024))]), labels[held]
    # Platt scaling: Newton's method on scale and shift, with targets a little inside 0 and 1.
    yes, no = y.sum(), len(y) - y.sum()
    target, design, at = np.where(y == 1, (yes + 1) / (yes + 2), 1 / (no + 2)), np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -60, 60)))
        at -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (p - target) + 1e-3 * (at - [1, 0]))
    net.scale, net.shift = float(at[0]), float(at[1])
    secret = np.sort(net.scores(windows[held][y == 1]))
    if len(secret):
        net.threshold = float(secret[int(np.floor((1 - recall) * len(secret)))])
    return net


# ---- labelled findings


def findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, 1 for a secret) of ``n`` labelled findings: credentials of common shapes, and what is mistaken for them."""
    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda alphabet, a, b: "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))
    word = lambda a=2, b=9: some("etaoinshrdlucmfwypvbgk", a, b)
    ip = lambda: ".".join(str(r.randint(10, 255)) for _ in range(4))
    host = lambda: f"{word()}{r.choice(['', some(dig, 1, 2)])}.{word()}.{r.choice(['com', 'org', 'net', 'io'])}"
    secret = (
        lambda: "ghp_" + some(low + up + dig, 36, 36),
        lambda: "sk_live_" + some(low + up + dig, 24, 32),
        lambda: "xoxb-" + some(dig, 10, 12) + "-" + some(low + up + dig, 20, 26),
        lambda: "eyJ" + some(low + up + dig + "_-", 20, 60) + "." + some(low + up + dig + "_-", 20, 60),
        lambda: some(low + up + dig + "+/", 28, 64) + r.choice(["", "=", "=="]),
        lambda: some("abcdef" + dig, 24, 31),
        lambda: some(low + up + dig, 20, 44),
        lambda: some(up + dig, 20, 32),
        lambda: "AIza" + some(low + up + dig + "_-", 35, 35),
    )
    plain = (
        lambda: f"{word()}.{some(dig, 1, 4)}@{host()}",
        lambda: some(dig, 16, 19),
        lambda: some(dig, 4, 6) + "-" + some(dig, 4, 6) + "-" + some(dig, 6, 8),
        ip,
        lambda: "www." + host() + "/" + word() + "/" + word() + some(dig, 1, 4),
        lambda: "/" + "/".join(word() for _ in range(r.randint(3, 6))) + some(dig, 1, 3) + ".txt",
        lambda: f"20{some(dig, 2, 2)}-{some(dig, 2, 2)}-{some(dig, 2, 2)}T{some(dig, 2, 2)}.{some(dig, 2, 2)}.{some(dig, 2, 2)}",
        lambda: "-".join(word() for _ in range(3)) + "-" + some(dig, 1, 4),
        lambda: word(8, 14) + "_" + word(8, 14) + some(dig, 1, 2),
        lambda: "=" * r.randint(14, 40) + some(dig, 1, 2),
        lambda: word(16, 26) + some(dig, 1, 2),
        lambda: "v" + ".".join(some(dig, 1, 3) for _ in range(6)) + "-" + word(6, 8),
    )
    named = ("key ", "credential ", "auth ", "bearer ", "secret is ", "pwd ", 'key: "', "Authorization ")
    out = []
    for i in range(n):
        value = r.choice(secret if i % 2 else plain)()
        before = " ".join(word() for _ in range(r.randint(0, 5))) + " " + (r.choice(named) if r.random() < (0.3 if i % 2 else 0.05) else "")
        after = r.choice([" ", ". ", '" ', "\n", ", "]) + " ".join(word() for _ in range(r.randint(0, 5)))
        out.append((before + value + after, len(before), len(before) + len(value), i % 2))
    return out


def more_findings(n: int = FINDINGS // 4, seed: int = SEED + 1) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, length, 1 for a secret) of views: parts of runs beside a pattern's span, and windows over long runs."""
    r = random.Random(seed)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = lambda alphabet, a, b: "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))
    word = lambda: some("etaoinshrdlucmfwypvbgk", 2, 9)
    values = [t[a:b] for t, a, b, y in findings(2 * n, seed) if y]
    out = []
    for i in range(n):  # beside a span
        base = r.choice((lambda: r.choice(("password=", "secret: ", "token=", "api_key=")) + some(alnum, 8, 20), lambda: "AKIA" + some(alnum[26:], 16, 16).upper(), lambda: some("abcdef0123456789", 32, 40)))()
        mark = "@" if base[0] not in "A0123456789" and r.random() < 0.5 else r.choice("~@")
        if i % 2:
            part = r.choice((lambda: mark + word().capitalize() + some("0123456789", 1, 4), lambda: mark + some(alnum, 5, 20), lambda: ("/" if base[0] == "A" else "~") + r.choice(values)))()
        else:
            part = r.choice((lambda: f"@{word()}.{r.choice(['com', 'org', 'net', 'io'])}", lambda: f"@{word()}.{word()}.{r.choice(['com', 'org', 'net', 'io'])}", lambda: mark + word(), lambda: "~/" + word() + "/" + word(), lambda: "@" + "-".join(word() for _ in range(2)) + ".txt"))()
        before, after = word() + " ", r.choice([" ", ". ", '" ', "\n", ", "]) + word()
        out.append((before + base + part + after, len(before + base), len(before + base + part), len(part), i % 2))
    for i in range(n // 3):  # over long runs
        sep = r.choice("/./.-_")
        left, right = (sep.join(word() for _ in range(r.randint(6, 20))) + sep for _ in range(2))
        value = r.choice(values) if i % 2 else some("0123456789", 1, 4)
        run = left + value + sep + right[:-1] + some("0123456789", 0, 2)
        before = word() + " "
        text = before + run + r.choice([" ", ". ", "\n"]) + word()
        at = len(before + left)
        for a, b in views(text, len(before), len(before) + len(run))[1:]:
            seen = min(b, at + len(value)) - max(a, at)
            if not i % 2 or seen <= 0 or seen >= 16:  # a few characters of a secret are neither
                out.append((text, a, b, len(run), int(i % 2 and seen >= 16)))
    return out


@functools.lru_cache(maxsize=1)
def default_network() -> Network:
    labelled = [(t, *view, b - a, y) for t, a, b, y in findings() for view in views(t, a, b)] + more_findings()
    return train(np.stack([window(t, a, b, n) for t, a, b, n, _ in labelled]), np.array([y for *_, y in labelled], float))


def find(docs: list[str], net: Network) -> list[list[tuple[int, int, int, float]]]:
    """(start, end, kind, score) of the secrets of each text, by start and then kind."""
    spans: list = []
    waiting: list[tuple[int, int, int, int, int]] = []
    best: dict[tuple[int, int, int], float] = {}

    def score() -> None:
        if waiting:
            for (i, a, b, _, _), p in zip(waiting, net.scores(np.stack([window(docs[i], x, y, b - a) for i, a, b, x, y in waiting])).tolist(), strict=True):
                best[i, a, b] = max(p, best.get((i, a, b), 0.0))
            waiting.clear()

    for i, t in enumerate(docs):
        base = base_spans(t)
        spans.append([(a, b, k, 1.0) for a, b, k in base])
        for a, b in outside(t, base):
            for x, y in views(t, a, b):
                waiting.append((i, a, b, x, y))
                if len(waiting) == 1024:
                    score()
    score()
    for (i, a, b), p in best.items():
        if p >= net.threshold:
            spans[i].append((a, b, KINDS.index("model"), p))
    return [sorted(s, key=lambda s: (s[0], s[2])) for s in spans]


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", network: Network | None = None) -> DataFrame:
    """key with spans: array of (kind, start, end in code points, score), by start and then kind.

    Score is 1 for patterns and the network's probability for the candidates that it adds.
    """
    net = network or default_network()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [[{"kind": KINDS[k], "start": a, "end": b, "score": p} for a, b, k, p in spans] for spans in find(texts(batch.column(1)), net)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], [key, "spans"])

        return step

    return map_slices(df.select(key, text), start, f"`{key}` {df.schema[key].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long, score: double>>")


def redact(df: DataFrame, text: str = "text", network: Network | None = None, mark: str = "[secret]") -> DataFrame:
    """All columns of ``df``; in ``text`` every secret is replaced by ``mark`` (overlapping spans by one)."""
    net = network or default_network()
    rest = [c for c in df.columns if c != text]

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = batch.column(0).to_pylist()
            for i, spans in enumerate(find([t or "" for t in out], net)):
                parts, at = [], 0
                for a, b, _, _ in spans:
                    if a >= at:
                        parts += [out[i][at:a], mark]
                    at = max(at, b)
                if spans:
                    out[i] = "".join([*parts, out[i][at:]])
            return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[1:]], [text, *rest])

        return step

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (text, *rest))
    return map_slices(df.select(text, *rest), start, kinds).select(*df.columns)
