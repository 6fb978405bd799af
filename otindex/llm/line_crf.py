"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its score comes from features of the line and of the lines beside it, and
neighbouring labels are tied by transition weights. The forward-backward recursion gives each line's
marginal probability; their mean, weighted by line length, is the quality of the document. With two
states both recursions need one number per line (a log-odds), so a task advances all documents of a
megabyte of text together, line by line.

The weights are fitted by maximum likelihood on a bounded sample of labelled documents
(``Fit.documents``, in hash order; documents of more than ``Fit.lines`` lines are not used to fit),
each line carrying its document's label. Scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otindex.llm.bytes_ import as_bytes, mixed, pieces, spans, window_hashes, word_hashes
from otindex.llm.columns import quoted, set_aside

_WHITE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&<>"))
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])

#: Features of a line itself; the ones in _SHARED are also taken from the lines before and after.
OWN = (
    "log_words", "word_length", "symbols", "bars", "shouts", "upper", "digits", "echoes", "distinct", "repeats",
    "seen_before", "full_stop", "non_ascii", "any_symbol", "any_bar", "any_shout", "any_echo",
)
_SHARED = ("symbols", "bars", "shouts", "upper", "echoes", "repeats", "seen_before")
NAMES = ("bias", "first", *OWN, *(f"before_{n}" for n in _SHARED), *(f"after_{n}" for n in _SHARED))


def line_features(texts: list[bytes], window: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x NAMES), lengths in bytes, and the number of lines of each text.

    Lines without a word are left out; a text without words is one line of length zero.
    """
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    line_end = np.flatnonzero(data == 10)
    starts, ends = spans(~_WHITE[data])
    line_of = np.searchsorted(line_end, starts)
    words_in = np.bincount(line_of, minlength=len(line_end))
    text_of_line = np.searchsorted(text_end, line_end, "right")
    kept = words_in > 0
    has_words = np.zeros(n, bool)
    has_words[text_of_line[kept]] = True
    lines = np.bincount(text_of_line[kept], minlength=n)
    last_of_text = np.searchsorted(line_end, text_end - 1)
    kept[last_of_text[~has_words]] = True  # the one empty line of a text without words
    lines[~has_words] = 1

    where = np.flatnonzero(kept)
    new = np.cumsum(kept) - 1  # number among the kept lines
    of = new[line_of]
    m = len(where)
    left = np.concatenate(([0], line_end[:-1] + 1))[where]
    right = line_end[where]
    words = np.maximum(words_in[where], 1)
    text_of = text_of_line[where]

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[right] - total[left]

    size = per_line(~_WHITE[data])
    letters, length = np.maximum(per_line(_LETTER[data]), 1), np.maximum(size, 1)
    symbols, bars, shouts = (per_line(f) for f in (_SYMBOL[data], data == ord("|"), data == ord("!")))

    hashes = word_hashes(data, starts, ends)
    text_of_word = text_of[of] if len(of) else of
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (text_of_word[1:] == text_of_word[:-1])
    echoes = np.bincount(of[echo], minlength=m)
    _, seen = np.unique(hashes ^ mixed(of.astype(np.uint64)), return_index=True)
    distinct = np.bincount(of[seen], minlength=m)

    salt = mixed(np.arange(1, n + 1, dtype=np.uint64))
    windows = window_hashes(hashes, window)
    inside = np.flatnonzero(text_of_word[: len(windows)] == text_of_word[window - 1 :]) if len(windows) else np.empty(0, int)
    _, which, counts = np.unique(windows[inside] ^ salt[text_of_word[inside]], return_inverse=True, return_counts=True)
    change = np.zeros(len(hashes) + 1, np.int64)
    twice = inside[counts[which] > 1]
    np.add.at(change, twice, 1)
    np.add.at(change, twice + window, -1)
    repeats = np.bincount(of[np.cumsum(change[:-1]) > 0], minlength=m)

    whole = word_hashes(data, left, right) if m else np.empty(0, np.uint64)
    _, earliest = np.unique(whole ^ salt[text_of], return_index=True)
    before = np.ones(m, bool)
    before[earliest] = False

    own = np.stack(
        [
            np.log1p(words_in[where]) / 5, np.minimum(size / words, 20) / 10, np.minimum(symbols / words, 3),
            np.minimum(bars / words, 1), np.minimum(shouts / words, 2), per_line(_UPPER[data]) / letters,
            per_line(_DIGIT[data]) / length, echoes / words, distinct / words, repeats / words, before.astype(float),
            data[np.maximum(right - 1, 0)] == ord("."), per_line(data >= 128) / length,
            symbols > 1, bars > 1, shouts > 2, echoes > 2,
        ],
        axis=1,
    ).astype(np.float32)
    at = [OWN.index(name) for name in _SHARED]
    above, below = np.zeros((2, m, len(at)), np.float32)
    joined = text_of[1:] == text_of[:-1]
    above[1:][joined] = own[:-1][joined][:, at]
    below[:-1][joined] = own[1:][joined][:, at]
    first = np.ones(m, np.float32)
    first[1:] = ~joined
    features = np.concatenate([np.ones((m, 1), np.float32), first[:, None], own, above, below], axis=1)
    return features, size, lines


class Chains:
    """The lines of many texts, laid out so that all texts advance together."""

    def __init__(self, lines: np.ndarray):
        self.order = np.argsort(-lines, kind="stable")
        self.first = (np.cumsum(lines) - lines)[self.order]
        sorted_lines = lines[self.order]
        self.active = [int(np.searchsorted(-sorted_lines, -t)) for t in range(int(lines.max(initial=0)))]
        self.total = int(lines.sum())

    def odds(self, emission: np.ndarray, t01: float, t10: float, t11: float) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of good from the lines up to each line, and from the lines after it."""
        forward, backward = np.empty(self.total), np.zeros(self.total)
        for t, count in enumerate(self.active):
            at = self.first[:count] + t
            if t:
                r = forward[at - 1]
                forward[at] = emission[at] + np.logaddexp(r + t11, t01) - np.logaddexp(r + t10, 0.0)
            else:
                forward[at] = emission[at]
        for t in range(len(self.active) - 2, -1, -1):
            at = self.first[: self.active[t + 1]] + t
            r = emission[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(r + t11, t10) - np.logaddexp(r + t01, 0.0)
        return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def marginals(features: np.ndarray, lines: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probability of good for each line. The last three weights are the transitions 01, 10 and 11."""
    emission = features @ weights[:-3]
    forward, backward = Chains(lines).odds(emission, *weights[-3:])
    return _sigmoid(forward + backward)


def loss_and_slope(
    weights: np.ndarray, features: np.ndarray, lines: np.ndarray, good: np.ndarray, chains: Chains, ridge: float
) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the line labels ``good`` with a ridge, and its gradient."""
    t01, t10, t11 = weights[-3:]
    emission = features @ weights[:-3]
    forward, backward = chains.odds(emission, t01, t10, t11)
    p = _sigmoid(forward + backward)
    slope = np.empty_like(weights)
    slope[:-3] = features.T @ (p - good)

    ends = np.cumsum(lines) - 1
    follows = np.ones(len(emission), bool)
    follows[ends - lines + 1] = False
    after = np.flatnonzero(follows)
    r, s = forward[after - 1], emission[after] + backward[after]
    four = np.stack([np.zeros_like(r), s + t01, r + t10, r + s + t11])
    norm = np.logaddexp.reduce(four, axis=0)
    expected = np.exp(four - norm).sum(axis=1)[1:]
    a, b = good[after - 1], good[after]
    seen = np.array([((1 - a) * b).sum(), (a * (1 - b)).sum(), (a * b).sum()])
    slope[-3:] = expected - seen

    # log Z by the chain rule: p(first line) times p(next | line before), from the pair marginals.
    heads = np.flatnonzero(~follows)
    log_p = np.where(good[heads] > 0, np.log(np.maximum(p[heads], 1e-300)), np.log(np.maximum(1 - p[heads], 1e-300))).sum()
    pair = four[(2 * a + b).astype(int), np.arange(len(after))] - norm
    before = np.where(a > 0, np.logaddexp(four[2], four[3]), np.logaddexp(four[0], four[1])) - norm
    log_p += (pair - before).sum()
    return float(-log_p + 0.5 * ridge * (weights @ weights)), slope + ridge * weights


def minimize(f, x: np.ndarray, steps: int, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking; ``f`` gives value and gradient."""
    value, slope = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = slope.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (y @ s)
            kept.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(slope)))
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - y @ q / (y @ s))
        if slope @ q <= 0:
            q, pairs = slope / max(1.0, float(np.linalg.norm(slope))), []
        size = 1.0
        while True:
            there = x - size * q
            new, new_slope = f(there)
            if np.isfinite(new) and new <= value - 1e-4 * size * (slope @ q):
                break
            size /= 2
            if size < 1e-8:
                return x
        s, y = there - x, new_slope - slope
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = value - new < tolerance * max(1.0, abs(value)) * 1e-1
        x, value, slope = there, new, new_slope
        if done:
            break
    return x


@dataclass(frozen=True)
class Fit:
    """How the weights are fitted; ``documents`` and ``lines`` bound the sample on the driver."""

    documents: int = 4_000
    lines: int = 256
    steps: int = 80
    ridge: float = 1.0


def fit(documents: DataFrame, labels: DataFrame, how: Fit | None = None) -> np.ndarray:
    """The weights of NAMES and of the three transitions.

    Labels are (doc_id, quality); null ids and labels do not count, of several labels of a document
    the lowest does. Without labels all weights are zero and every score is 0.5.
    """
    how = how or Fit()
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(how.documents)
    )

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                x, _, lines = line_features(as_bytes(piece.column("text")).to_pylist())
                ends = np.cumsum(lines)
                few = [x[e - k : e].tobytes() if k <= how.lines else None for e, k in zip(ends, lines, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("quality"), pa.array(few, pa.binary())],
                    ["doc_id", "quality", "x"],
                )

    rows = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(sample.select("doc_id", F.col("quality").cast("int").alias("quality"))), "doc_id")
        .select("doc_id", "quality", "text")
        .mapInArrow(run, "doc_id bigint, quality int, x binary")
        .where("x is not null")
        .groupBy("doc_id", "quality")
        .agg(F.min("x").alias("x"))
        .orderBy("doc_id")
        .collect()
    )
    weights = np.zeros(len(NAMES) + 3)
    if not rows:
        return weights
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, len(NAMES)) for r in rows]
    lines = np.array([len(p) for p in parts])
    features = np.concatenate(parts).astype(float)
    good = np.repeat([float(r["quality"] > 0) for r in rows], lines)
    chains = Chains(lines)
    return minimize(lambda w: loss_and_slope(w, features, lines, good, chains, how.ridge), weights, how.steps)


ADDED = ("score", "predicted")


def classify(
    documents: DataFrame, weights: np.ndarray, least: float = 0.3, keep_text: bool = True
) -> DataFrame:
    """``documents`` with score (0 to 1, higher is better) and predicted (1 from ``least`` on).

    One row per row. A null text, or one without words, is a single empty line. Columns named like
    the added ones are replaced. ``keep_text=False`` leaves the text out of the result.
    """
    documents, back = set_aside(documents, ())
    carried = [c for c in documents.columns if c.lower() not in ADDED and (keep_text or c != "text")]

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                x, size, lines = line_features(as_bytes(piece.column("text")).to_pylist())
                p = marginals(x, lines, weights)
                text = np.repeat(np.arange(len(lines)), lines)
                weight = size + 1.0
                score = np.bincount(text, p * weight, len(lines)) / np.bincount(text, weight, len(lines))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in carried), pa.array(score)], [*carried, "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*map(quoted, carried)).schema]
    scored = documents.select(*map(quoted, dict.fromkeys([*carried, "text"]))).mapInArrow(run, ", ".join([*fields, "score double"]))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int")).withColumnsRenamed(back)


def accepted(documents: DataFrame, weights: np.ndarray, least: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, in their own columns."""
    kept, back = set_aside(documents, ADDED)
    good = classify(kept, weights, least).where("predicted = 1").select(*map(quoted, kept.columns))
    return good.withColumnsRenamed(back).select(*map(quoted, documents.columns))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """The labels outside of the held-out fifth."""
    return labels.where(~held_out(F.col("doc_id")))
