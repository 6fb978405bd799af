"""Quality rules: fixed limits on document statistics, then gradient-boosted trees over them.

Statistics are taken from whole texts, about a megabyte at a time in numpy, and written once: they are
a few numbers per document, and both training and scoring start from them. The trees are grown on a
bounded sample of labelled documents (``Training.rows``, in hash order, so it is the same at every
run) by histogram splits with the second-order gain; a feature marked as falling may never raise the
score as it grows: splits that would are not taken, and children are held within the bounds that the
split sets. The forest is flattened into arrays (feature, threshold, left, right, value), and a task
scores a whole batch by stepping all documents through all trees, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otindex.llm.bytes_ import as_bytes, mixed, pieces, spans, window_hashes, word_hashes
from otindex.session import materialize

_WHITE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), list(_SYMBOLS))
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Features of the trees, and the direction in which they may move the score (0: any).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "echoes": -1, "longest_echo": -1,
    "upper": -1, "digits": 0, "shouts": -1, "bars": -1, "distinct": 0, "lines": 0, "non_ascii": 0, "sentences": 0,
}


def _exactly_twice(raw, starts, ends, of, at: np.ndarray, window: int) -> np.ndarray:
    """Those windows (by first word) whose words, compared as bytes, occur at least twice in their text.

    The hashes only choose whom to compare, so texts made to collide do not change a count.
    """
    if not len(at):
        return at
    inside = np.unique(at[:, None] + np.arange(window))
    numbers: dict[bytes, int] = {}
    bounds = zip(starts[inside].tolist(), ends[inside].tolist(), strict=True)
    words = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in bounds], np.int64)
    key = of[at].astype(np.int64)
    for k in range(window):
        key = key * len(numbers) + words[np.searchsorted(inside, at + k)]
        _, key, counts = np.unique(key, return_inverse=True, return_counts=True)
    return at[counts[key] > 1]


def statistics(texts: list[bytes], window: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Counts (texts x COUNTS, long) and features (texts x FEATURES, float) of some texts."""
    n = len(texts)
    raw = b"\n".join(texts)
    data = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    white = _WHITE[data]
    starts, ends = spans(~white)
    bounds = np.searchsorted(starts, first)
    n_words = np.diff(bounds)
    of = np.repeat(np.arange(n), n_words)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[first[1:] - 1] - total[first[:-1]]

    word_chars = per_text(~white & ((data & 0xC0) != 0x80))
    n_symbols = per_text(_SYMBOL[data])

    n_dup, n_lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, text in enumerate(texts):
        lines = [line for line in text.split(b"\n") if line.strip()]
        n_lines[k], n_dup[k] = len(lines), len(lines) - len(set(lines))

    hashes = word_hashes(data, starts, ends)
    windows = window_hashes(hashes, window)
    inside = np.flatnonzero(of[: len(windows)] == of[window - 1 :]) if len(windows) else np.empty(0, np.int64)
    salt = mixed(np.arange(1, n + 1, dtype=np.uint64))
    _, which, counts = np.unique(windows[inside] ^ salt[of[inside]], return_inverse=True, return_counts=True)
    change = np.zeros(len(starts) + 1, np.int64)
    twice = _exactly_twice(raw, starts, ends, of, inside[counts[which] > 1], window)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + window, -1)
    repeat = np.cumsum(change[:-1]) > 0
    n_repeat = np.bincount(of[repeat], minlength=n)

    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    longest = np.zeros(n, np.int64)
    a, b = spans(echo)
    np.maximum.at(longest, of[a], b - a)
    _, seen = np.unique(hashes ^ salt[of], return_index=True)
    distinct = np.bincount(of[seen], minlength=n)

    words = np.maximum(n_words, 1)
    letters = np.maximum(per_text(_LETTER[data]), 1)
    length = np.maximum(sizes, 1)
    features = np.stack(
        [
            np.log1p(n_words), word_chars / words, n_symbols / words, n_dup / np.maximum(n_lines, 1), n_repeat / words,
            np.bincount(of[echo], minlength=n) / words, np.log1p(longest), per_text(_UPPER[data]) / letters,
            per_text(_DIGIT[data]) / length, per_text(data == ord("!")) / words, per_text(data == ord("|")) / words,
            distinct / words, n_lines / words, per_text(data >= 128) / length, per_text(data == ord(".")) / words,
        ],
        axis=1,
    )
    return np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], axis=1), features


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, features) of whole texts.

    Words are runs of characters other than ASCII white space; a null text has none. ``features``
    is an array in the order of FEATURES.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                counts, features = statistics(as_bytes(piece.column("text")).to_pylist())
                lists = pa.FixedSizeListArray.from_arrays(pa.array(features.ravel()), len(FEATURES))
                columns = [piece.column("doc_id"), *(pa.array(c) for c in counts.T), lists.cast(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "features"])

    schema = f"doc_id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, features array<double>"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Training:
    """How the trees are grown. ``rows`` bounds the labelled sample that comes to the driver."""

    rows: int = 20_000
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    leaf: int = 20
    penalty: float = 1.0


@dataclass(frozen=True)
class Forest:
    """All nodes of all trees; a leaf's children are itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of features."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, directions: list[int], how: Training) -> Forest:
    """Boosted trees for the logistic loss on rows ``x`` with outcomes ``y`` (0 or 1)."""
    nodes: list[list] = []  # feature, threshold, left, right, value
    if len(y) == 0 or y.min() == y.max():
        sure = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return _flat([], nodes, sure, 0)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, how.bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total, roots = np.full(len(y), base), []

    def split(rows, g, h, low, high, depth) -> int:
        """Grows a node over ``rows`` and returns its number; its value stays within [low, high]."""
        here = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + how.penalty), low, high))
        nodes.append([0, np.inf, here, here, value * how.rate])
        if depth == 0 or len(rows) < 2 * how.leaf:
            return here
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for f, direction in enumerate(directions):
            bins = binned[rows, f]
            width = len(cuts[f]) + 1
            gl = np.cumsum(np.bincount(bins, g[rows], width))[:-1]
            hl = np.cumsum(np.bincount(bins, h[rows], width))[:-1]
            nl = np.cumsum(np.bincount(bins, minlength=width))[:-1]
            a, b = -gl / (hl + how.penalty), -(gs - gl) / (hs - hl + how.penalty)
            gain = gl**2 / (hl + how.penalty) + (gs - gl) ** 2 / (hs - hl + how.penalty) - gs**2 / (hs + how.penalty)
            fits = (nl >= how.leaf) & (len(rows) - nl >= how.leaf) & ((b - a) * direction >= 0)
            gain = np.where(fits, gain, 0)
            if len(gain) and gain.max() > best[0]:
                at = int(gain.argmax())
                best = (float(gain[at]), (f, at, float(np.clip(a[at], low, high)), float(np.clip(b[at], low, high))))
        if best[1] is None:
            return here
        f, at, a, b = best[1]
        middle = (a + b) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
        left_bounds, right_bounds = bounds[directions[f]]
        goes_left = binned[rows, f] <= at
        left = split(rows[goes_left], g, h, *left_bounds, depth - 1)
        right = split(rows[~goes_left], g, h, *right_bounds, depth - 1)
        nodes[here] = [f, float(cuts[f][at]), left, right, 0.0]
        return here

    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(split(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, how.depth))
        total += np.log(1 / (1 / _flat(roots[-1:], nodes, 0.0, how.depth).score(x) - 1))
    return _flat(roots, nodes, base, how.depth)


def _flat(roots: list[int], nodes: list[list], base: float, depth: int) -> Forest:
    feature, threshold, left, right, value = zip(*nodes, strict=True) if nodes else ((),) * 5
    integers = [np.array(v, np.int64) for v in (roots, feature, left, right)]
    return Forest(
        integers[0], integers[1], np.array(threshold, float), integers[2], integers[3], np.array(value, float), base, depth
    )


def train(statistics: DataFrame, labels: DataFrame, how: Training) -> Forest:
    """Grows the forest on at most ``how.rows`` labelled documents, chosen by hash of doc_id.

    Labels are (doc_id, quality); null labels and ids do not count, and of several labels of one
    document the lowest does. Repeated documents count once.
    """
    known = labels.where("doc_id is not null and quality is not null")
    sample = (
        known.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(how.rows)
    )
    rows = (
        statistics.join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.min("features").alias("features"))
        .orderBy("doc_id")
        .collect()
    )
    x = np.array([r["features"] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r["quality"] for r in rows], float)
    return grow(x, y, list(FEATURES.values()), how)


def judge(
    documents: DataFrame,
    labels: DataFrame,
    least_words: int = 10,
    most_repeats: int = 20,
    least_score: float = 0.3,
    how: Training | None = None,
) -> DataFrame:
    """The statistics of every document with base_failed, score and kept.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeats`` percent of the words
    within repeated five-word windows. kept: not base_failed and a score of at least ``least_score``.
    One row per row of ``documents``; a null text fails the base rules. Without labels every score is
    0.5. Other columns are ignored.
    """
    found = materialize(document_statistics(documents))
    forest = train(found, labels, how or Training())  # a few hundred nodes: travels with the task function

    def run(batches):
        for batch in batches:
            lists = batch.column("features")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            names = [c for c in batch.schema.names if c != "features"]
            score = pa.array(forest.score(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), score], [*names, "score"])

    scored = found.mapInArrow(run, f"doc_id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, score double")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= least_score)
    )
