"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on the logistic loss with histogram splits, then flattened into
numpy arrays (a complete binary tree per row of the arrays), so a batch of
documents walks all trees without a Python loop over documents. Features listed
in ``DIRECTION`` are monotonic: more symbols, repeats or shouting never raise a
document's score.

Defined results: null and empty texts have all statistics 0 and fail the base
rule; ties and repeated rows get the same verdict each; an empty table gives an
empty result; with too few labels to train, the base rule alone decides. Whole
texts are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmetrics.llm.common import annotate, labelled, sigmoid

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rows of each class used for training (a bounded sample), and rows of a class needed at least.
TRAIN_ROWS, LEAST_ROWS = 3000, 20
#: Share of good training documents that the verdict keeps at least.
KEEP_GOOD = 0.998

BLOCK = 100

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word", "symbols_per_word", "dup_lines_per_line", "repeat_share",
    "upper_share", "exclaims_per_word", "same_as_previous", "distinct_in_block", "pipes_per_word",
)
#: 1: never lowers the score when it grows; -1: never raises it; 0: free.
DIRECTION = (0, 0, -1, -1, -1, -1, -1, -1, 1, -1)


def base_statistics(body: bytes | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five base counts and the model's features of one whole text."""
    text = body or b""
    words = text.split()  # on the six ASCII white space bytes
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    repeated_lines = 0
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                repeated_lines += bool(line.strip())
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, until = Counter(windows), 0
        for at, window in enumerate(windows):
            if counts[window] > 1:
                repeated += at + 3 - max(at, until)
                until = at + 3
    some, some_chars = max(n, 1), max(chars, 1)
    features = (
        float(np.log1p(n)),
        chars / some,
        symbols / some,
        repeated_lines / len(lines),
        repeated / some,
        (len(joined) - len(joined.translate(None, UPPER))) / some_chars,
        text.count(b"!") / some,
        sum(map(bytes.__eq__, words, words[1:])) / some,
        # Inside blocks, since the share of a whole text falls with its length.
        sum(len(set(words[at : at + BLOCK])) for at in range(0, n, BLOCK)) / some,
        text.count(b"|") / some,
    )
    return (n, chars, symbols, repeated_lines, repeated), features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


@dataclass(frozen=True)
class Forest:
    """Complete binary trees, one per row: node k has children 2k+1 and 2k+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    offset: float
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Likelihood that a document is good; x has a row per document."""
        total = np.full(len(x), self.offset)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return sigmoid(total)


def _split(codes, g, h, rows, edges, low, high, ridge):
    """Best monotonic split of one node: (gain, feature, bin, left value, right value)."""
    best = (1e-6, -1, 0, 0.0, 0.0)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    parent = total_g**2 / (total_h + ridge)
    for f, cuts in enumerate(edges):
        if not len(cuts):
            continue
        gs = np.cumsum(np.bincount(codes[rows, f], g[rows], len(cuts) + 1))[:-1]
        hs = np.cumsum(np.bincount(codes[rows, f], h[rows], len(cuts) + 1))[:-1]
        left = np.clip(-gs / (hs + ridge), low, high)
        right = np.clip(-(total_g - gs) / (total_h - hs + ridge), low, high)
        gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - parent
        bad = (hs < 1e-3) | (total_h - hs < 1e-3) | (DIRECTION[f] * (right - left) < 0)
        gain[bad] = -1
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (gain[at], f, at, left[at], right[at])
    return best


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48) -> Forest | None:
    """Boosted trees on labelled rows; None when a class has too few rows."""
    if min((y == 0).sum(), (y == 1).sum()) < LEAST_ROWS:
        return None
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    offset, score, ridge = 0.0, np.zeros(len(y)), 1.0
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = sigmoid(score)
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        nodes = {0: (np.arange(len(y)), -8.0, 8.0, 0.0)}
        for k in range(inner):
            rows, low, high, own = nodes.pop(k)
            gain, f, at, left, right = _split(codes, g, h, rows, edges, low, high, ridge) if len(rows) else (0, -1, 0, 0, 0)
            if f < 0:  # everything goes left, with the node's own value
                nodes[2 * k + 1], nodes[2 * k + 2] = (rows, low, high, own), (rows[:0], low, high, own)
                continue
            feature[k], threshold[k] = f, edges[f][at]
            goes_left, middle = codes[rows, f] <= at, (left + right) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(DIRECTION[f], ((low, high),) * 2)
            nodes[2 * k + 1] = (rows[goes_left], *bounds[0], left)
            nodes[2 * k + 2] = (rows[~goes_left], *bounds[1], right)
        value = np.zeros(leaves)
        for leaf in range(leaves):
            rows, _, _, own = nodes[inner + leaf]
            value[leaf] = rate * own
            score[rows] += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    forest = Forest(np.stack(features), np.stack(thresholds), np.stack(values), offset, 0.5)
    good = np.sort(forest.score(x[y == 1]))
    cut = min(0.5, float(good[int((1 - KEEP_GOOD) * len(good))]))
    return Forest(forest.feature, forest.threshold, forest.value, offset, cut)


def fit_forest(documents: DataFrame, labels: DataFrame) -> Forest | None:
    """Trees from a bounded sample of labelled documents; their statistics are computed on the executors."""
    sample = labelled(documents, labels, "quality", 1, -1, TRAIN_ROWS)
    fields = [T.StructField("features", T.ArrayType(T.DoubleType()))]
    found = annotate(sample, "text", lambda texts: [[list(base_statistics(t)[1]) for t in texts]], fields, ["y"]).collect()
    if not found:
        return None
    return train(np.array([r["features"] for r in found]), np.array([r["row"]["y"] for r in found]))


def apply_rules(documents: DataFrame, forest: Forest | None, keep: list[str] | None = None) -> DataFrame:
    """``row``, the base counts, ``base_failed``, ``score`` and ``kept`` for each document."""

    def run(texts):
        found = [base_statistics(t) for t in texts]
        base = list(zip(*(b for b, _ in found)))
        failed = [base_failed(b[0], b[4]) for b, _ in found]
        score = forest.score(np.array([f for _, f in found])) if forest else np.full(len(texts), 0.5)
        cut = forest.cut if forest else 0.0
        return [*base, failed, score, [not bad and bool(s >= cut) for bad, s in zip(failed, score)]]

    fields = [T.StructField(n, T.LongType()) for n in BASE]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return annotate(documents, "text", run, fields, keep)


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, score."""
    done = apply_rules(documents, fit_forest(documents, labels), ["doc_id"])
    return done.select(F.col("row.doc_id").alias("doc_id"), *BASE, "base_failed", "kept", "score")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    done = apply_rules(documents, fit_forest(documents, labels))
    return done.where("kept").select("row.*")
