"""Quality classifier: naive Bayes support vectors over n-gram indicators.

An indicator says that a whole text holds an n-gram of 1 to 3 bytes, or a run of
1 to 5 words equal to the word before them. Indicators are scaled by the log
ratio of their smoothed counts in the two classes, and a linear hinge-loss model
is fitted on them by dual coordinate descent. A logistic curve, fitted on a fifth
of the sample that the weights do not see, turns margins into scores.

Defined results: null and empty texts have no indicators and get the score of
the model's offset; repeated rows get the same score each; an empty table gives
an empty result; with too few labels every score is 0.5. Whole texts are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmetrics.llm.common import annotate, dual_svm, fold, labelled, platt, sigmoid

FOLDS, HELD_OUT = 3, 1
#: Labelled documents of each class in the bounded training sample, and the fewest that suffice.
TRAIN_ROWS, LEAST_ROWS = 2500, 20
TRIGRAM_BITS, RUNS = 17, 5
PAIR_AT, TRIGRAM_AT = 256, 256 + 65536
RUN_AT = TRIGRAM_AT + (1 << TRIGRAM_BITS)
N_FEATURES = RUN_AT + RUNS
COST, SMOOTH = 1.0, 1.0


class Indicators:
    """Distinct n-gram numbers of texts. ``_last`` holds where each number was written last, so that
    one pass finds the distinct ones without sorting or clearing."""

    def __init__(self):
        self._last = np.zeros(N_FEATURES, dtype=np.int32)

    def __call__(self, text: bytes | None) -> np.ndarray:
        b = np.frombuffer(text or b"", dtype=np.uint8).astype(np.int32)
        pair = (b[:-1] << 8) | b[1:]
        triple = (((pair[:-1] << 8) | b[2:]).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS)
        found = np.concatenate([b, pair + PAIR_AT, triple.astype(np.int32) + TRIGRAM_AT])
        place = np.arange(len(found), dtype=np.int32)
        self._last[found] = place
        distinct = found[self._last[found] == place]
        longest, run = 0, 0
        words = (text or b"").split()
        for same in map(bytes.__eq__, words, words[1:]):
            run = run + 1 if same else 0
            longest = max(longest, run)
        runs = np.arange(min(longest, RUNS), dtype=np.int32) + RUN_AT
        return np.concatenate([distinct, runs])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    offset: float
    slope: float
    shift: float


def _margin(weights: np.ndarray, offset: float, found: np.ndarray) -> float:
    """Sum over a text's indicators, over the root of their number so that length does not decide."""
    return float(weights[found].sum()) / max(1.0, len(found)) ** 0.5 + offset


def train(rows: list[np.ndarray], y: np.ndarray) -> Model | None:
    if min((y == 0).sum(), (y == 1).sum()) < LEAST_ROWS:
        return None
    order = np.random.default_rng(3).permutation(len(y))
    kept_out, used = order[: len(y) // 5], order[len(y) // 5 :]

    def fit(of: np.ndarray) -> tuple[np.ndarray, float]:
        counts = np.full((2, N_FEATURES), SMOOTH)
        for i in of:
            counts[int(y[i]), rows[i]] += 1
        ratio = np.log(counts[1] / (SMOOTH * 2 + (y[of] == 1).sum())) - np.log(counts[0] / (SMOOTH * 2 + (y[of] == 0).sum()))
        sparse = []
        for i in of:
            scale = max(1.0, len(rows[i])) ** 0.5
            sparse.append((np.append(rows[i], N_FEATURES), np.append(ratio[rows[i]] / scale, 1.0)))
        sign = np.where(y[of] == 1, 1.0, -1.0)
        cost = COST * len(of) / 2 / np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum())
        w = dual_svm(sparse, sign, N_FEATURES + 1, cost)
        return w[:-1] * ratio, float(w[-1])

    weights, offset = fit(used)
    margin = np.array([_margin(weights, offset, rows[i]) for i in kept_out])
    slope, shift = platt(margin, y[kept_out])
    return Model(weights, offset, slope, shift)


def fit_model(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Model from a bounded sample of rows outside the held-out fold; indicators are found on the executors."""
    sample = labelled(documents, labels, "quality", FOLDS, HELD_OUT, TRAIN_ROWS)

    def run(texts):
        find = Indicators()
        return [[find(t).astype("<i4").tobytes() for t in texts]]

    found = annotate(sample, "text", run, [T.StructField("found", T.BinaryType())], ["doc_id", "y"]).collect()
    found.sort(key=lambda r: (r["row"]["doc_id"], bytes(r["found"])))
    if not found:
        return None
    return train([np.frombuffer(r["found"], dtype="<i4") for r in found], np.array([r["row"]["y"] for r in found]))


def score_documents(documents: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """``row`` and ``score`` (higher: likelier of good quality) of every document."""

    def run(texts):
        if model is None:
            return [np.full(len(texts), 0.5)]
        find = Indicators()
        margin = np.array([_margin(model.weights, model.offset, find(t)) for t in texts])
        return [sigmoid(model.slope * margin + model.shift)]

    return annotate(documents, "text", run, [T.StructField("score", T.DoubleType())], keep)


def classify_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score_documents(documents, fit_model(documents, labels), ["doc_id"])
    doc_id = F.col("row.doc_id")
    return scored.select(
        doc_id.alias("doc_id"),
        (fold(doc_id, FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
