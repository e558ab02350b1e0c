"""Toxicity: a subsequence string kernel with Nyström landmarks and a linear hinge-loss model.

The kernel counts common subsequences of ``LENGTH`` characters of two strings; a
subsequence weighs ``DECAY`` to the power of the characters it spans in either
string, so letters that someone inserts into an insult cost a little and do not
hide it. A token's kernel with a landmark is the best normal kernel of its windows
that are up to ``GAP`` characters longer than the landmark, a sentence's is the best
of its tokens (words, and runs of single characters taken as one word), which
tolerates gaps between letters.

Training on labelled sentences: sentences of a bounded sample of documents take
their document's label. Landmarks are the character strings that toxic documents
hold most above clean ones. The Nyström map turns a sentence's landmark kernels
into features, and the model is fitted by dual coordinate descent; of a toxic
document only its strongest sentence counts, first by landmark kernels and then
by the model itself (a second fit). A document's score is the calibrated score
of its most toxic sentence.

A word must hold three quarters of a landmark's distinct letters, tested with bit
masks; below that, and below ``FLOOR``, a kernel counts as zero.

Defined results: null and empty texts, and texts with no landmark in sight, get
the score of the zero kernel; repeated rows get the same score each; an empty
table gives an empty result; with too few labels every score is 0. Whole texts
are read.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmetrics.llm.common import annotate, dual_svm, fold, labelled, platt, sigmoid

FOLDS, HELD_OUT = 4, 2
#: Labelled documents of each class in the bounded training sample, and the fewest that suffice.
TRAIN_ROWS, LEAST_ROWS = 1500, 20
LENGTH, DECAY = 4, 0.7
LANDMARKS, SHORTEST, LONGEST = 32, 4, 9
#: A landmark is held by so many documents of the toxic sample and this share of it at least, and its odds are this high.
LEAST_HELD, LEAST_SHARE, LEAST_ODDS = 9, 0.025, 20.0
#: Documents of each class that landmarks are mined from.
MINED = 1000
#: Longer words count as pieces of this size, each overlapping the next by half.
PIECE = 64
#: Kernels below this count as zero: as a share of a landmark's own, and normal ones.
FLOOR, NORMAL_FLOOR = 0.5, 0.5
#: Characters that may be inserted into a landmark.
GAP = 3
#: Sentences of a toxic document with a kernel this high are labelled too, so many of them at most.
CLEAR, MORE = 0.9, 4
#: Sentences of a clean document that count, those nearest to toxic ones.
HARD = 12
COST = 10.0
LEAST_SLOPE = 2.0
PREDICT = 0.3

PUNCTUATION = str.maketrans("", "", string.punctuation)
SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")


def letters(word: str) -> int:
    """Bit mask of a word's characters, modulo 64."""
    mask = 0
    for c in word:
        mask |= 1 << (ord(c) & 63)
    return mask


def string_kernel(words: list[str], landmark: str) -> np.ndarray:
    """Common subsequences of LENGTH characters, decayed by their spans, of each word with a landmark.

    Words of one call are padded to the longest; a padding character equals nothing.
    """
    if not words:
        return np.zeros(0)
    longest = max(map(len, words))
    codes = np.array([[ord(c) for c in w.ljust(longest, "\0")] for w in words], dtype=np.int64)
    return _kernel(codes, np.array([[ord(c) for c in landmark]], dtype=np.int64))


def pair_kernel(words: list[str], others: list[str]) -> np.ndarray:
    """The same of each word with its own other."""
    if not words:
        return np.zeros(0)

    def padded(of: list[str], pad: int) -> np.ndarray:
        width = max(map(len, of))
        return np.array([[ord(c) for c in w] + [pad] * (width - len(w)) for w in of], dtype=np.int64)

    return _kernel(padded(words, -1), padded(others, -2))


def _kernel(codes: np.ndarray, target: np.ndarray) -> np.ndarray:
    (n, longest), m = codes.shape, target.shape[1]
    # tail[i][:, j]: subsequences of length i, decayed from their first character to the ends of both prefixes.
    tail = [np.ones((n, m + 1))] + [np.zeros((n, m + 1)) for _ in range(LENGTH - 1)]
    total = np.zeros(n)
    for at in range(longest):
        equal = codes[:, at, None] == target
        total += DECAY * DECAY * (tail[LENGTH - 1][:, :m] * equal).sum(axis=1)
        for i in range(LENGTH - 1, 0, -1):
            gained, run = tail[i - 1], np.zeros(n)
            fresh = np.zeros((n, m + 1))
            for j in range(m):
                run = DECAY * run + DECAY * DECAY * gained[:, j] * equal[:, j]
                fresh[:, j + 1] = run
            tail[i] = DECAY * tail[i] + fresh
    return total


def tokens(text: str) -> list[str]:
    """Words of a text in lower case and without punctuation, and its runs of single characters as one word each."""
    lower = text.lower().translate(PUNCTUATION)
    found = lower.split()
    if len(lower) > PIECE * len(found) or any(len(w) > PIECE for w in found):
        found = [w[at : at + PIECE] for w in found for at in range(0, max(1, len(w) - PIECE // 2), PIECE // 2)]
    return found + [re.sub(r"[ \t]", "", m[0]) for m in SPACED.finditer(lower)]


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s.strip()]


def sentence_kernels(text: str, hits: dict[str, np.ndarray], width: int) -> np.ndarray:
    """A row per sentence that has any kernel above the floor (one zero row if none has): the best of its tokens."""
    rows = []
    for sentence in sentences(text):
        near = [hits[w] for w in tokens(sentence) if w in hits]
        if near:
            rows.append(np.max(near, axis=0))
    return np.array(rows) if rows else np.zeros((1, width))


@dataclass(frozen=True)
class Model:
    landmarks: tuple[str, ...]
    own: np.ndarray  # each landmark's kernel with itself
    root: np.ndarray  # inverse root of the landmarks' kernel matrix (Nyström)
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def word_kernels(self, words: list[str]) -> dict[str, np.ndarray]:
        """Landmark kernels of those words that have any above the floor."""
        near_words: list[tuple[str, int]] = []
        masks = np.array([letters(w) for w in words], dtype=np.uint64)
        lengths = np.array([len(w) for w in words])
        for k, landmark in enumerate(self.landmarks):
            shared = np.bitwise_count(masks & np.uint64(letters(landmark)))
            distinct = len(set(landmark))
            least = max(-(-3 * distinct // 4), LENGTH - (len(landmark) - distinct))
            near = np.flatnonzero(shared >= least)
            for group in np.array_split(near[np.argsort(lengths[near], kind="stable")], len(near) // 2048 + 1):
                chosen = [words[i] for i in group]
                value = string_kernel(chosen, landmark) / self.own[k]
                near_words += [(word, k) for word, v in zip(chosen, value) if v >= FLOOR]
        return self._normal(near_words)

    def _normal(self, near: list[tuple[str, int]]) -> dict[str, np.ndarray]:
        """Normal kernel of each word with a landmark: the best of the word's windows that are up to GAP longer."""
        found: dict[str, np.ndarray] = {}
        for begin in range(0, len(near), 1024):
            owner, windows = [], []
            for at, (word, k) in enumerate(near[begin : begin + 1024]):
                size = len(self.landmarks[k])
                for width in sorted({min(len(word), size + more) for more in range(GAP + 1)}):
                    parts = [word[i : i + width] for i in range(len(word) - width + 1)]
                    windows += parts
                    owner += [at] * len(parts)
            marks = [near[begin + at][1] for at in owner]
            distinct = list(dict.fromkeys(windows))
            own = dict(zip(distinct, pair_kernel(distinct, distinct)))
            value = pair_kernel(windows, [self.landmarks[k] for k in marks])
            scale = np.sqrt(np.array([own[w] for w in windows]) * self.own[marks])
            normal = np.divide(value, scale, out=np.zeros(len(value)), where=scale > 0)
            for at, k, v in zip(owner, marks, normal):
                if v >= NORMAL_FLOOR:
                    row = found.setdefault(near[begin + at][0], np.zeros(len(self.landmarks)))
                    row[k] = max(row[k], v)
        return found

    def margins(self, kernels: np.ndarray) -> np.ndarray:
        return kernels @ self.root @ self.weights + self.offset

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margin + self.shift)


def score_texts(model: Model | None, texts: list[bytes | None]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    decoded = [(t or b"").decode("utf-8", "replace") for t in texts]
    found = [set(tokens(t)) for t in decoded]
    hits = model.word_kernels(list(set().union(*found)))
    margin = np.full(len(texts), model.margins(np.zeros((1, len(model.landmarks))))[0])
    for i, (text, words) in enumerate(zip(decoded, found)):
        if not words.isdisjoint(hits):
            kernels = sentence_kernels(text, hits, len(model.landmarks))
            margin[i] = max(margin[i], model.margins(kernels).max())
    return model.calibrated(margin)


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]]) -> list[str]:
    """Character strings held by many toxic and few clean documents.

    The string with high odds that the most toxic documents hold comes first,
    the longest of equals; words that hold it are then taken out.
    """

    def parts(words: set[str]) -> set[str]:
        return {
            w[at : at + size] for w in words for size in range(SHORTEST, min(LONGEST, len(w)) + 1) for at in range(len(w) - size + 1)
        }

    toxic, clean = toxic[:MINED], clean[:MINED]
    counts = Counter(p for words in toxic for p in parts(words))
    least, scale = max(LEAST_HELD, LEAST_SHARE * len(toxic)), len(clean) / max(1, len(toxic))
    often = {p for p, n in counts.items() if n >= least}
    other = Counter(p for words in clean for p in parts(words) & often)
    odd = {p for p in often if counts[p] * scale >= LEAST_ODDS * (other[p] + 0.5)}
    held = [[(w, parts({w}) & odd) for w in words] for words in toxic]
    held, chosen = [[(w, p) for w, p in words if p] for words in held], []
    while len(chosen) < LANDMARKS:
        counts = Counter(p for words in held for p in set().union(*(p for _, p in words)))
        if not counts or max(counts.values()) < least:
            break
        most = max(counts.values())
        best = max((p for p in counts if counts[p] >= 0.9 * most), key=lambda p: (len(p), counts[p], p))
        chosen.append(best)
        held = [[(w, p) for w, p in words if best not in w] for words in held]
    return chosen


def _nystrom(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    matrix = np.array([string_kernel(landmarks, t) for t in landmarks])
    own = np.diag(matrix).copy()
    matrix = matrix / np.sqrt(own[:, None] * own[None, :])
    values, vectors = np.linalg.eigh(matrix)
    keep = values > 1e-6
    return own, vectors[:, keep] / np.sqrt(values[keep])


def train(texts: list[str], y: np.ndarray) -> Model | None:
    """Model from labelled documents; a fifth of them calibrates it. None with too few of a class."""
    if min((y == 0).sum(), (y == 1).sum()) < LEAST_ROWS:
        return None
    words = [set(tokens(t)) for t in texts]
    landmarks = choose_landmarks([w for w, v in zip(words, y) if v], [w for w, v in zip(words, y) if not v])
    if not landmarks:
        return None
    own, root = _nystrom(landmarks)
    model = Model(tuple(landmarks), own, root, np.zeros(root.shape[1]), 0.0, 1.0, 0.0)
    hits = model.word_kernels(sorted(set().union(*words)))
    kernels = [sentence_kernels(t, hits, len(landmarks)) for t in texts]
    order = np.random.default_rng(5).permutation(len(y))
    kept_out, used = order[: len(y) // 5], order[len(y) // 5 :]
    strongest = [k[np.argmax(k.sum(axis=1))] for k in kernels]
    for _ in range(3):
        rows, sign = [], []
        for i in used:
            rows.append(strongest[i])
            sign.append(1.0 if y[i] else -1.0)
            # Toxic documents' further sentences count where a whole landmark stands in them.
            # Of clean documents the sentences that look most toxic count, after each fit anew.
            if y[i]:
                more = kernels[i][kernels[i].max(axis=1) >= CLEAR][:MORE]
            else:
                more = kernels[i][np.argsort(-(model.margins(kernels[i]) + kernels[i].sum(axis=1)), kind="stable")[:HARD]]
            rows += list(more)
            sign += [sign[-1]] * len(more)
        features, goal = np.array(rows) @ root, np.array(sign)
        index = np.arange(features.shape[1] + 1)
        sparse = [(index, np.append(f, 1.0)) for f in features]
        cost = np.full(len(goal), COST)
        w = dual_svm(sparse, goal, len(index), cost, epochs=30)
        model = Model(model.landmarks, own, root, w[:-1], float(w[-1]), 1.0, 0.0)
        strongest = [k[np.argmax(model.margins(k))] for k in kernels]
    # The classes stand well apart, so a curve through documents alone could lie anywhere between them:
    # it is held at the model's own boundary and only its slope is fitted.
    margin = model.margins(np.array([strongest[i] for i in kept_out]))
    slope, _ = platt(margin, y[kept_out])
    return Model(model.landmarks, own, root, model.weights, model.offset, max(slope, LEAST_SLOPE), 0.0)


def fit_model(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Model from a bounded sample of rows outside the held-out fold."""
    sample = labelled(documents, labels, "toxic", FOLDS, HELD_OUT, TRAIN_ROWS)
    found = sorted(sample.select("doc_id", "text", "y").collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] or "" for r in found], np.array([r["y"] for r in found], dtype=np.int64)) if found else None


def score_documents(documents: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """``row`` and ``score`` (higher: likelier toxic) of every document."""
    return annotate(
        documents, "text", lambda texts: [score_texts(model, texts)], [T.StructField("score", T.DoubleType())], keep
    )


def classify_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score_documents(documents, fit_model(documents, labels), ["doc_id"])
    doc_id = F.col("row.doc_id")
    return scored.select(
        doc_id.alias("doc_id"),
        (fold(doc_id, FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT).cast("int").alias("predicted"),
    )
