"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

Candidates are all tokens of six or more secret-like characters, whatever they
look like. One that holds more than a pattern's finding in it is a span of kind
``model`` as a whole, so that no rest of a longer secret stays. Those that no
finding touches are scored by the network: a convolution over the characters of
the whole text, pooled for each candidate inside (maximum and mean) and over 16
bytes of context on either side (maximum), and a logistic unit.

It is trained in numpy on labelled findings: the patterns' findings, each also
with its keyword or surroundings taken away, and made secrets of other shapes
(tokens with a prefix, encoded keys, dotted tokens, passwords) that stand where
unlabelled candidates stood. Tokens that no pattern touches are unlabelled, not
clean: those that the network takes for secrets half-way through the training
lose their weight. A bounded sample only gives the weights to start from: then
every task takes them on through all tokens and findings of its texts, a step for
each portion, and what the tasks learn is averaged. The threshold is calibrated on
a fifth of all findings (and as many made secrets as weigh the same) that no step
has seen: the highest one whose recall stays at ``RECALL`` there. Candidates at or
above it are added as spans of kind ``model``; pattern findings always stay.
Averaged weights depend, if little, on how texts are dealt over tasks.

Defined results: null and empty texts have no spans; overlapping kinds are all
reported; repeated rows get the same spans each; an empty table gives an empty
result; without enough unlabelled candidates only the patterns and the tokens
around them report. Whole texts are read; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histmetrics.llm.common import annotate, platt, sigmoid, written

# The three base patterns and the shortest finding of each.
ASSIGN = re.compile(
    rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "model")

LEAST_TOKEN = 6
TOKEN = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_TOKEN)


def _marks(of: str) -> bytes:
    """Table for ``bytes.translate``: 1 for these characters, 0 for others."""
    return bytes(c in of.encode() for c in range(256))


IN_TOKEN = _marks(string.ascii_letters + string.digits + "+/_.=-")
#: Characters that plain words lack after their first letter.
ODD = _marks(string.ascii_uppercase + string.digits + "+/_=-")
IN_HEX, HEX_RUN = _marks(string.digits + "abcdef"), b"\1" * 24
CONTEXT, SHOWN, WIDTH = 16, 64, 5
#: Characters beside a candidate that a window shows: its context and what the filters see beyond.
SIDE = CONTEXT + WIDTH // 2
WINDOW = 2 * SIDE + SHOWN
#: Positions whose responses are held at once.
CHUNK = 1 << 13
#: Bytes of text, about, that are laid out at once.
PORTION = 1 << 20
#: Labelled findings, unlabelled plain and unlabelled odd candidates in the sample that gives the first weights, each; the fewest of a class.
TRAIN_FINDINGS, LEAST_FINDINGS = 2000, 30
#: Made secrets in it.
MADE = 2000
RECALL = 0.98
NONE_HELD_OUT_CUT = 2.0
#: Unlabelled candidates that score so high half-way lose their weight.
DOUBTFUL = 0.9
#: A step's length; made secrets in a portion; errors below which a token moves the output unit alone, not the filters.
RATE, PLACED, SLIGHT = 0.05, 64, 0.03
#: One finding in so many is kept out of all steps; margins are counted in steps of 1 / MARKS.
HELD_OUT, MARKS = 5, 256
#: What a network learns.
ARRAYS = ("embed", "kernel", "bias", "out", "out_bias")

Span = tuple[int, int, int]  # start, end, index of the kind; in bytes


def base_spans(text: bytes) -> list[Span]:
    """Findings of the fixed patterns, by start and then kind."""
    found: list[Span] = []
    if b"=" in text or b":" in text:
        lower = text.lower()
        if any(word in lower for word in (b"passw", b"secret", b"token", b"api")):
            found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if HEX_RUN in text.translate(IN_HEX):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def wider_tokens(text: bytes, base: list[Span]) -> list[Span]:
    """Tokens of secret-like characters that hold more than the findings in them."""
    wider, at = [], 0
    for m in TOKEN.finditer(text) if base else ():
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        touched = whole = False
        k = at
        while k < len(base) and base[k][0] < m.end():
            touched |= base[k][1] > m.start()
            whole |= base[k][0] <= m.start() and base[k][1] >= m.end()
            k += 1
        if touched and not whole:
            wider.append((m.start(), m.end(), 3))
    return wider


class Texts:
    """Texts of a batch in one array of bytes, zeros between them, with the tokens that no finding touches."""

    def __init__(self, texts: list[bytes], bases: list[list[Span]]):
        gap = b"\0" * (SIDE + 1)
        whole = gap + b"".join(t + gap for t in texts)
        self.body = np.frombuffer(whole, dtype=np.uint8)
        self.begin = len(gap) + np.concatenate([[0], np.cumsum([len(t) + len(gap) for t in texts])])[:-1].astype(np.int64)
        within = np.frombuffer(whole.translate(IN_TOKEN), dtype=np.uint8)
        edge = np.flatnonzero(within[1:] != within[:-1]) + 1  # gaps at both ends: starts and ends in turn
        start, end = edge[::2], edge[1::2]
        long = end - start >= LEAST_TOKEN
        start, end = start[long], end[long]
        found = np.array([(at + s[0], at + s[1]) for at, base in zip(self.begin, bases) for s in base], dtype=np.int64).reshape(-1, 2)
        if len(found):
            # A finding touches the tokens from the first that ends after its start to the last that starts before its end.
            marks = np.zeros(len(start) + 1, dtype=np.int64)
            np.add.at(marks, np.searchsorted(end, found[:, 0], side="right"), 1)
            np.subtract.at(marks, np.searchsorted(start, found[:, 1], side="left"), 1)
            free = np.cumsum(marks[:-1]) == 0
            start, end = start[free], end[free]
        self.start, self.end = start, end

    def window(self, k: int) -> bytes:
        return window_of(self.body, int(self.start[k]), int(self.end[k]))

    def odd(self) -> np.ndarray:
        """Whether a token has characters after its first that plain words lack."""
        odd = np.flatnonzero(np.frombuffer(self.body.tobytes().translate(ODD), dtype=np.uint8))
        return np.searchsorted(odd, self.end) > np.searchsorted(odd, self.start + 1)

    def hashes(self) -> np.ndarray:
        """A hash of each token's first and last eight bytes and of the eight before it."""
        with np.errstate(over="ignore"):
            mixed = np.full(len(self.start), 0x9E3779B97F4A7C15, dtype=np.uint64)
            for at in (*(self.start + k for k in range(-8, 8)), *(self.end - k for k in range(1, 9))):
                mixed = (mixed ^ self.body[at].astype(np.uint64)) * np.uint64(0x100000001B3)
                mixed ^= mixed >> np.uint64(29)
        return mixed


def portions(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about PORTION bytes, or one longer text."""
    begin = held = 0
    for at, text in enumerate(texts):
        if held and held + len(text) > PORTION:
            yield begin, at
            begin, held = at, 0
        held += len(text)
    if texts:
        yield begin, len(texts)


def window_of(text, start: int, end: int) -> bytes:
    """A candidate (its first 64 bytes in training) between its contexts, and its length in the last byte."""
    before, inside, after = (bytes(text[a:b]) for a, b in ((max(0, start - SIDE), start), (start, min(end, start + SHOWN)), (end, end + SIDE)))
    return (before.rjust(SIDE, b"\0") + inside + after).ljust(WINDOW, b"\0") + bytes([len(inside)])


def windows_of(text: bytes, span: Span) -> list[bytes]:
    return [window_of(text, span[0], span[1])]


def moved(window: bytes, place: bytes) -> bytes:
    """A window's candidate in the context of another one."""
    inside, size = window[SIDE : SIDE + window[-1]], SIDE + place[-1]
    return (place[:SIDE] + inside + place[size : size + SIDE]).ljust(WINDOW, b"\0") + bytes([len(inside)])


def made_secrets(n: int, seed: int = 17) -> list[bytes]:
    """Random secrets of shapes that the patterns do not name, each shape as often."""
    rng = np.random.default_rng(seed)
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    alnum = lower + upper + digits

    def some(of: str, least: int, most: int) -> str:
        return "".join(of[i] for i in rng.integers(0, len(of), rng.integers(least, most + 1)))

    def password() -> str:
        parts = list(some(alnum, 5, 13) + some(lower, 1, 1) + some(upper, 1, 1) + some(digits, 1, 1))
        return "".join(parts[i] for i in rng.permutation(len(parts)))

    shapes = [
        lambda: some(alnum, 16, 48),
        lambda: some(alnum + "+/", 20, 62) + "=" * int(rng.integers(0, 3)),
        lambda: some(lower, 2, 5) + "_-"[rng.integers(2)] + some(alnum, 16, 40),
        lambda: some(lower, 2, 3) + "_" + some(lower, 4, 4) + "_" + some(alnum, 16, 32),
        lambda: ".".join(("ey" + some(alnum, 10, 18), some(alnum + "_-", 16, 24), some(alnum + "_-", 12, 18))),
        lambda: some(upper + digits, 16, 32),
        lambda: some(lower + upper, 16, 32),
        lambda: some(lower + digits, 16, 40),
        password,
    ]
    return [shapes[i % len(shapes)]().encode() for i in range(n)]


@dataclass(frozen=True)
class Network:
    """Embedding, one convolution, three pools over its positions, one logistic unit."""

    embed: np.ndarray  # 128 x e
    kernel: np.ndarray  # (width * e) x filters
    bias: np.ndarray
    out: np.ndarray  # 3 * filters: maximum and mean inside, maximum around
    out_bias: float
    slope: float = 1.0
    offset: float = 0.0
    cut: float = NONE_HELD_OUT_CUT
    #: Plain tokens, odd tokens and findings that the tasks' steps went through.
    seen: tuple[int, ...] = (0, 0, 0)

    @cached_property
    def tables(self) -> list[np.ndarray]:
        """The convolution of embedded characters, for pairs and the last one of a filter's places; the first holds the bias."""
        found = np.einsum("ce,kef->kcf", self.embed, self.kernel.reshape(WIDTH, -1, self.kernel.shape[1])).astype(np.float32)
        found[0] += self.bias
        pairs = [(a[:, None] + b[None]).reshape(-1, a.shape[1]) for a, b in zip(found[:-1:2], found[1::2])]
        return [*pairs, found[-1]]

    def response(self, codes: np.ndarray) -> np.ndarray:
        """Filters at every position of rows of characters, but for the WIDTH - 1 outer ones."""
        size, (*pairs, last) = codes.shape[-1] - WIDTH + 1, self.tables
        two = codes[..., :-1].astype(np.int32) << 7 | codes[..., 1:]
        found = np.take(last, codes[..., WIDTH - 1 :], axis=0)
        for k, table in enumerate(pairs):
            found += np.take(table, two[..., 2 * k : 2 * k + size], axis=0)
        return np.maximum(found, np.zeros_like(found), out=found)  # twice as fast as with a single 0

    def margin(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(windows), 512):
            codes, inside, around = split(windows[at : at + 512])
            act = self.response(codes)
            pools = [(act * inside[..., None]).max(axis=1), (act * inside[..., None]).sum(axis=1) / inside.sum(axis=1)[:, None]]
            parts.append(np.concatenate([*pools, (act * around[..., None]).max(axis=1)], axis=1) @ self.out + self.out_bias)
        return np.concatenate(parts) if parts else np.zeros(0)

    def score(self, windows: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(windows) + self.offset)

    def score_tokens(self, texts: Texts) -> np.ndarray:
        """Scores of a batch's tokens."""
        return sigmoid(self.slope * self.margin_tokens(texts) + self.offset)

    def margin_tokens(self, texts: Texts) -> np.ndarray:
        margins = np.zeros(len(texts.start))
        for tokens, pools in self.stretches(texts):
            margins[tokens] = pools.margin(self)
        return margins

    def stretches(self, texts: Texts) -> Iterator[tuple[slice, Pools]]:
        """A batch's tokens and their pools, some at a time; each position of the texts is convolved about once, in chunks."""
        codes, half, at = np.minimum(texts.body, 127), WIDTH // 2, 0
        while at < len(texts.start):
            low = int(texts.start[at]) - CONTEXT
            upto = max(at + 1, int(np.searchsorted(texts.end, low + CHUNK - CONTEXT, side="right")))
            start, end = texts.start[at:upto], texts.end[at:upto]
            if end[-1] - start[0] > CHUNK:  # one token that is longer than a chunk, in parts
                yield slice(at, upto), self._long(codes, int(start[0]), int(end[0]))
            else:
                act = self.response(codes[low - half : int(end[-1]) + CONTEXT + half])
                start, end = start - low, end - low
                yield slice(at, upto), Pools(act, start, end, *_tops(act, start, end))
            at = upto

    def _long(self, codes: np.ndarray, start: int, end: int) -> Pools:
        half, most, total = WIDTH // 2, 0.0, 0.0
        for at in range(start, end, CHUNK):
            act = self.response(codes[at - half : min(at + CHUNK, end) + half])
            most, total = np.maximum(most, act.max(axis=0)), total + act.sum(axis=0, dtype=np.float64)
        sides = [self.response(codes[a - half : a + CONTEXT + half]).max(axis=0) for a in (start - CONTEXT, end)]
        # Its mean stands for its positions.
        mean = (total / (end - start)).astype(np.float32)[None, :]
        return Pools(mean, np.array([0]), np.array([1]), most[None, :], np.maximum(*sides)[None, :])


@dataclass(frozen=True)
class Pools:
    """Filters at the positions of some tokens, and their maxima inside and around each token; means stay sums over positions."""

    act: np.ndarray  # position x filter
    start: np.ndarray
    end: np.ndarray
    most: np.ndarray  # token x filter
    around: np.ndarray

    def margin(self, network: Network) -> np.ndarray:
        inside, mean, beside = np.split(network.out.astype(np.float32), 3)
        # A mean's part of the margin is a sum of positions' parts.
        total = np.zeros(len(self.act) + 1)
        np.cumsum((self.act @ mean).astype(np.float64), out=total[1:])
        means = (total[self.end] - total[self.start]) / (self.end - self.start)
        return self.most @ inside + means + self.around @ beside + network.out_bias

    def weighted(self, weight: np.ndarray) -> np.ndarray:
        """Sum of the tokens' maxima inside, means and maxima around, each token times its weight."""
        share = np.zeros(len(self.act) + 1)  # of each position: tokens lie apart
        share[self.start] = weight / (self.end - self.start)
        share[self.end] = -share[self.start]
        each, place = weight.astype(np.float32), np.cumsum(share[:-1]).astype(np.float32)
        return np.concatenate([each @ self.most, place @ self.act, each @ self.around])


def _tops(act: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima inside and around ranges of four positions and more: windows of four positions cover them."""
    two = np.maximum(act[:-1], act[1:])
    four = np.maximum(two[:-2], two[2:])
    inside = [start, np.minimum(start + 4, end - 4), np.maximum(end - 8, start), end - 4]
    beside = [at + k for at in (start - CONTEXT, end) for k in range(0, CONTEXT, 4)]
    tops = np.take(four, np.stack([*inside, *beside]), axis=0)
    most, around = tops[: len(inside)].max(axis=0), tops[len(inside) :].max(axis=0)
    wide = np.flatnonzero(end - start > 16)
    if len(wide):
        size = end[wide] - start[wide]
        first = np.cumsum(size) - size
        places = np.arange(int(size.sum())) + np.repeat(start[wide] - first, size)
        most[wide] = np.maximum.reduceat(act[places], first, axis=0)
    return most, around


def encode(windows: list[bytes]) -> np.ndarray:
    codes = np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(-1, WINDOW + 1)
    return np.minimum(codes, 127)


def trimmed(windows: np.ndarray) -> np.ndarray:
    """Encoded windows without the places that are empty in all of them."""
    return np.delete(windows, np.s_[2 * SIDE + int(windows[:, -1].max()) : WINDOW], axis=1)


def split(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of encoded windows, and masks of the filters' positions inside and around."""
    place, size = np.arange(windows.shape[1] - WIDTH), windows[:, -1:].astype(np.int64)
    inside = (place >= CONTEXT) & (place < CONTEXT + size)
    around = ~inside & (place < 2 * CONTEXT + size)
    return windows[:, :-1], inside, around


def gradient(net: dict[str, np.ndarray], windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Slope of the weighted logistic loss of encoded windows, for each of the network's arrays."""
    e, filters = net["embed"].shape[1], net["kernel"].shape[1]
    codes, inside, around = split(windows)
    shifted = np.stack([codes[:, k : k + inside.shape[1]] for k in range(WIDTH)], axis=2)  # batch x place x width
    columns = net["embed"][shifted].reshape(*shifted.shape[:2], -1)
    raw = columns @ net["kernel"] + net["bias"]
    act, size = np.maximum(raw, 0), inside.sum(axis=1)[:, None].astype(raw.dtype)
    within, beside = act * inside[..., None], act * around[..., None]
    tops = [m.argmax(axis=1)[:, None] for m in (within, beside)]
    best, near = (np.take_along_axis(m, t, axis=1)[:, 0] for m, t in zip((within, beside), tops))
    pools = np.concatenate([best, within.sum(axis=1) / size, near], axis=1)
    error = (sigmoid(pools @ net["out"] + net["out_bias"]) - y) * weight
    back = np.split(error[:, None] * net["out"], 3, axis=1)
    into = (back[1] / size)[:, None, :] * inside[..., None]
    for top, mask, part in ((tops[0], inside, back[0]), (tops[1], around, back[2])):
        there = np.take_along_axis(mask[..., None], top, axis=1)
        np.put_along_axis(into, top, np.take_along_axis(into, top, axis=1) + part[:, None, :] * there, axis=1)
    into *= raw > 0
    grad = {
        "out": pools.T @ error,
        "out_bias": np.array([error.sum()]),
        "bias": into.sum(axis=(0, 1)),
        "kernel": columns.reshape(-1, WIDTH * e).T @ into.reshape(-1, filters),
    }
    each, flat = (into @ net["kernel"].T).reshape(-1, e), shifted.ravel()
    grad["embed"] = np.stack([np.bincount(flat, each[:, k], 128) for k in range(e)], axis=1)
    return grad


def train(windows: list[bytes], y: np.ndarray, epochs: int = 10, seed: int = 11) -> Network | None:
    """Network from windows that are labelled (1) or not (0); a fifth of them sets the threshold. None with too few of a class."""
    if min((y == 0).sum(), (y == 1).sum()) < LEAST_FINDINGS:
        return None
    rng = np.random.default_rng(seed)
    e, filters = 8, 24
    net = {
        "embed": rng.normal(0, 0.3, (128, e)),
        "kernel": rng.normal(0, (2 / (WIDTH * e)) ** 0.5, (WIDTH * e, filters)),
        "bias": np.zeros(filters),
        "out": rng.normal(0, 0.2, 3 * filters),
        "out_bias": np.zeros(1),
    }
    every, order = encode(windows), rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    weight = np.ones(len(y))
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    step = 0

    def now() -> Network:
        return Network(net["embed"], net["kernel"], net["bias"], net["out"], float(net["out_bias"][0]))

    for epoch in range(epochs):
        if epoch == epochs // 2:
            # What looks like a secret among the unlabelled may be one.
            weight[used[(y[used] == 0) & (now().score(every[used]) >= DOUBTFUL)]] = 0.0
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            grad = gradient(net, every[batch], y[batch], weight[batch] / len(batch))
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                scale = (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                net[k] = net[k] - 0.004 * scale * first[k] / (np.sqrt(second[k]) + 1e-8)
    done = now()
    margin = done.margin(every[held])
    # Classes that stand far apart would send the curve's steps astray: it is fitted over margins of unit spread.
    middle, spread = float(margin.mean()), float(margin.std()) or 1.0
    slope, offset = platt((margin - middle) / spread, y[held])
    slope, offset = slope / spread, offset - slope * middle / spread
    held_score = np.sort(sigmoid(slope * margin + offset)[y[held] == 1])
    cut = float(held_score[int((1 - RECALL) * len(held_score))]) if len(held_score) else NONE_HELD_OUT_CUT
    return Network(done.embed, done.kernel, done.bias, done.out, done.out_bias, slope, offset, cut)


def _value(text: bytes, span: Span) -> Span:
    """The secret inside a finding: what follows the keyword of an assignment."""
    if span[2]:
        return span
    return (ASSIGN.match(text, span[0]).start(2), span[1], 0)


def training_sample(findings: list[bytes], unlabelled: list[bytes], seed: int = 13) -> tuple[list[bytes], np.ndarray]:
    """Windows and labels: findings with and without their surroundings, made secrets where unlabelled candidates stood."""
    if not unlabelled:
        return findings, np.ones(len(findings), dtype=np.int64)
    rng = np.random.default_rng(seed)
    places = [unlabelled[i] for i in rng.integers(0, len(unlabelled), len(findings) + MADE)]
    shown = [w if i % 2 else moved(w, places[i]) for i, w in enumerate(findings)]
    made = [moved(window_of(value, 0, len(value)), place) for value, place in zip(made_secrets(MADE), places[len(findings) :])]
    return [*shown, *made, *unlabelled], np.array([1] * (len(shown) + len(made)) + [0] * len(unlabelled), dtype=np.int64)


def kept_out(window: bytes) -> bool:
    """Whether a finding sets the threshold and takes part in no step."""
    return zlib.crc32(window) % HELD_OUT == 0


def _gather(documents: DataFrame, start: int) -> DataFrame:
    """``(windows, kind, n)``: all different findings (2; kept out: 3), the first ``start`` of a batch's plain and odd
    tokens (0, 1) by hash, and under their numbers as windows how many plain and odd tokens and findings there are (4).
    """

    def run(texts):
        texts = [t or b"" for t in texts]
        bases = [base_spans(t) for t in texts]
        found = [windows_of(text, _value(text, s))[0] for text, base in zip(texts, bases) for s in base]
        many = [0, 0, sum(not kept_out(w) for w in found)]
        offered: list[dict[int, bytes]] = [{}, {}]
        for begin, end in portions(texts):
            free = Texts(texts[begin:end], bases[begin:end])
            hashes, odd = free.hashes(), free.odd()
            for kind, least in enumerate(offered):
                own = np.flatnonzero(odd == kind)
                many[kind] += len(own)
                if len(least) >= start:  # beyond the last of them, none will be kept
                    own = own[hashes[own] <= np.uint64(max(least))]
                of, at = np.unique(hashes[own], return_index=True)
                least.update((int(h), free.window(k)) for h, k in zip(of[:start], own[at]))
                offered[kind] = dict(sorted(least.items())[:start])
        rows = [(w, kind, 1) for kind, least in enumerate(offered) for w in least.values()]
        rows += [(w, 3 if kept_out(w) else 2, 1) for w in sorted(set(found))]
        rows += [(str(kind).encode(), 4, n) for kind, n in enumerate(many)]
        rest = [[]] * (len(texts) - 1)  # the batch's own stand beside its first row
        return [[list(column), *rest] for column in zip(*rows)]

    fields = [T.StructField(c, T.ArrayType(t)) for c, t in (("windows", T.BinaryType()), ("kind", T.LongType()), ("n", T.LongType()))]
    every = annotate(documents, "text", run, fields, ["doc_id"]).select(F.explode(F.arrays_zip("windows", "kind", "n")).alias("f"))
    # Copies weigh once. The table is written, so that each order by hash ends in one task, not in the driver.
    counted = every.select("f.*").groupBy("windows").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"))
    return written(counted, "candidates")


def step(net: dict[str, np.ndarray], texts: list[bytes], many: list[int], made: list[bytes], rng: np.random.Generator) -> list[int]:
    """One step of a network along the loss of a portion's tokens and findings; how many of each kind it went through.

    Plain tokens, odd ones, findings and made secrets weigh a quarter each over the whole table (``many`` of each
    there). All tokens move the output unit; those whose error is not slight move the filters too.
    """
    bases = [base_spans(t) for t in texts]
    free = Texts(texts, bases)
    if not len(free.start):
        return [0, 0, 0]
    now, odd = Network(**{k: v for k, v in net.items() if k != "out_bias"}, out_bias=float(net["out_bias"][0])), free.odd()
    share = sum(many[:2]) / len(odd) / 4
    weight = np.where(odd, share / max(many[1], 1), share / max(many[0], 1))
    error, slope = np.zeros(len(odd)), {k: np.zeros(v.shape, dtype=np.float32) for k, v in net.items()}
    for tokens, pools in now.stretches(free):
        error[tokens] = sigmoid(pools.margin(now))
        slight = np.where(error[tokens] < SLIGHT, weight[tokens] * error[tokens], 0)
        slope["out"] = slope["out"] + pools.weighted(slight)
        slope["out_bias"] = slope["out_bias"] + slight.sum()
    strong = np.flatnonzero((error >= SLIGHT) & (error < DOUBTFUL))
    found = [w for text, base in zip(texts, bases) for s in base if not kept_out(w := windows_of(text, _value(text, s))[0])]
    places = [free.window(k) for k in rng.integers(0, len(odd), len(found) + PLACED)]
    labelled = [w if i % 2 else moved(w, places[i]) for i, w in enumerate(found)]
    labelled += [moved(window_of(made[i], 0, len(made[i])), at) for i, at in zip(rng.integers(0, len(made), PLACED), places[len(found) :])]
    weights = [np.full(len(found), share / max(many[2], 1)), np.full(PLACED, 1 / PLACED / 4), weight[strong]]
    windows, y = encode([*labelled, *(free.window(k) for k in strong)]), np.repeat([1.0, 0.0], [len(labelled), len(strong)])
    narrow = {k: v.astype(np.float32) for k, v in net.items()}
    y, weights = y.astype(np.float32), np.concatenate(weights).astype(np.float32)
    # Windows of a size go together, so that few of their places are empty.
    for some in np.array_split(np.argsort(windows[:, -1], kind="stable"), -(-len(y) // 64)):
        part = gradient(narrow, trimmed(windows[some]), y[some], weights[some])
        slope = {k: slope[k] + part[k] for k in slope}
    # No portion, however odd, moves the network far.
    length = sum(float((g * g).sum()) for g in slope.values()) ** 0.5
    for k, g in slope.items():
        net[k] = net[k] - RATE * g / max(1.0, length)
    return [int((~odd).sum()), int(odd.sum()), len(found)]


def learn(documents: DataFrame, network: Network, many: list[int]) -> Network:
    """The network after each task has taken it through all its texts, averaged by the tokens in them."""
    shapes = {k: np.shape(v) or (1,) for k, v in ((k, getattr(network, k)) for k in ARRAYS)}
    sizes = [int(np.prod(shape)) for shape in shapes.values()]
    made = made_secrets(MADE)  # once, for all tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = {k: np.array(getattr(network, k), dtype=np.float64).reshape(shape) for k, shape in shapes.items()}
        seen = np.zeros(3, dtype=np.int64)
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            for begin, end in portions(texts):
                rng = np.random.default_rng(zlib.crc32(texts[begin]))
                seen += step(net, texts[begin:end], many, made, rng)
        if seen.any():
            flat = np.concatenate([net[k].ravel() for k in ARRAYS])
            columns = [np.arange(len(flat)), flat, *(np.full(len(flat), n) for n in seen)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "value", "plain", "odd", "found"])

    learnt = documents.select(F.col("text").cast("binary")).mapInArrow(run, "at long, value double, plain long, odd long, found long")
    tokens = F.col("plain") + F.col("odd")
    averaged = learnt.groupBy("at").agg(
        (F.sum(F.col("value") * tokens) / F.sum(tokens)).alias("value"), *[F.sum(c).alias(c) for c in ("plain", "odd", "found")]
    )
    rows = averaged.orderBy("at").collect()  # one row for each number of the network
    if not rows:
        return network
    parts = np.split(np.array([r["value"] for r in rows]), np.cumsum(sizes)[:-1])
    net = {k: part.reshape(shape) for (k, shape), part in zip(shapes.items(), parts)}
    seen = tuple(rows[0][c] for c in ("plain", "odd", "found"))
    return replace(network, **net | {"out_bias": float(net["out_bias"][0])}, seen=seen)


def threshold(findings: DataFrame, network: Network, places: list[bytes]) -> Network:
    """The network with the highest cut that keeps ``RECALL`` of all findings that were kept out, and of as many made secrets as weigh the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = [w if zlib.crc32(w) // HELD_OUT % 2 else moved(w, places[zlib.crc32(w) % len(places)]) for w in batch.column(0).to_pylist()]
            if windows:
                marks, n = np.unique(np.floor(network.margin(encode(windows)) * MARKS).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array(n)], ["mark", "n"])

    counted = findings.select("windows").mapInArrow(run, "mark long, n long").groupBy("mark").agg(F.sum("n").alias("n"))
    weights = {r["mark"]: float(r["n"]) for r in counted.collect()}
    total, made = sum(weights.values()), made_secrets(MADE // HELD_OUT, seed=19)
    shown = [moved(window_of(v, 0, len(v)), places[i % len(places)]) for i, v in enumerate(made)]
    for mark in np.floor(network.margin(encode(shown)) * MARKS).astype(np.int64).tolist():
        weights[mark] = weights.get(mark, 0.0) + max(1.0, total / len(made))
    left = (1 - RECALL) * sum(weights.values())
    for mark in sorted(weights):
        left -= weights[mark]
        if left < 0:
            break
    return replace(network, cut=float(sigmoid(network.slope * mark / MARKS + network.offset)))


def fit_network(documents: DataFrame, start: int = TRAIN_FINDINGS) -> Network | None:
    """First weights from a sample of ``start`` findings, plain and odd tokens each; then all tokens, findings and kept-out findings."""
    gathered = _gather(documents, start)
    many = [0, 0, 0]
    for r in gathered.where(F.col("kind") == 4).collect():
        many[int(r["windows"])] = r["n"]
    sample: list[list[bytes]] = []
    for kind in range(3):
        least = gathered.where(F.col("kind") == kind).orderBy(F.xxhash64("windows"), "windows").limit(start)
        sample.append([bytes(r["windows"]) for r in written(least, "sample").orderBy(F.xxhash64("windows"), "windows").collect()])
    places = sample[0] + sample[1]
    network = train(*training_sample(sample[2], places))
    if network is None:
        return None
    return threshold(gathered.where(F.col("kind") == 3), learn(documents, network, many), places)


def _points(text: bytes, spans: list[Span]) -> list[tuple[int, int, str]]:
    """Byte offsets as code points, in one pass over the text up to the last span."""
    marks = sorted({x for s in spans for x in s[:2]})
    place, at, points = {}, 0, 0
    for mark in marks:
        points += len(text[at:mark].decode("utf-8", "replace"))
        place[mark], at = points, mark
    return [(place[s], place[e], KINDS[k]) for s, e, k in spans]


def scan(texts: list[bytes | None], network: Network | None) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, in code points, by start and kind."""
    texts = [t or b"" for t in texts]
    spans = [base_spans(t) for t in texts]
    bases = [list(s) for s in spans]
    for found, text, base in zip(spans, texts, bases):
        found += wider_tokens(text, base)
    for begin, end in portions(texts) if network else ():
        free = Texts(texts[begin:end], bases[begin:end])
        for k in np.flatnonzero(network.score_tokens(free) >= network.cut):
            i = int(np.searchsorted(free.begin, free.start[k], side="right")) - 1
            spans[begin + i].append((int(free.start[k] - free.begin[i]), int(free.end[k] - free.begin[i]), 3))
    out = [_points(t, sorted(s, key=lambda s: (s[0], s[2]))) if s else [] for t, s in zip(texts, spans)]
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


FIELDS = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def find_secrets(documents: DataFrame, network: Network | None, keep: list[str] | None = None) -> DataFrame:
    """``row`` and, for each document, counts of the base kinds, a digest of their spans, and all spans."""

    def run(texts):
        rows = []
        for spans in scan(texts, network):
            base = [s for s in spans if s[2] != "model"]
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append([*(sum(s[2] == kind for s in base) for kind in KINDS[:3]), digest, _joined(spans)])
        return list(zip(*rows))

    return annotate(documents, "text", run, FIELDS, keep)


def scan_documents(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(documents, fit_network(documents), ["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), *[f.name for f in FIELDS])


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by ``[secret]``; n_chars follows where it is a column."""
    network = fit_network(documents)

    def run(texts):
        clean = []
        for text, spans in zip(texts, scan(texts, network)):
            if text is None or not spans:
                clean.append(None if text is None else text.decode("utf-8", "replace"))
                continue
            whole, parts, at = text.decode("utf-8", "replace"), [], 0
            for start, end, _ in spans:
                if start >= at:
                    parts += [whole[at:start], "[secret]"]
                at = max(at, end)
            clean.append("".join([*parts, whole[at:]]))
        return [clean]

    done = annotate(documents, "text", run, [T.StructField("clean", T.StringType())])
    columns = []
    for name, kind in documents.dtypes:
        column = F.col("row").getField(name)
        if name == "text":
            column = F.col("clean")
        elif name == "n_chars":
            column = F.when(column.isNotNull(), F.char_length("clean")).cast(kind)
        columns.append(column.alias(name))
    return done.select(*columns)

