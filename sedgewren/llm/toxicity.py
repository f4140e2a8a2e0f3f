"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon (a short fixed list and weights learned from labelled rows for whole words and word
beginnings), nearness of hits to second-person words, capitals, punctuation, and the rate of lexicon words that show
only after undoing common obfuscation. Histogram trees are boosted on the log loss in numpy; isotonic regression on
out-of-fold scores maps them to probabilities, at the share of label 1 among all labelled rows that may be learned from.

Defined results: null, empty and wordless texts have all features 0 and get the score of such texts; without labelled
rows of both classes the score is the share of label 1 (0 without rows). Repeated rows are scored each by itself.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.llm.common import fold, labelled_sample, labelled_share, map_columns
from sedgewren.session import table

#: Insults any corpus is searched for, beside the learned words.
SEED = (
    "asshole", "bastard", "bitch", "clown", "disgusting", "dumb", "fool", "idiot", "imbecile", "loser",
    "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless",
)
#: Second-person words.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre tú ti usted ustedes vosotros".split())
#: Labelled rows a class that words, trees and calibration are fitted on, at most.
PER_CLASS = 2000
BEGINNINGS = (4, 5, 6)
MAX_LEARNED = 400
NEAR = 5
FEATURES = 14

_EDGE = bytes(c for c in range(128) if not chr(c).isalnum())
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _EDGE, bytes(range(97, 123)) + b" " * len(_EDGE))
#: Undoes look-alike characters; marks inside a word are dropped.
_LEET = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ013457@$!|", b"abcdefghijklmnopqrstuvwxyzoieastasii")
_MARKS = b"*._-~^'`"
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")


@dataclass
class Lexicon:
    """Weights of whole words and of word beginnings, as UTF-8."""

    words: dict[bytes, float] = field(default_factory=dict)
    beginnings: dict[bytes, float] = field(default_factory=dict)

    def weight(self, word: bytes) -> float:
        w = self.words.get(word, 0.0)
        if w:
            return w
        for n in BEGINNINGS:
            w = self.beginnings.get(word[:n], 0.0)
            if w:
                return w
        return 0.0

    @staticmethod
    def learn(rows: list[tuple[str, int]], least: int = 4, odds: float = 12.0) -> Lexicon:
        """Words and word beginnings that occur in at least `least` documents and are `odds` times likelier with label 1."""
        seen: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        starts: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        size = [1, 1]
        for text, y in rows:
            size[y] += 1
            found = set(plain_words(text))
            for w in found:
                seen[y][w] = seen[y].get(w, 0) + 1
            for b in {w[:n] for w in found for n in BEGINNINGS if len(w) >= n}:
                starts[y][b] = starts[y].get(b, 0) + 1
        def pick(counts):
            out = {}
            for w, c in counts[1].items():
                ratio = (c + 0.5) / size[1] / ((counts[0].get(w, 0) + 0.5) / size[0])
                if c >= least and ratio >= odds:
                    out[w] = math.log(ratio)
            return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:MAX_LEARNED])
        words = dict.fromkeys((s.encode() for s in SEED), math.log(odds))
        return Lexicon(words | pick(seen), pick(starts))


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def features(text: str | None, lex: Lexicon, memo: dict[bytes, float]) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_PLAIN).split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    try:
        weights = [memo[w] for w in words]
    except KeyError:
        if len(memo) > 200_000:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = lex.weight(w)
        weights = [memo[w] for w in words]
    at = [i for i, w in enumerate(weights) if w]
    hits = [weights[i] for i in at]
    near = sum(any(w.decode("utf-8", "replace") in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
    hidden = 0
    if any(c in raw for c in b"*013457@$!|._-"):
        undone = raw.translate(_LEET, _MARKS).split()
        hidden = max(0, sum(1 for w in undone if w.strip(b",;:?()[]\"") in lex.words) - sum(1 for w in words if w in lex.words))
    chars = len(text)
    capitals = len(_CAPITALS.findall(text))
    return [
        sum(hits) / n, len(hits) / n, math.log1p(sum(hits)), math.log1p(len(hits)), max(hits, default=0.0), float(len({words[i] for i in at})),
        near / n, float(near), capitals / chars, text.count("!") / n, text.count("?") / n,
        sum(text.count(c) for c in "#*$%&@") / n, math.log1p(hidden), hidden / n,
    ]


@dataclass
class Forest:
    """Boosted trees of fixed depth: per tree the split features and thresholds in heap order, and the leaves."""

    split: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(math.log2(self.leaf.shape[1]))
        for split, cut, leaf in zip(self.split, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, split[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Forest:
    """Newton boosting on the log loss with quantile-binned features."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    rate_1 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = math.log(rate_1 / (1 - rate_1))
    f = np.full(len(y), base)
    splits, points, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        split, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                here = node == k
                total_g, total_h = g[here].sum(), h[here].sum()
                best = (1e-6, 0, np.inf)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[here, j], g[here], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[here, j], h[here], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, float(c[i]))
                split[k], cut[k] = best[1], best[2]
            node = 2 * node + 1 + (x[np.arange(len(y)), split[node]] > cut[node])
        leaf = np.zeros(2**depth)
        for k in range(2**depth):
            here = node == k + 2**depth - 1
            leaf[k] = -rate * g[here].sum() / (h[here].sum() + ridge)
        f += leaf[node - (2**depth - 1)]
        splits.append(split), points.append(cut), leaves.append(leaf)
    return Forest(np.array(splits), np.array(points), np.array(leaves), base)


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a rising map from raw scores to rates."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of weighted labels, weight, first and last raw score
    for s, t, w in zip(raw[order], y[order], weight[order], strict=True):
        blocks.append([t * w, w, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2], top[3]]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([v for b in blocks for v in [(b[0] + 0.02) / (b[1] + 0.04)] * 2])
    return xs, np.maximum.accumulate(ys)


@dataclass
class Model:
    lexicon: Lexicon
    forest: Forest | None
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float = 0.0

    def scores(self, texts: list[str | None], memo: dict[bytes, float]) -> np.ndarray:
        if self.forest is None:
            return np.full(len(texts), self.prior)
        x = np.array([features(t, self.lexicon, memo) for t in texts])
        return np.interp(self.forest.raw(x), *self.knots)


def fit(rows: list[tuple[str, int]], share: float | None = None) -> Model:
    """Three folds: words and trees learned on two score the third; isotonic regression on all out-of-fold scores, the
    classes reweighted to `share` of label 1 (the share among the rows where it is None)."""
    y = np.array([v for _, v in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(Lexicon(), None, None, float(y.mean()) if len(y) else 0.0)
    out = np.zeros(len(y))
    part = np.arange(len(y)) % 3
    for k in range(3):
        inner = [r for r, p in zip(rows, part, strict=True) if p != k]
        if len({v for _, v in inner}) < 2:
            inner = rows
        lex, memo = Lexicon.learn(inner), {}
        x = np.array([features(t, lex, memo) for t, _ in rows])
        at = part != k if len(inner) != len(rows) else part >= 0
        out[part == k] = boost(x[at], y[at]).raw(x[part == k])
    share = y.mean() if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    lex, memo = Lexicon.learn(rows), {}
    forest = boost(np.array([features(t, lex, memo) for t, _ in rows]), y)
    return Model(lex, forest, isotonic(out, y, weight))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row, in one pass without a shuffle."""

    def task():
        memo: dict[bytes, float] = {}
        return lambda ids, texts: (ids, model.scores(texts, memo))

    return map_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, "doc_id long, score double")


HELD_FOLD = (3, 1)
THRESHOLD = 0.7


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels, keep = table(spark, sf_dir, "labels"), fold(F.col("doc_id"), HELD_FOLD[0]) != HELD_FOLD[1]
    rows = labelled_sample(docs, labels, "toxic", keep, PER_CLASS, salt=7)
    found = score(docs, fit(rows, labelled_share(labels, "toxic", keep)))
    return found.select(
        "doc_id", (fold(F.col("doc_id"), HELD_FOLD[0]) == HELD_FOLD[1]).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
