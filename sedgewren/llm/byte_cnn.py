"""Quality by a byte-level convolutional network, written in numpy.

Bytes are embedded (a learned table of 256 rows), learned filters slide over overlapping chunks of the whole text
(WIDTH bytes, every STRIDE bytes), each filter's rectified response is max-pooled over the text, and a small dense layer
combines the pooled responses into one probability. Trained by Adam on a bounded sample of labelled rows.

Defined results: null and empty texts are scored as one chunk of padding; without labelled rows of both classes the
score is the share of label 1 (0.5 without rows). Repeated rows are scored each by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.llm.common import fold, labelled_sample, map_columns
from sedgewren.session import table

WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 16, 4, 4, 32, 16
#: Labelled rows a class that the network is fitted on, at most.
PER_CLASS = 1200
#: Passes over the sample, and updates at least (small samples get more passes).
EPOCHS, UPDATES = 6, 900
#: Bytes of text that a pass handles at once; longer texts are pooled piece by piece.
PIECE = 1 << 18


@dataclass
class Net:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float | None = None

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.w1, self.b1, self.w2, self.b2]

    @staticmethod
    def fresh(seed: int) -> Net:
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return Net(
            f(257, EMBED, scale=0.5), f(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5), np.zeros(FILTERS, np.float32),
            f(FILTERS, HIDDEN, scale=FILTERS**-0.5), np.zeros(HIDDEN, np.float32), f(HIDDEN, scale=HIDDEN**-0.5), np.zeros(1, np.float32),
        )

    def pooled(self, tokens: np.ndarray) -> np.ndarray:
        """The largest response of each filter over all chunks of one text."""
        best = np.zeros(FILTERS, np.float32)
        step = PIECE // STRIDE * STRIDE
        for at in range(0, len(tokens) - WIDTH + 1, step):
            part = tokens[at : at + step + WIDTH - STRIDE]
            if len(part) >= WIDTH:
                np.maximum(best, (chunks(self.embed[part]) @ self.filters).max(axis=0) + self.bias, out=best)
        return best

    def head(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled @ self.w1 + self.b1, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -30, 30)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return self.head(np.stack([self.pooled(tokens_of(t)) for t in texts])).astype(np.float64)


def tokens_of(text: str | None) -> np.ndarray:
    """Bytes of the text, padded by 256 so that overlapping chunks cover all of it."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(WIDTH, WIDTH + -(-max(0, len(raw) - WIDTH) // STRIDE) * STRIDE)
    out = np.full(n, 256, np.int32)
    out[: len(raw)] = raw
    return out


def chunks(embedded: np.ndarray) -> np.ndarray:
    """Overlapping chunks of embedded bytes, one a row."""
    flat = np.ascontiguousarray(embedded).reshape(-1)
    n = (len(embedded) - WIDTH) // STRIDE + 1
    view = np.lib.stride_tricks.as_strided(flat, (n, WIDTH * EMBED), (flat.strides[0] * STRIDE * EMBED, flat.strides[0]))
    return np.ascontiguousarray(view)


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7, batch: int = 16, rate: float = 0.004) -> Net:
    """Adam on the log loss, in which both classes weigh alike."""
    net = Net.fresh(seed)
    ones = sum(y for _, y in rows)
    if ones in (0, len(rows)):
        net.prior = ones / len(rows) if rows else 0.5
        return net
    data = [(tokens_of(t), y) for t, y in rows]
    weights = np.array([len(rows) / (2 * (len(rows) - ones)), len(rows) / (2 * ones)], np.float32)
    epochs = max(epochs, -(-UPDATES * batch // len(rows)))
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    rng, t = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        lr = rate * (1 - 0.9 * epoch / max(1, epochs - 1))
        for at in range(0, len(order), batch):
            grads = [np.zeros_like(p) for p in net.params()]
            some = order[at : at + batch]
            pooled, tops = [], []
            for i in some:
                response = chunks(net.embed[data[i][0]]) @ net.filters + net.bias
                tops.append(response.argmax(axis=0))
                pooled.append(response.max(axis=0))
            raw = np.stack(pooled)
            x = np.maximum(raw, 0)
            pre = x @ net.w1 + net.b1
            hidden = np.maximum(pre, 0)
            y = np.array([data[i][1] for i in some], np.float32)
            error = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30))) - y) * weights[y.astype(int)] / len(some)
            grads[5], grads[6] = hidden.T @ error, error.sum(keepdims=True)
            d_pre = np.outer(error, net.w2) * (pre > 0)
            grads[3], grads[4] = x.T @ d_pre, d_pre.sum(axis=0)
            d_x = (d_pre @ net.w1.T) * (raw > 0)
            for i, top, d in zip(some, tops, d_x, strict=True):
                tokens = data[i][0]
                at_bytes = top[:, None] * STRIDE + np.arange(WIDTH)
                seen = tokens[at_bytes]  # filters x width
                windows = net.embed[seen].reshape(FILTERS, -1)
                grads[1] += (windows * d[:, None]).T
                grads[2] += d
                np.add.at(grads[0], seen.reshape(-1), (net.filters.T * d[:, None]).reshape(-1, EMBED))
            t += 1
            for p, g, mm, vv in zip(net.params(), grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= lr * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    return net


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row, in one pass without a shuffle."""

    def task():
        return lambda ids, texts: (ids, net.scores(texts))

    return map_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, "doc_id long, score double")


HELD_FOLD = (5, 0)
THRESHOLD = 0.3


def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", fold(F.col("doc_id"), HELD_FOLD[0]) != HELD_FOLD[1], PER_CLASS, salt=1)
    found = score(docs, fit(rows))
    return found.select(
        "doc_id", (fold(F.col("doc_id"), HELD_FOLD[0]) == HELD_FOLD[1]).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
