"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters slide over them in overlapping chunks that cover the whole document; each filter
is max-pooled in each chunk, the pooled chunks are averaged, and a logistic unit turns them into one probability. The
network is trained by the driver, with Adam, on at most about `n_rows` labelled documents chosen by a hash of the id;
each is read whole, in training as in scoring. Memory is bounded: long texts go through in pieces of chunks.

Filters step by two bytes, so a text of an odd number of bytes, or of fewer than a filter's width, is read with spaces
after it: no byte of it stays unread.

Null or empty text: no chunk, so the score is that of the bias alone. Null labels are left out; several labels of a
document count as the lowest; of several rows with a labelled doc_id one is learned from. Without labels of both kinds
every score is the share of good labels (0.5 without any). Rows are scored one by one, so repeated rows get the same score;
of columns that clash with a new one the new one stays. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, sampled, unit

EMBED, WIDTH, FILTERS, STRIDE = 6, 8, 16, 2
#: Bytes of a chunk, and how far apart chunks start; what two share is more than a filter's width.
CHUNK, STEP = 1024, 896
PIECE = 64  # chunks at a time


def padded(raw: np.ndarray) -> np.ndarray:
    """The bytes with spaces after them, up to a filter's width and to an even number, so that filters reach the last one."""
    more = max(WIDTH - len(raw), (len(raw) - WIDTH) % STRIDE)
    return np.r_[raw, np.full(more, 32, np.uint8)] if more else raw


class Network:
    def __init__(self, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 1 / np.sqrt(EMBED * WIDTH), (EMBED * WIDTH, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, FILTERS + 1).astype(np.float32)
        self.constant: float | None = None

    def windows(self, raw: np.ndarray) -> np.ndarray:
        """The embedded bytes under each position of the filters, a row each."""
        x = self.embed[raw]
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(-1), EMBED * WIDTH)[:: EMBED * STRIDE]
        return np.ascontiguousarray(view)

    def pooled(self, raw: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The filters' maxima over each chunk of padded bytes; with `where`, also the bytes at which they start."""
        best, at = [], []
        for a in range(0, max(1, len(raw) - (CHUNK - STEP)), STEP * PIECE):
            part = raw[a : a + STEP * (PIECE - 1) + CHUNK]
            y = self.windows(part) @ self.filters
            for c in range(0, max(1, len(part) - (CHUNK - STEP)), STEP):
                rows = y[c // STRIDE : max(c // STRIDE + 1, (c + CHUNK - WIDTH) // STRIDE + 1)]
                if where:
                    k = rows.argmax(axis=0)
                    best.append(rows[k, np.arange(FILTERS)])
                    at.append(a + c + k * STRIDE)
                else:
                    best.append(rows.max(axis=0))
        return np.stack(best) + self.shift, np.stack(at) if where else None

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        raw = np.frombuffer((text or "").encode(), np.uint8)
        z = float(self.out[-1])
        if len(raw):
            raw = padded(raw)
            z += float(np.maximum(self.pooled(raw)[0], 0).mean(axis=0) @ self.out[:-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.out]

    def gradients(self, raws: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
        grads = [np.zeros_like(p) for p in self.params()]
        span = np.arange(WIDTH)
        for raw, t in zip(raws, y, strict=True):
            best, at = self.pooled(raw, True)
            mean = np.maximum(best, 0).mean(axis=0)
            z = float(mean @ self.out[:-1] + self.out[-1])
            d = (1 / (1 + np.exp(-z)) - t) / len(y)
            grads[3][:-1] += d * mean
            grads[3][-1] += d
            dbest = (best > 0) * (d * self.out[:-1] / len(best))
            grads[2] += dbest.sum(axis=0)
            under = raw[at[:, :, None] + span]  # chunk, filter, offset
            w = dbest[:, :, None].astype(np.float32)
            seen = self.embed[under].reshape(*at.shape, WIDTH * EMBED)
            grads[1] += np.einsum("cf,cfk->kf", dbest, seen)
            back = (w * self.filters.T[None]).reshape(-1, EMBED)
            np.add.at(grads[0], under.reshape(-1), back)
        return grads


def fit(texts: list[str], good: list[int], epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 42) -> Network:
    net, y = Network(seed), np.array(good, dtype=np.float32)
    if len(set(good)) < 2:
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    keep = [i for i, t in enumerate(texts) if t]
    raws = [padded(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    rng, m, v, n = np.random.default_rng(seed), [0.0] * 4, [0.0] * 4, 0
    net.out[-1] = np.log(y.mean() / (1 - y.mean()))
    for epoch in range(epochs):
        order = rng.permutation(keep)
        for a in range(0, len(order), batch):
            rows, n = order[a : a + batch], n + 1
            now = rate * (0.3 if epoch >= epochs * 2 // 3 else 1.0)
            for k, (p, g) in enumerate(zip(net.params(), net.gradients([raws[i] for i in rows], y[rows]), strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p -= now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, n_rows: int = 2400, most_chars: int = 64_000_000) -> Network:
    """Learns from docs (doc_id, text) and labels (doc_id, quality); at most about n_rows rows of most_chars characters come to
    the driver, by a hash of the id."""
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("mark"))
    return fit(*sampled(docs, marks.filter(unit("doc_id") < min(1.0, n_rows / max(marks.count(), 1))), most_chars))


def score(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """docs (kept columns) with score, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make() -> Callable[[list], list[list]]:
        own = shared.value
        return lambda texts: [[own.score(t) for t in texts]]

    return map_text(docs, make, [T.StructField("score", T.DoubleType())], keep)
