"""Language identification with error-correcting output codes.

Each learned language has a codeword of bits; for each bit a binary classifier over hashed byte n-grams (1 to 4 bytes,
ASCII lower-cased, square roots of counts, unit length) predicts on which side a text is. Decoding weighs the losses:
the language whose codeword has the least sum of logistic losses over the bits wins. A text is ambiguous if the second
codeword is nearly as near, or if the nearest one is far.

The classifiers are learned by the driver from at most about `per_language` labelled texts a language, of `most_chars`
characters in all, chosen by a hash of the text; every text is read whole, in prediction as in learning.

Null texts and texts without a letter: `und`, score 0, ambiguous. Null labels are left out of learning, and copies of a text
are learned from once. With one label all texts get it; with none all texts are `und`. Rows are judged one by one, so
repeated rows get the same answer; of columns that clash with a new one the new one stays. No rows: no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, staged, unit

DIM = 4096
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint32)
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()), T.StructField("distance", T.DoubleType())]


def features(text: str, dim: int = DIM, piece: int = 1 << 20) -> np.ndarray:
    """Square roots of the hashed counts of byte n-grams, at unit length; the text is read in pieces, all of it."""
    raw, counts = np.frombuffer(text.encode(), dtype=np.uint8), np.zeros(dim, dtype=np.float64)
    for at in range(0, len(raw), piece):
        b = _LOWER[raw[at : at + piece + 3]]
        n = min(piece, len(b))
        h = b
        for k in range(1, 5):
            if k > 1:
                h = h[:-1] * np.uint32(0x01000193) + b[k - 1 :]
            if not len(h):
                break
            mixed = h[:n] * np.uint32(0x9E3779B1)
            counts += np.bincount((mixed >> np.uint32(8)) % np.uint32(dim), minlength=dim)
    x = np.sqrt(counts)
    return (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)


def codewords(n: int, seed: int = 42) -> np.ndarray:
    """n codewords of +1 and -1: all useful columns for few languages, else the best of some random tables."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [(1, *c) for c in itertools.product((-1, 1), repeat=n - 1) if -1 in c]
        return np.array(cols).T
    rng, length = np.random.default_rng(seed), max(15, 3 * int(np.ceil(np.log2(n))) + 6)
    tables = [rng.choice([-1, 1], size=(n, length)) for _ in range(200)]
    return max(tables, key=lambda t: ((length - t @ t.T) // 2 + 10 * length * np.eye(n, dtype=int)).min())


def learn(texts: list[str], langs: list[str], rounds: int = 250) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, codewords and weights (the last row is the bias), by gradient descent with momentum on all bits at once."""
    names = sorted(set(langs))
    code = codewords(len(names))
    x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, DIM), np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    of = np.array([names.index(v) for v in langs], dtype=int)
    y = code[of].astype(np.float32) if names else np.zeros((0, 1), np.float32)
    share = np.bincount(of, minlength=len(names)) if names else np.zeros(0)
    w_row = (len(of) / (len(names) * share[of])).astype(np.float32)[:, None] if names else 0
    w, v = np.zeros((DIM + 1, code.shape[1]), np.float32), 0.0
    for _ in range(rounds if len(names) > 1 else 0):
        g = -(x.T @ (w_row * y / (1 + np.exp(y * (x @ w))))) / len(x) + 1e-5 * w
        v = 0.9 * v - 8.0 * g
        w = w + v
    return names, code, w


def decode(margins: np.ndarray, code: np.ndarray, far: float = 0.62, close: float = 0.15) -> tuple[int, float, bool, float]:
    """The codeword of least summed logistic loss; its share of the evidence; whether it is ambiguous; its mean loss."""
    loss = np.logaddexp(0.0, -code * margins).mean(axis=1)
    weight = np.exp(-(loss - loss.min()) * code.shape[1])
    best = int(loss.argmin())
    second = np.partition(loss, 1)[1] if len(loss) > 1 else np.inf
    return best, float(weight[best] / weight.sum()), bool(second - loss[best] < close or (len(loss) > 1 and loss[best] > far)), float(loss[best])


def train(labelled: DataFrame, per_language: int = 500, most_chars: int = 64_000_000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Learns from rows (text, lang): about per_language texts of each language at most, by a hash of the text and copies once,
    as far as all of them have most_chars characters, come to the driver."""
    known = labelled.filter("lang is not null and text is not null").select("lang", "text")
    counts = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    upto = counts.select("lang", (F.lit(float(per_language)) / F.col("n")).alias("upto"))
    rows = known.join(F.broadcast(upto), "lang").filter(unit("text") < F.col("upto")).select("lang", "text")  # a row a language is broadcast
    rows = staged(rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")))
    left, fits = most_chars, []
    for r in rows.select("lang", "h", F.length("text").alias("n")).orderBy("h", "lang").collect():
        if r.n <= left:
            left -= r.n
            fits.append((r.lang, r.h))
    some = labelled.sparkSession.createDataFrame(fits, "lang string, h long")
    found = sorted((r.lang, r.text) for r in rows.join(F.broadcast(some), ["lang", "h"], "left_semi").collect())
    return learn([t for _, t in found], [v for v, _ in found])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """docs (kept columns) with lang_pred, score, ambiguous and distance, from the text alone."""
    return map_text(docs, judge(docs, model), FIELDS, keep)


def judge(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> Callable[[], Callable[[list], list[list]]]:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred KB, whatever the input

    def make() -> Callable[[list], list[list]]:
        names, code, w = shared.value

        def one(text: str | None) -> tuple[str, float, bool, float]:
            if not names or not text or not any(map(str.isalpha, text)):
                return "und", 0.0, True, 9.0
            best, score, unsure, loss = decode(features(text) @ w[:-1] + w[-1], code)
            return names[best], score, unsure, loss

        return lambda texts: [list(c) for c in zip(*map(one, texts), strict=True)] if texts else [[], [], [], []]

    return make


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], far: float = 0.66, letters: int = 20) -> DataFrame:
    """The rows of docs that have a learned language. Those judged `und` go, and texts of this many letters or more whose nearest
    codeword is further than `far`: at log 2, or 0.69, the bits' classifiers say nothing. Of shorter texts a distance tells little,
    and where one language is learned, nothing."""

    def make() -> Callable[[list], list[list]]:
        of = judged()

        def known(texts: list[str | None]) -> list[list]:
            langs, _, _, distances = of(texts)
            return [[lang != "und" and (d <= far or one or sum(map(str.isalpha, t)) < letters) for t, lang, d in zip(texts, langs, distances, strict=True)]]

        return known

    judged, one = judge(docs, model), len(model[0]) < 2
    return map_text(docs, make, [T.StructField("known", T.BooleanType())], where=0)
