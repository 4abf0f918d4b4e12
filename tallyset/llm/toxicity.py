"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities of lexicon words, their count, how near they stand to words of the second person,
rates of capitals, punctuation and repeated signs, and rates of obfuscated spelling (digits or signs in the place of
letters, letters parted by dots or spaces, stretched letters). The lexicon has fixed words, and words and stems (first
letters of words) that labelled rows show to go with toxicity: the latter are learned from a bounded sample, and the trees
see each row with what the other folds have taught. Trees are boosted on the log loss over binned features; the score is
an isotonic regression of their margin, fitted on rows that the trees have not seen.

Null or empty text: all features 0, scored like any other. Null labels are left out; several labels of a document
count as the highest; of several rows with a labelled doc_id one is learned from. Without labels of both kinds every score
is the share of toxic labels (0 without labels). Rows are scored one by one, so repeated rows get the same score; of
columns that clash with a new one the new one stays. No rows: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, sampled, unit

# Insults and abuse in English, German, French and Spanish.
LEXICON = frozenset(
    """abuse asshole bastard bitch clown coward creep crap cretin damn degenerate disgusting dumb dumbass fool freak
    garbage hateful hideous idiot idiotic idiots ignorant imbecile jerk kill lame liar loser losers lunatic
    miserable moron moronic morons nasty parasite pathetic psycho retard rotten scum scumbag shit shut sick
    slut stupid suck sucks trash ugly useless vermin vile whore worthless wretched
    abschaum arschloch blöd blödmann depp dreck drecksau dumm dummkopf ekelhaft hure hurensohn idioten mistkerl müll
    scheiße schlampe schwachkopf schwein trottel versager wertlos widerlich
    abruti connard connasse cretine débile dégoûtant enculé imbécile merde minable nul ordure pathétique pute racaille
    raclure salaud salope stupide
    asqueroso basura cabrón cobarde escoria estúpido gilipollas idiota imbécil inútil mierda patético perdedor puta
    tonta""".split()
)
# Words of the second person.
SECOND = frozenset("you your yours yourself youre u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
# Signs that stand for letters.
LEET = str.maketrans("0134578@$!|+", "oieastbasilt")
#: How many first letters of a word are a stem.
STEMS = (4, 5, 6, 7)

_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_ODD = re.compile(r"(?<![^\s])(?=[^\s]*[^\W\d_])[\w@$!|+*.\-]*(?:[\d@$!|+*][^\W\d_]|[^\W\d_][\d@$|+*][^\W\d_])[\w@$!|+*.\-]*")
_PARTED = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-_* ][^\W\d_]){2,}(?![^\W_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_STRONG = re.compile(r"[!?]{2,}")
NAMES = ("lexicon_share", "lexicon_count", "lexicon_kinds", "learned_share", "learned_count", "near_second", "second_share", "capital_share", "shouted_words", "punctuation_share", "strong_marks", "odd_words", "odd_hits", "parted_hits", "stretched", "digit_share", "words_log")


class Words:
    """What labelled rows add to the lexicon, words and stems, and which of its words they drop."""

    def __init__(self, words: frozenset[str] = frozenset(), stems: frozenset[str] = frozenset(), dropped: frozenset[str] = frozenset()) -> None:
        self.words, self.stems, self.dropped = words, stems, dropped
        self.heads, self.lengths = frozenset(s[: STEMS[0]] for s in stems), sorted({len(s) for s in stems})

    def count(self, low: list[str]) -> int:
        """How many of these words are known, or start with a known stem."""
        found = 0 if self.words.isdisjoint(low) else sum(map(self.words.__contains__, low))
        if self.stems:
            k = STEMS[0]
            found += sum(1 for w in low if w[:k] in self.heads and w not in self.words and any(w[:n] in self.stems for n in self.lengths))
        return found


def features(text: str | None, learned: Words, near: int = 4) -> list[float]:
    """The dense features, by NAMES."""
    text = text or ""
    low = _WORDS.findall(text.lower())
    n, chars = max(len(low), 1), max(len(text), 1)
    hits = [] if LEXICON.isdisjoint(low) else [i for i, w in enumerate(low) if w in LEXICON and w not in learned.dropped]
    known = learned.count(low)
    second = [i for i, w in enumerate(low) if w in SECOND] if hits else []
    close = sum(1 for i in hits if second and min(abs(i - j) for j in near_of(second, i)) <= near)
    seconds = len(second) if hits else sum(map(SECOND.__contains__, low))
    of = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    capitals, digits = int(of[65:91].sum()), int(of[48:58].sum())
    letters = capitals + int(of[97:123].sum() + of[0xC3:].sum())
    signs = int(of[33:127].sum()) - digits - capitals - int(of[97:123].sum())
    odd = [m[0] for m in _ODD.finditer(text)] if _MARKS.search(text) else []
    odd_hits = sum(bool(LEXICON.intersection(_WORDS.findall(o.lower().translate(LEET)))) for o in odd)
    parted = sum(_JOINED.sub("", m[0]).lower() in LEXICON for m in _PARTED.finditer(text)) if _PARTED_MAYBE.search(text) else 0
    return [
        len(hits) / n, float(np.log1p(len(hits))), float(len({low[i] for i in hits})), known / n, float(np.log1p(known)), close / n, seconds / n, capitals / max(letters, 1),
        (len(_SHOUTED.findall(text)) if capitals > 2 else 0) / n, signs / chars, (len(_STRONG.findall(text)) if of[33] + of[63] > 1 else 0) / n, len(odd) / n, float(odd_hits), float(parted), len(_STRETCHED.findall(text)) / n,
        digits / chars, float(np.log1p(len(low))),
    ]


_SHOUTED = re.compile(r"(?<![^\W_])[A-Z]{3,}(?![^\W_])")
_JOINED = re.compile(r"[^\w]|_")
_MARKS = re.compile(r"[\d@$!|+*][^\W\d_]")
_PARTED_MAYBE = re.compile(r"(?<![^\W_])[^\W\d_][.\-_* ][^\W\d_][.\-_* ][^\W\d_](?![^\W_])")


def near_of(second: list[int], i: int) -> list[int]:
    from bisect import bisect_left

    at = bisect_left(second, i)
    return second[max(0, at - 1) : at + 1]


# ---- trees


class Trees:
    """Boosted trees on the log loss, grown level by level on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, leaf: int = 8) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.leaf = rounds, depth, rate, bins, leaf
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.r_[np.quantile(c, np.linspace(0, 1, self.bins)[1:-1]), np.unique(c)[:8]]) for c in x.T]
        b = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-margin))
            g, h = y - prob, prob * (1 - prob)
            node = np.zeros(len(y), dtype=int)
            tree: list[tuple[int, float]] = [(-1, 0.0)] * (2**self.depth - 1)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    tree[k], right = self.split(b[rows], g[rows], h[rows], edges)
                    node[rows] = 2 * k + 1 + right
            leaf = node - (2**self.depth - 1)
            value = np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1.0) * self.rate
            margin = margin + value[leaf]
            self.trees.append((np.array([f for f, _ in tree]), np.array([c for _, c in tree]), value))
        return self

    def split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[tuple[int, float], np.ndarray]:
        """The best (feature, cut) of a node's rows, right being above the cut; (-1, 0) if none pays."""
        best, at = 1e-6, (-1, 0.0)
        right = np.zeros(len(b), dtype=int)
        if len(b) >= 2 * self.leaf:
            total_g, total_h = g.sum(), h.sum()
            whole = total_g**2 / (total_h + 1.0)
            for f, e in enumerate(edges):
                n = np.bincount(b[:, f], minlength=len(e) + 1).cumsum()[:-1]
                lg, lh = np.bincount(b[:, f], g, len(e) + 1).cumsum()[:-1], np.bincount(b[:, f], h, len(e) + 1).cumsum()[:-1]
                gain = lg**2 / (lh + 1.0) + (total_g - lg) ** 2 / (total_h - lh + 1.0) - whole
                gain[(n < self.leaf) | (len(b) - n < self.leaf)] = -1
                k = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[k] > best:
                    best, at = float(gain[k]), (f, float(e[k]))
                    right = (b[:, f] > k).astype(int)
        return at, right

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, c, value in self.trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                here = f[node]
                node = 2 * node + 1 + ((here >= 0) & (x[np.arange(len(x)), here] > c[node]))
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The monotone regression of y on x, by pooling adjacent violators, as the points of a step function. Each end
    is drawn in by `prior` rows of the other kind, so no score is a certainty."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    blocks: list[list[float]] = []
    for v, t in zip(x, y, strict=True):
        blocks.append([t, 1.0, v, v])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = high
    mean = y.mean()
    knots = [(b[2 + k], (b[0] + prior * mean) / (b[1] + prior)) for b in blocks for k in (0, 1)]
    return np.array([k for k, _ in knots]), np.maximum.accumulate([v for _, v in knots])


class Model:
    """What is learned: the words, the trees and the calibration."""

    def __init__(self, words: Words, trees: Trees | None, knots: tuple[np.ndarray, np.ndarray] | None, share: float) -> None:
        self.words, self.trees, self.knots, self.share = words, trees, knots, share

    def score(self, texts: list[str | None]) -> list[float]:
        if self.trees is None:
            return [self.share] * len(texts)
        x = np.array([features(t, self.words) for t in texts]).reshape(len(texts), len(NAMES))
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0).tolist()


class Terms:
    """The words and stems (with a star) of texts, each text's once, by number; and which texts are no copies: those with most of
    their five-word runs new."""

    def __init__(self, texts: list[str]) -> None:
        self.number: dict[str, int] = {}
        self.of: list[np.ndarray] = []
        fresh, seen = [], set()
        for t in texts:
            low = _WORDS.findall(t.lower())
            runs = {hash(tuple(low[i : i + 5])) for i in range(max(1, len(low) - 4))}
            fresh.append(len(runs & seen) * 2 <= len(runs))
            seen |= runs
            kinds = set(low)
            kinds |= {f"{w[:k]}*" for w in kinds for k in STEMS if len(w) > k}
            self.of.append(np.fromiter((self.number.setdefault(w, len(self.number)) for w in kinds), np.int64, len(kinds)))
        self.fresh, self.names = np.array(fresh, dtype=bool), list(self.number)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """In how many of these texts each stands."""
        return np.bincount(np.concatenate([self.of[i] for i in rows]), minlength=len(self.names)) if len(rows) else np.zeros(len(self.names), np.int64)


def learn_words(terms: Terms, toxic: np.ndarray, rows: np.ndarray, most: int = 200, least: int = 6) -> Words:
    """Words and stems that go with toxicity among these rows: in `least` toxic texts or more, copies counting once, and over 30
    times as often as in others; a stem of which a shorter one is known adds nothing. And lexicon words that do not: as often in
    other texts."""
    rows = rows[terms.fresh[rows]]
    yes, no = terms.counts(rows[toxic[rows] == 1]), terms.counts(rows[toxic[rows] == 0])
    n_yes, n_no = 1 + int((toxic[rows] == 1).sum()), 1 + int((toxic[rows] == 0).sum())
    lift = (yes / n_yes) / ((no + 1) / n_no)
    found = [(terms.names[i], int(yes[i]), float(lift[i])) for i in np.flatnonzero((yes >= max(least, 0.01 * n_yes)) & (lift > 30))]
    good = sorted((x for x in found if len(x[0]) > 2), key=lambda x: (-x[1], -x[2], x[0]))[:most]
    stems: set[str] = set()
    for s in sorted((w[:-1] for w, *_ in good if w[-1] == "*"), key=lambda s: (len(s), s)):
        if not any(s[:k] in stems for k in STEMS):
            stems.add(s)
    at = {w: terms.number[w] for w in LEXICON if w in terms.number}
    dropped = frozenset(w for w, i in at.items() if no[i] >= 3 and no[i] / n_no > 0.2 * yes[i] / n_yes)
    return Words(frozenset(w for w, *_ in good if w[-1] != "*"), frozenset(stems), dropped)


def fit(texts: list[str], toxic: list[int], seed: int = 42, folds: int = 4) -> Model:
    y = np.array(toxic)
    if len(set(toxic)) < 2 or min(y.sum(), len(y) - y.sum()) < 4:
        return Model(Words(), None, None, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    fold, held = rng.integers(0, folds, len(y)), rng.random(len(y)) < 0.3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), dtype=bool)
    x, terms = np.zeros((len(y), len(NAMES))), Terms(texts)
    for k in range(folds):
        words = learn_words(terms, y, np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            x[i] = features(texts[i], words)
    trees = Trees().fit(x[~held], y[~held])
    part = held if held.any() else ~held
    return Model(learn_words(terms, y, np.arange(len(y))), trees, isotonic(trees.margin(x[part]), y[part]), float(y.mean()))


def train(docs: DataFrame, labels: DataFrame, n_rows: int = 6000, most_chars: int = 64_000_000) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic); at most about n_rows rows of most_chars characters, by a
    hash of the id, come to the driver, half of them toxic if there are so many."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("mark"))
    counts = {r.mark: r["count"] for r in marks.groupBy("mark").count().collect()}
    rate = F.when(F.col("mark") == 1, min(1.0, n_rows / 2 / max(counts.get(1, 0), 1))).otherwise(min(1.0, n_rows / 2 / max(counts.get(0, 0), 1)))
    return fit(*sampled(docs, marks.filter(unit("doc_id") < rate), most_chars))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (kept columns) with score, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], list[list]]:
        m = shared.value
        return lambda texts: [m.score(texts)]

    return map_text(docs, make, [T.StructField("score", T.DoubleType())], keep)
