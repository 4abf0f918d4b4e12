"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters (lower-cased, runs of white space as one space) is contained in a document if a passage of
the document, so normalised, that starts and ends at word edges is within floor(m * rate) edits of it. A word edge is any
place but that between two letters or digits; scripts without spaces have edges everywhere. The item is split into budget
+ 1 pieces; at most budget edits leave one piece whole, so an Aho-Corasick pass over the document for all pieces misses
nothing. A piece hit is first widened: with pieces taken two by two, some pair with a whole piece has at most one edit (or
an odd last piece is whole), so its partner must fit with one edit; what is left is verified by Myers' bit-parallel
distance over the passage the item could cover, and what passes is held to the word edges.

Items are compiled in blocks of bounded size; a larger benchmark takes several passes, each over all documents, as a
stated query set against all rows. Driver and executors hold one block at a time; between blocks results are staged.

Null or empty text: no match. Null or blank items: left out. Items of under 1 / rate characters have no edits to spare and
match exactly. Equal items or rows are reported one by one. Empty tables: no matches. docs may have other columns, of any
name: contained() leaves them out, clean() keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, staged

MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget_of(m: int, rate: float) -> int:
    return int(m * rate)


def cut(item: str, n: int) -> list[tuple[int, int]]:
    """n pieces of nearly equal length, as (start, end)."""
    n = min(n, len(item))
    return [(len(item) * i // n, len(item) * (i + 1) // n) for i in range(n)]


def one_edit(want: str, have: str) -> bool:
    """Whether want is within one edit of some prefix of have."""
    if have.startswith(want):
        return True
    k, n = 0, min(len(want), len(have))
    while k < n and want[k] == have[k]:
        k += 1
    if len(want) - k <= 1:
        return True
    return have.startswith(want[k + 1 :], k + 1) or have.startswith(want[k:], k + 1) or have.startswith(want[k + 1 :], k)


def myers(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """The least edits between the item and any passage of text, and where the first such passage ends; (most + 1, -1) if more."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = most + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | x
        h_up = down | (full & ~(d0 | up))
        h_down = up & d0
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up = h_up << 1 & full
        h_down = h_down << 1 & full
        up = h_down | (full & ~(d0 | h_up))
        down = h_up & d0
        if score < best:
            best, at = score, j + 1
    return best, at


def edges(text: str) -> np.ndarray:
    """For each place of a text, from before its first to after its last character, whether it is a word edge."""
    inside = np.fromiter(map(joins, text), bool, len(text))
    return ~(np.r_[False, inside] & np.r_[inside, False])


# Ranges of scripts that are written without spaces between words.
UNSPACED = (("\u0e00", "\u0eff"), ("\u1000", "\u109f"), ("\u1780", "\u17ff"), ("\u2e80", "\ua4cf"), ("\uf900", "\ufaff"), ("\uff66", "\uff9f"), ("\U00020000", "\U0003ffff"))


def joins(c: str) -> bool:
    return c.isalnum() and (c < "\u0e00" or not any(a <= c <= b for a, b in UNSPACED))


def at_edges(item: str, text: str, low: int, high: int, most: int) -> tuple[int, int]:
    """The least edits between the item and any passage of text[low:high] from edge to edge, and where in text the first such
    passage ends; (most + 1, -1) if more. Row by row, with the row's insertions by a running minimum."""
    part, places = text[low:high], np.arange(high - low + 1)
    edge = edges(text[max(0, low - 1) : high + 1])[low > 0 :][: high - low + 1]
    first = np.where(edge, places, -(1 << 40))
    row = places - np.maximum.accumulate(first)  # a passage starts at an edge; what it has before the item is edits
    chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
    for c in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (chars != ord(c)))
        row = np.minimum.accumulate(new - places) + places
    row = np.where(edge, row, most + 1)
    at = int(row.argmin())
    return (int(row[at]), low + at) if row[at] <= most else (most + 1, -1)


class Items:
    """A block of items with the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int, int, int, int]]] = {}
        for ident, raw in items:
            text = normal(raw)
            if not text:
                continue
            k = budget_of(len(text), rate)
            pieces, masks = cut(text, k + 1), {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            n = len(self.items)
            self.items.append((ident, text, k, masks))
            for i, (a, b) in enumerate(pieces):
                j = i - 1 if i % 2 else i + 1
                other = pieces[j] if j < len(pieces) else (a, a)  # an odd last piece stands alone and is not widened
                found.setdefault(text[a:b], []).append((n, a, b, *other))
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def matches(self, raw: str | None) -> list[tuple[int, int, int]]:
        """(item_id, edits, end of the passage in the normalised text) of each item that the text contains."""
        text = normal(raw)
        if not text or not self.items:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            start = end + 1 - length
            for n, a, b, c, d in where:
                item = self.items[n][1]
                if c >= b:
                    fits = one_edit(item[c:d], text[end + 1 : end + 2 + d - c])
                else:
                    fits = one_edit(item[c:d][::-1], text[max(0, start - (d - c) - 1) : start][::-1])
                if fits:
                    k = self.items[n][2]
                    low = max(0, start - a - k)
                    windows.setdefault(n, []).append((low, start - a + len(item) + k))
        out = []
        for n, spans in windows.items():
            ident, item, k, masks = self.items[n]
            best = (k + 1, -1)
            spans.sort()
            at = 0
            while at < len(spans):
                low, high = spans[at]
                while at + 1 < len(spans) and spans[at + 1][0] <= high:
                    at += 1
                    high = max(high, spans[at][1])
                at += 1
                high = min(high, len(text))
                if myers(masks, len(item), text[low:high], k)[0] < best[0]:
                    best = min(best, at_edges(item, text, low, high, k), key=lambda x: x[0])
            if best[0] <= k:
                out.append((ident, *best))
        return sorted(out)


def blocks_of(benchmark: DataFrame, most_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of most_chars characters at most (an item larger than that is a block), one block at a time."""
    block: list[tuple[int, str]] = []
    held = 0
    for r in benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        if block and held + len(r.text) > most_chars:
            yield block
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += len(r.text)
    if block:
        yield block


def block_by_block(benchmark: DataFrame, most_chars: int, of: Callable[[list[tuple[int, str]]], DataFrame]) -> Iterator[DataFrame]:
    """What of() makes of each block: staged before the next block is read, if there is more than one."""
    blocks = blocks_of(benchmark, most_chars)
    now = next(blocks, None)
    more = next(blocks, None)
    if now is not None and more is None:
        yield of(now)
        return
    while now is not None:
        yield staged(of(now))
        now, more = more, next(blocks, None)


def matcher(items: list[tuple[int, str]], rate: float) -> Callable[[], Callable[[list], list[list]]]:
    def make() -> Callable[[list], list[list]]:
        block = Items(items, rate)
        return lambda texts: [[[{"item_id": i, "edits": e, "stop": s} for i, e, s in block.matches(t)] for t in texts]]

    return make


def contained(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, most_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, edits, stop) for each item that a document's text contains within its edit budget. stop is
    where the first best passage ends in the normalised text."""

    def of(items: list[tuple[int, str]]) -> DataFrame:
        found = map_text(docs.select("doc_id", "text"), matcher(items, rate), [T.StructField("found", MATCH)], ["doc_id"])
        return found.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")

    parts = list(block_by_block(benchmark, most_chars, of))
    if not parts:
        return docs.select("doc_id").limit(0).withColumns({"item_id": F.lit(0).cast("long"), "edits": F.lit(0), "stop": F.lit(0)})
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, most_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs that contain no item."""
    left = docs

    def of(items: list[tuple[int, str]]) -> DataFrame:
        found = matcher(items, rate)

        def make() -> Callable[[list], list[list]]:
            matches = found()
            return lambda texts: [[not m for m in matches(texts)[0]]]

        return map_text(left, make, [T.StructField("free", T.BooleanType())], where=0)

    for left in block_by_block(benchmark, most_chars, of):
        pass
    return left
