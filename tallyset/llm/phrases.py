"""Repeated-phrase automata: removes the words of passages that recur anywhere.

A word is a run of anything but ASCII white space. A window is `width` consecutive words of one document; it recurs if
the same words also start at another place, in the same document or another. Every word that a recurring window covers
is removed; windows are judged on the input.

1. Anchors. Each window's anchor is the least hash of its `gram`-word runs, so equal windows have equal anchors. All
   documents' anchors are counted, combined before the shuffle. Those seen twice or more set bits in a bitmap of at most
   `most_bits` bits, which is all that is broadcast; a full bitmap costs work, never results.
2. Confirmation. Consecutive windows with one anchor are a stretch (32 windows at most). Stretches whose anchor may recur
   are counted by a 128-bit hash of their words: the windows of one that recurs recur. Where an anchor also has a stretch
   that does not, the windows of one copy of each of its stretches are counted singly: they go packed, a row a stretch; those
   that 64 bits show twice set bits in another bitmap, and what that lets through is counted by 96 bits. What recurs is told
   as a mask for each stretch, so copies cost a row for each stretch and shard.
3. Automata. Documents are dealt into shards of about `shard_bytes` by their id, with the confirmed stretches found there; a
   shard of over four times that (one doc_id, or none, for many rows) is dealt out again, its stretches with each part.
   A shard's confirmed passages (longest runs of confirmed windows, each text once) are compiled into Aho-Corasick
   automata of at most `automaton_chars` characters, and all its documents are streamed through each to locate every
   occurrence; what occurrences cover is removed.

A passage that many documents share is one row for each shard and costs no pairs; shards are cut by documents, so no
passage, however frequent, makes a task large.

Null text has no words: 0 words, nothing removed, the digest of the empty string. Repeated rows repeat each other. A null or
repeated doc_id is as good as any. Columns but doc_id and text are not read. No rows: no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, marked, small, staged

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Windows of a stretch, at most: the bits of its mask.
STRETCH = 32
_P, _Q, _R = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5  # odd, so they have inverses modulo 2**64
#: Shards that are dealt out again, at most: they are broadcast.
MOST_HOT = 1 << 20


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as they have been asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, b, dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Reader:
    """Word and window hashes of texts, by prefix sums."""

    def __init__(self, width: int, gram: int) -> None:
        self.width, self.gram, self.p, self.lanes = width, gram, Powers(_P), (Powers(_Q), Powers(_R))

    def words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end."""
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[raw]
        step = np.diff(inside)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def hashed(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each word."""
        up, down = self.p.of(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return mixed((sums[end] - sums[start]) * down[start])

    def summed(self, word: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums by which runs of words are hashed, and what each place is divided by. A lane is one 64-bit hash; the
        second is independent of the first."""
        up, down = self.lanes[lane].of(len(word) + 1)
        sums = np.zeros(len(word) + 1, np.uint64)
        np.cumsum((mixed(word ^ np.uint64(_R)) if lane else word) * up[: len(word)], out=sums[1:])
        return sums, down

    def anchors(self, word: np.ndarray, sums: np.ndarray, down: np.ndarray) -> np.ndarray:
        """The anchor of each window."""
        least, span, want = mixed(runs(sums, down, self.gram)), 1, self.width - self.gram + 1
        while span < want:
            more = min(span, want - span)
            least = np.minimum(least[: len(least) - more], least[more:])
            span += more
        return least

    def firsts(self, least: np.ndarray) -> np.ndarray:
        """The first window of each stretch."""
        new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        within = np.arange(len(least)) - np.repeat(new, np.diff(np.r_[new, len(least)]))
        return np.flatnonzero(within % STRETCH == 0)

    def windows(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The hash, of 64 bits, and the anchor of each window, if there is a window."""
        start, end = self.words(raw)
        if len(start) < self.width:
            return None
        word = self.hashed(raw, start, end)
        sums, down = self.summed(word, 0)
        return mixed(runs(sums, down, self.width) ^ np.uint64(_Q)), self.anchors(word, sums, down)

    def stretches(self, raw: np.ndarray, words: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...] | None:
        """For each stretch its first window, the two halves of the hash of its words and its anchor; and both lanes' sums, by
        which its windows are hashed. None if there is no window."""
        start, end = words or self.words(raw)
        if len(start) < self.width:
            return None
        word = self.hashed(raw, start, end)
        lanes = [self.summed(word, k) for k in (0, 1)]
        least = self.anchors(word, *lanes[0])
        first = self.firsts(least)
        last = np.r_[first[1:], len(least)] + self.width - 1  # the end of the stretch's words
        s, t = (mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)) for sums, down in lanes)
        return first, s, t, least, lanes


def runs(sums: np.ndarray, down: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words."""
    return (sums[k:] - sums[: len(sums) - k]) * down[: len(sums) - k]


def raw_of(texts: pa.Array) -> Iterator[np.ndarray]:
    for t in texts.cast(pa.binary()):
        yield np.frombuffer(t.as_py() or b"", dtype=np.uint8)


def anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(h, n): anchors of windows with how often they stand, a few of one batch at a time; an anchor whose windows repeat
    within a document counts twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(width, gram)
        for batch in batches:
            for part in small(batch, "text"):
                found, count = [], []
                for raw in raw_of(part.column(0)):
                    seen = reader.windows(raw)
                    if seen is None:
                        continue
                    w, least = seen
                    new = least[np.r_[True, least[1:] != least[:-1]]]
                    order = np.argsort(w, kind="stable")
                    again = np.unique(least[order[1:][w[order[1:]] == w[order[:-1]]]])
                    found += [new, again]
                    count += [np.ones(len(new), np.int64), np.full(len(again), 2, np.int64)]
                if found:
                    h, at = np.unique(np.concatenate(found), return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(at, np.concatenate(count)).astype(np.int64))], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long")


def stretches(docs: DataFrame, bits, n_parts: int, width: int, gram: int) -> DataFrame:
    """(part, ident, s, t, h, twin, n): the stretches whose anchor may recur, by shard and document. twin: whether one of its
    windows stands in it twice."""
    names = ["part", "ident", "s", "t", "h", "twin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(width, gram)
        for batch in batches:
            for rows in small(batch, "text"):
                cols: list[list[np.ndarray]] = [[] for _ in names]
                for raw, part, ident in zip(raw_of(rows.column(2)), rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    seen = reader.stretches(raw)
                    if seen is None:
                        continue
                    first, s, t, least, lanes = seen
                    at = np.flatnonzero(marked(bits.value, least[first]))
                    twin = twins(mixed(runs(*lanes[0], width) ^ np.uint64(_Q)), first)[at] if len(at) else np.zeros(0, bool)
                    for col, v in zip(cols, (np.full(len(at), part, np.int32), np.full(len(at), ident, np.int64), s[at].view(np.int64), t[at].view(np.int64), least[first][at].view(np.int64), twin), strict=True):
                        col.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=names)

    seen = docs.select(part_of(n_parts).alias("part"), ident_of().alias("ident"), "text").mapInArrow(run, "part int, ident long, s long, t long, h long, twin boolean")
    return seen.groupBy("s", "t", "part").agg(F.count("*").alias("n"), F.first("h").alias("h"), F.max("twin").alias("twin"), F.min("ident").alias("ident"))


def twins(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each stretch whether a window stands in it twice."""
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(w)]))
    order = np.lexsort((w, of))
    same = (w[order[1:]] == w[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    out = np.zeros(len(first), bool)
    out[of[order[1:]][same]] = True
    return out


def windows_of(docs: DataFrame, bits, width: int, gram: int, most_seen: int = 200_000) -> DataFrame:
    """(s, ident, ws, xs): the windows of the stretches that the bitmap of (stretch, document) names, packed: 64 bits of each
    hash in ws, 32 more in xs. A task leaves out most of the stretches that it has told already."""
    names = ["s", "ident", "ws", "xs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, told = Reader(width, gram), set()
        for batch in batches:
            for rows in small(batch, "text"):
                out: list[tuple[int, int, bytes, bytes]] = []
                for raw, ident in zip(raw_of(rows.column(1)), rows.column(0).to_pylist(), strict=True):
                    seen = reader.stretches(raw)
                    if seen is None:
                        continue
                    first, s, _, least, lanes = seen
                    keys = copy_key(s, ident)
                    on = [k for k in np.flatnonzero(marked(bits.value, keys)).tolist() if int(keys[k]) not in told]
                    if not on:
                        continue
                    told.update(keys[on].tolist())
                    if len(told) > most_seen:
                        told.clear()
                    w, x = (mixed(runs(*lane, width) ^ np.uint64(_Q)) for lane in lanes)
                    x, ends = (x >> np.uint64(32)).astype(np.uint32), np.r_[first[1:], len(least)]
                    out += [(s_, ident, w[a:b].tobytes(), x[a:b].tobytes()) for s_, a, b in zip(s[on].view(np.int64).tolist(), first[on].tolist(), ends[on].tolist(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    return docs.select(ident_of().alias("ident"), "text").mapInArrow(run, "s long, ident long, ws binary, xs binary")


def counted(packed: DataFrame) -> DataFrame:
    """(h, n): the first 64 bits of windows of packed (one, ws) with how often they stand, twice for a stretch that recurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in small(batch, "ws"):
                w = [np.frombuffer(b, np.uint64) for b in rows.column(1).to_pylist()]
                if w:
                    n = np.repeat(np.where(rows.column(0).to_numpy(zero_copy_only=False), 1, 2), [len(x) for x in w])
                    h, at = np.unique(np.concatenate(w), return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(at, n).astype(np.int64))], names=["h", "n"])

    return packed.select("one", "ws").mapInArrow(run, "h long, n long")


def unpacked(packed: DataFrame, bits) -> DataFrame:
    """(s, t, one, j, w, x): the windows of packed rows that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in small(batch, "ws"):
                w = [np.frombuffer(b, np.uint64) for b in rows.column(3).to_pylist()]
                if not w:
                    continue
                size = [len(x) for x in w]
                j, w = np.concatenate([np.arange(n) for n in size]), np.concatenate(w)
                x = np.concatenate([np.frombuffer(b, np.uint32) for b in rows.column(4).to_pylist()])
                on = marked(bits.value, w)
                each = pa.array(np.repeat(np.arange(len(size)), size)[on])
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c).take(each) for c in range(3)), pa.array(j[on].astype(np.int32)), pa.array(w[on].view(np.int64)), pa.array(x[on].astype(np.int64))], names=["s", "t", "one", "j", "w", "x"]
                )

    return packed.select("s", "t", "one", "ws", "xs").mapInArrow(run, "s long, t long, one boolean, j int, w long, x long")


def copy_key(stretch: np.ndarray, ident: int) -> np.ndarray:
    return mixed(stretch ^ np.uint64(ident & 0xFFFFFFFFFFFFFFFF))


def keyed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, ident = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(mixed(s ^ ident).view(np.int64))], names=["h"])

    return rows.select("s", "ident").mapInArrow(run, "h long")


def confirmed(docs: DataFrame, n_parts: int, width: int, gram: int, most_bits: int) -> DataFrame:
    """(part, s, t, mask): the stretches with windows that recur, for each shard that holds them; bit j of the mask is that of
    the stretch's window j."""
    context = docs.sparkSession.sparkContext
    often = staged(anchors(docs, width, gram).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
    bits = context.broadcast(bitmap(often, often.count(), most_bits))  # at most most_bits / 8 bytes
    rows = staged(stretches(docs, bits, n_parts, width, gram))
    texts = staged(rows.groupBy("s", "t").agg(F.sum("n").alias("n"), F.first("h").alias("h"), F.max("twin").alias("twin"), F.min("ident").alias("ident")))
    open_ = texts.groupBy("h").agg(F.min("n").alias("least"), F.count("*").alias("kinds"), F.max("twin").alias("twin")).filter("least = 1 and (kinds > 1 or twin)").select("h")
    single = staged(texts.join(open_, "h", "left_semi").select("s", "t", "ident", "n"))
    copies = context.broadcast(bitmap(keyed(single), single.count(), most_bits))
    # joined by s alone, so that the rows of a stretch meet and are not dealt again
    chosen = single.select("s", "t", F.col("ident").alias("whose"), (F.col("n") == 1).alias("one"))
    packed = windows_of(docs, copies, width, gram).join(chosen, "s").filter(F.col("ident").bitwiseXOR(F.col("whose")) == 0)
    packed = staged(packed.dropDuplicates(["s", "t"]).select("s", "t", "one", "ws", "xs"))
    twice = staged(counted(packed).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
    windows = staged(unpacked(packed, context.broadcast(bitmap(twice, twice.count(), most_bits))))
    recurs = windows.groupBy("w", "x").agg(F.sum(F.when(F.col("one"), 1).otherwise(2)).alias("n")).filter("n > 1").select("w", "x")
    some = windows.filter("one").join(recurs, ["w", "x"], "left_semi").groupBy("s", "t").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))
    masks = texts.filter("n > 1").select("s", "t", F.lit((1 << STRETCH) - 1).cast("long").alias("mask")).unionByName(some)
    return rows.select("part", "s", "t").join(masks, ["s", "t"]).select("part", "s", "t", "mask")


def ident_of() -> Column:
    return F.xxhash64(F.lit("ident"), "doc_id")


def part_of(n_parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(n_parts)).cast("int")


def hot_parts(docs: DataFrame, size: int, n_parts: int, shard_bytes: int) -> DataFrame:
    """(part, cuts): the shards of over four times shard_bytes, MOST_HOT of them at most, and in how many each is dealt."""
    by_part = docs.groupBy(part_of(n_parts).alias("part")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    large = by_part.filter(F.col("bytes") > max(4 * shard_bytes, size // MOST_HOT))
    return staged(large.select("part", F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("cuts")))


# ---- automata


def passages(reader: Reader, raws: list[np.ndarray], known: dict[tuple[int, int], int]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """The texts of the longest runs of recurring windows, each once; and each document's words. known: the masks of
    stretches by the two halves of their hash."""
    texts: dict[str, None] = {}
    words = []
    for raw in raws:
        start, end = reader.words(raw)
        words.append((start, end))
        seen = reader.stretches(raw, (start, end)) if known else None
        if seen is None:
            continue
        first, s, t, least, _ = seen
        masks = np.fromiter(map(known.get, zip(s.tolist(), t.tolist(), strict=True), itertools.repeat(0)), np.int64, len(s))
        size = np.diff(np.r_[first, len(least)])
        on = np.diff(np.r_[0, (np.repeat(masks, size) >> (np.arange(len(least)) - np.repeat(first, size)) & 1).astype(np.int8), 0])
        for a, b in zip(np.flatnonzero(on == 1).tolist(), np.flatnonzero(on == -1).tolist(), strict=True):
            texts[joined(raw, start, end, a, b - 1 + reader.width)] = None
    return list(texts), words


def joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray, a: int, b: int) -> str:
    """Words a to b of a text with a space before, between and after, a character for each byte."""
    if (start[a + 1 : b] - end[a : b - 1] == 1).all():  # as nearly always
        return f" {raw[start[a] : end[b - 1]].tobytes().translate(_ONE_SPACE).decode('latin-1')} "
    return f" {b' '.join(raw[s:e].tobytes() for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)).decode('latin-1')} "


_ONE_SPACE = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def located(texts: list[str], streams: list[str], most_chars: int) -> list[list[tuple[int, int]]]:
    """For each stream the spans (start, end in characters) of every occurrence of each text, by automata of at most
    most_chars characters (or one text)."""
    import ahocorasick

    out: list[list[tuple[int, int]]] = [[] for _ in streams]
    at = 0
    while at < len(texts):
        automaton, held = ahocorasick.Automaton(), 0
        while at < len(texts) and (not held or held + len(texts[at]) <= most_chars):
            automaton.add_word(texts[at], len(texts[at]))
            held += len(texts[at])
            at += 1
        automaton.make_automaton()
        for spans, stream in zip(out, streams, strict=True):
            spans += [(stop + 1 - n, stop + 1) for stop, n in automaton.iter(stream)]
        del automaton
    return out


def removed(n: int, begin: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n words the spans cover; begin: where each word starts in the stream."""
    change = np.zeros(n + 1, dtype=np.int64)
    if spans:
        s = np.array(spans)
        np.add.at(change, np.searchsorted(begin, s[:, 0]), 1)
        np.add.at(change, np.searchsorted(begin, s[:, 1] - 1), -1)
    return np.cumsum(change[:-1]) > 0


def strip(docs: DataFrame, width: int = 35, gram: int = 4, shard_bytes: int = 3_000_000, automaton_chars: int = 1_500_000, most_bits: int = 1 << 30) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs (doc_id, text): kept is what stays, joined by spaces."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    n_parts = max(1, -(-size // shard_bytes))
    known = confirmed(docs, n_parts, width, gram, most_bits)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        reader = Reader(width, gram)
        s, t = (right.column(c).to_numpy().view(np.uint64).tolist() for c in ("s", "t"))
        raws = list(raw_of(left.column("text").combine_chunks()))
        texts, words = passages(reader, raws, dict(zip(zip(s, t, strict=True), right.column("mask").to_pylist(), strict=True)))
        streams = [joined(raw, s, e, 0, len(s)) if len(s) >= width and texts else "" for raw, (s, e) in zip(raws, words, strict=True)]
        rows = []
        for raw, (start, end), spans in zip(raws, words, located(texts, streams, automaton_chars), strict=True):
            begin = np.r_[0, np.cumsum(end - start + 1)]
            gone = removed(len(start), begin, spans)
            kept = b" ".join(raw[s:e].tobytes() for s, e in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True))
            rows.append((len(start), int(gone.sum()), kept))
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64()), "kept": pa.array([r[2] for r in rows], pa.binary())})

    hot = F.broadcast(hot_parts(docs, size, n_parts, shard_bytes))  # MOST_HOT rows at most
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("cuts", F.lit(1))).cast("int")
    dealt = docs.select(part_of(n_parts).alias("part"), "doc_id", "text").join(hot, "part", "left").select("part", spread.alias("sub"), "doc_id", "text")
    known = known.join(hot, "part", "left").withColumn("sub", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1))).drop("cuts")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept binary"
    found = dealt.groupBy("part", "sub").cogroup(known.groupBy("part", "sub")).applyInArrow(run, schema)
    return found.withColumn("kept", F.col("kept").cast("string"))
