"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits: bit i is set if it is set in over half of the XXH64 values (seed 42) of its 4-word
shingles, repeats included, after A-Z is lower-cased. Documents link if their fingerprints differ in at most
`threshold` bits; a component is what links connect. keep_one() takes sets of 5-word shingles, and more bits: see there.

Equal fingerprints are one node from the start, so copies cost a row and not their pairs. Correlated bits are put
into one partition (greedily, by the correlation over all fingerprints); a partition p with threshold t_p finds pairs
that differ there in at most t_p bits, and thresholds that add up to threshold - partitions + 1 lose no pair. The
number of partitions and their thresholds come from dynamic programming on estimated candidate counts: the exact
number of pairs that agree in a partition, scaled for more differing bits by the bits' frequencies. A row is sent to
its own value of each partition and to its variants within half of t_p bits, rounded up, so that two rows that differ in t_p
bits meet half-way. Buckets are verified block by block with numpy; a bucket gives back a spanning forest of its links, never
its pairs. A bucket of more than `block` rows is cut into blocks, and each pair of blocks is a task of its own, so no pair is
lost and no task has it whole. Rows go out in rounds, whose shuffle files are freed one by one. Links are then contracted by alternating stars, each round written to the shared folder.

Null or empty text: no shingles, fingerprint zero, linked like any other. Fewer than 4 words: the whole sequence is
the one shingle. Rows with equal doc_id and text are one document, rows with equal doc_id and other texts are not; a component
of rows without doc_id has no id. Columns but doc_id and text are not read; keep_one() keeps them, whatever their names. No
rows: no rows.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, fresh, map_text, marked, small, staged

BITS = 64


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    import xxhash

    words = lowered(text).split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n < 4:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        starts = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: n - 3].tolist(), (starts[4:] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed number."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lowered(text: str | None) -> bytes:
    return (text or "").encode().translate(_LOWER)


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (kept columns) with fp, the signed fingerprint of text."""
    return map_text(docs, lambda: lambda texts: [[fingerprint(t) for t in texts]], [T.StructField("fp", T.LongType())], keep)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of a signed number it would count the magnitude's bits


# ---- partitions and thresholds


def moments(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many fingerprints, in how many each bit is set, and in how many each pair of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pairs = 0, np.zeros((BITS, BITS), dtype=np.int64)
        for batch in batches:
            x = bits_of(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
            n, pairs = n + len(x), pairs + np.rint(x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pairs.ravel().tolist()], pa.list_(pa.int64()))], names=["n", "pairs"])

    parts = fps.select("fp").mapInArrow(run, "n long, pairs array<long>")
    cells = parts.select("n", F.posexplode("pairs").alias("i", "c")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()
    pairs, n = np.zeros(BITS * BITS, dtype=np.int64), 0
    for r in cells:
        pairs[r.i], n = r.c, r.n
    pairs = pairs.reshape(BITS, BITS)
    return n, np.diag(pairs).copy(), pairs


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), bitorder="little").reshape(len(fps), BITS)


def group_bits(n: int, ones: np.ndarray, pairs: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size; each starts with a free bit and takes those most correlated with it."""
    p = ones / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((pairs / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, out = set(range(BITS)), []
    for k in range(m):
        size = BITS * (k + 1) // m - BITS * k // m
        part = [min(free)]
        free.discard(part[0])
        while len(part) < size:
            best = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            free.discard(best)
        out.append(sorted(part))
    return out


def agreements(fps: DataFrame, options: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """Exactly how many pairs agree in each partition of each option, over all fingerprints."""
    parts = [(m, k, bits) for m, groups in options.items() for k, bits in enumerate(groups)]
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(signed(mask(bits))).alias("v")) for m, k, bits in parts])).alias("x"))
    counts = keyed.groupBy("x.m", "x.k", "x.v").count()
    rows = counts.groupBy("m", "k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()
    return {(r.m, r.k): float(r.pairs) for r in rows}


def within(p: np.ndarray, most: int) -> list[float]:
    """Chance that two random values of independent bits with these frequencies differ in at most 0, 1, ... bits."""
    at = np.zeros(most + 1)
    at[0] = 1.0
    for differ in 2 * p * (1 - p):
        at[1:] = at[1:] * (1 - differ) + at[:-1] * differ
        at[0] *= 1 - differ
    return list(np.cumsum(at))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The thresholds, from -1 on, that add up to total at the least cost. costs[k][t + 1]: of threshold t in k."""
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, chosen) in best.items():
            for i, c in enumerate(row):
                to = have + i - 1
                if to not in step or cost + c < step[to][0]:
                    step[to] = (cost + c, [*chosen, i - 1])
        best = step
    return best.get(total, (math.inf, []))


def choose(n: int, ones: np.ndarray, agree: dict[tuple[int, int], float], options: dict[int, list[list[int]]], threshold: int, row_cost: float = 40.0) -> tuple[list[list[int]], list[int]]:
    """The partitions and thresholds of least estimated cost: verified pairs, and row_cost for each row sent."""
    p, found = ones / max(n, 1), []
    for m, groups in options.items():
        costs = []
        for k, bits in enumerate(groups):
            near, row = within(p[bits], threshold), [0.0]
            for t in range(threshold + 1):
                variants = sum(math.comb(len(bits), d) for d in range((t + 1) // 2 + 1))
                pairs = max(agree.get((m, k), 0.0), 1.0) * min(near[t] / max(near[0], 1e-300), n)
                row.append(pairs + row_cost * max(n, 1) * (1 + (variants if t else 0)))  # variants cost even if there are no rows
            costs.append(row)
        cost, taus = allocate(costs, threshold - m + 1)
        found.append((cost, m, groups, taus))
    _, _, groups, taus = min(found, key=lambda x: x[:2])
    return [g for g, t in zip(groups, taus, strict=True) if t >= 0], [t for t in taus if t >= 0]


def mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flips(bits: list[int], n: int) -> list[int]:
    """The signed masks that flip n of these bits."""
    return [signed(mask(list(c))) for c in itertools.combinations(bits, n)]


# ---- candidates and links


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ: words along the last axis."""
    out = popcount(x[..., 0] ^ y[..., 0]).astype(np.uint16)
    for w in range(1, x.shape[-1]):
        out += popcount(x[..., w] ^ y[..., w])
    return out


def spanning(edges: np.ndarray) -> np.ndarray:
    """Rows of edges (a, b, bits) that form a spanning forest of them, of the fewest bits: in each round each tree takes its
    first edge to another."""
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0], edges[:, 2]))]
    ids, at = np.unique(edges[:, :2], return_inverse=True)
    ends, label, kept, live = at.reshape(-1, 2), np.arange(len(ids)), [], np.arange(len(edges))
    while len(live):
        pair = label[ends[live]]
        apart = pair[:, 0] != pair[:, 1]
        live, pair = live[apart], pair[apart]
        if len(live):
            first, label = step(label, pair)
            kept.append(live[first])
    return edges[np.sort(np.concatenate(kept))] if kept else edges[:0]


def step(label: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first edge of each tree among edges (pairs of trees, in order), and the labels after all trees have joined by them;
    the only circles are of two that chose each other."""
    earliest = np.full(len(label), len(pair))
    np.minimum.at(earliest, pair.ravel(), np.repeat(np.arange(len(pair)), 2))
    trees = np.flatnonzero(earliest < len(pair))
    first = earliest[trees]
    to, up = pair[first].sum(axis=1) - trees, np.arange(len(label))
    up[trees] = to
    mutual = trees[(up[to] == trees) & (trees < to)]
    up[mutual] = mutual
    while (up[up] != up).any():
        up = up[up]
    return np.unique(first), up[label]


def forest(a: np.ndarray, b: np.ndarray | None, threshold: int, tile: int = 1024) -> list[tuple[int, int, int]]:
    """Positions in a (and b, shifted by len(a)), and bits, that form a spanning forest of the fewest bits of the links within a,
    or between a and b: that of all tiles' forests. A row has a fingerprint's words."""
    both = a if b is None else np.concatenate([a, b])
    edges: list[np.ndarray] = []
    starts = [(i, j) for i in range(0, len(a), tile) for j in (range(i, len(a), tile) if b is None else range(len(a), len(both), tile))]
    for i, j in starts:
        x, y = both[i : min(i + tile, len(a))], both[j : j + tile]
        own = i == j and b is None
        links = few_links(x, y, threshold, 4 * tile)
        if links is None:
            bits = distance(x[:, None], y[None, :])
            bits[bits > threshold] = FAR
            if own:
                np.fill_diagonal(bits, FAR)
            links = np.array(tile_forest(bits, np.arange(len(x)), np.arange(len(y)) + (0 if own else len(x))), dtype=np.int64).reshape(-1, 3)
        elif own:
            links = links[links[:, 0] < links[:, 1]]
        edges.append(links + (i, j, 0))
    return spanning(np.concatenate(edges)).tolist() if edges else []


def few_links(x: np.ndarray, y: np.ndarray, threshold: int, most: int) -> np.ndarray | None:
    """All links (row of x, row of y, bits), unless they are more than `most`: two words tell most pairs apart, the others by all."""
    bits = popcount(x[:, None, 0] ^ y[None, :, 0])
    if x.shape[1] > 1:
        bits += popcount(x[:, None, 1] ^ y[None, :, 1])
    close = bits <= threshold
    if np.count_nonzero(close) > max(most, bits.size // 16):
        return None
    r, c = np.nonzero(close)
    d = bits[r, c].astype(np.int64)
    if x.shape[1] > 2:
        d += distance(x[r, 2:], y[c, 2:])
    on = d <= threshold
    return np.column_stack([r, c, d])[on] if np.count_nonzero(on) <= most else None


#: More than any distance.
FAR = 60000


def tile_forest(bits: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int, int]]:
    """The spanning forest of the fewest bits of a matrix of distances; rows, columns: their numbers, less than both lengths."""
    label, out = np.arange(max(rows.max(), columns.max()) + 1), []
    while True:
        r, c = np.arange(len(rows)), bits.argmin(axis=1)
        r2, c2 = bits.argmin(axis=0), np.arange(len(columns))
        found = np.column_stack([np.r_[r, r2], np.r_[c, c2]])
        d = bits[found[:, 0], found[:, 1]].astype(np.int64)
        found, d = found[d < FAR], d[d < FAR]
        if not len(found):
            return out
        order = np.lexsort((columns[found[:, 1]] + rows[found[:, 0]], np.maximum(columns[found[:, 1]], rows[found[:, 0]]), d))
        found, d = found[order], d[order]
        first, label = step(label, np.column_stack([label[rows[found[:, 0]]], label[columns[found[:, 1]]]]))
        out += np.column_stack([found, d])[first].tolist()
        bits[label[rows][:, None] == label[columns][None, :]] = FAR


def links(nodes: DataFrame, threshold: int, block: int = 8192, max_parts: int = 5, within: int | None = None, at_once: int = 28, least: int = 1 << 20) -> DataFrame:
    """nodes (fp, id; id distinct) -> edges (a, b) of ids that connect all nodes within threshold bits. More columns are more
    words of the fingerprint: the nodes so found link if they differ in at most `within` bits of all words. Of a bucket's links
    come those of a spanning forest of the fewest bits.

    Rows go out in rounds of about `at_once` for each node (or `least` in all); a round's links are written to the shared
    folder and its shuffle files freed before the next, so the disk in use does not follow the rows that go out in all."""
    words = [c for c in nodes.columns if c not in ("fp", "id")]
    limit = threshold if within is None else within
    n, ones, pairs = moments(nodes)
    options = {m: group_bits(n, ones, pairs, m) for m in range(2, min(max_parts, threshold + 1) + 1)}
    groups, taus = choose(n, ones, agreements(nodes, options), options, threshold)
    value = [F.col("fp").bitwiseAND(signed(mask(bits))).alias("v") for bits in groups]
    masks = [[x for d in range((tau + 1) // 2 + 1) for x in flips(bits, d)] for bits, tau in zip(groups, taus, strict=True)]

    def to(k: int) -> Column:
        return F.transform(F.lit(masks[k]), lambda x: x.bitwiseXOR(F.col("v")))

    # buckets larger than a block are cut by a hash, and their pairs of blocks are dealt out
    counts = [nodes.groupBy(v).count().select(F.lit(k).alias("k"), F.explode(to(k)).alias("v"), "count") for k, v in enumerate(value)]
    large = staged(functools.reduce(DataFrame.unionByName, counts).groupBy("k", "v").agg(F.sum("count").alias("n")).filter(F.col("n") > block).withColumn("cuts", F.ceil(F.col("n") / block).cast("int")))
    more = {r.k: (r.n, r.rows) for r in large.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("n") * (F.col("cuts") - 1)).alias("rows")).collect()}
    n_rows = [n * len(masks[k]) + more.get(k, (0, 0))[1] for k in range(len(groups))]
    cuts = large.select("k", "v", "cuts")
    if sum(x for x, _ in more.values()) <= MOST_CUTS:
        cuts = F.broadcast(cuts)

    def sent(k: int, part: int, parts: int) -> DataFrame:
        """The rows of partition k that go out in this of its parts."""
        half, tau = (taus[k] + 1) // 2, taus[k]
        inner = len(masks[k]) - (math.comb(len(groups[k]), half) if tau % 2 else 0)  # of an odd threshold, two rows that are both half-way need not be compared
        rows = nodes.select(value[k], "fp", "id", *words).select(F.lit(k).alias("k"), F.posexplode(to(k)).alias("at", "v"), "fp", "id", *words)
        rows = rows.withColumn("probe", (F.col("at") >= inner).cast("int"))
        rows = rows.join(cuts, ["k", "v"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))) if k in more else rows.withColumn("cuts", F.lit(1))
        mine = F.pmod(F.xxhash64("fp", "probe"), "cuts").cast("int")
        rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        rows = rows.select("k", "v", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "probe", "fp", "id", *words)
        return rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("v", "x", "y"), F.lit(parts)) == part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            now = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in ("k", "v", "x", "y", "side", "probe", "id", "fp", *words)])
            held.append(now)
            table = np.concatenate(held) if len(held) > 1 else now
            last = (table[:, :4] != table[-1, :4]).any(axis=1)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            held = [table[cut:]]
            if cut:
                yield bucket_links(table[:cut], limit)
        if held and len(held[0]):
            yield bucket_links(held[0], limit)

    def found(parts: list[tuple[int, int, int]]) -> DataFrame:
        rows = functools.reduce(DataFrame.unionByName, [sent(*x) for x in parts])
        dealt = rows.repartition(F.col("k"), F.col("v"), F.col("x"), F.col("y")).sortWithinPartitions("k", "v", "x", "y")
        return dealt.mapInArrow(run, "a long, b long")

    all_parts = rounds(n_rows, max(at_once * n, least))
    if len(all_parts) == 1:
        return found(all_parts[0])
    return functools.reduce(DataFrame.unionByName, [staged(found(parts)) for parts in all_parts])


#: Cut buckets that are broadcast at most; more are joined by a shuffle.
MOST_CUTS = 1 << 17


def rounds(n_rows: list[int], most: int) -> list[list[tuple[int, int, int]]]:
    """Lists of (k, part, parts) that cover all parts of each k once; those of a list have about `most` rows together at most.
    n_rows: the rows of each k."""
    out, room = [], 0
    for k, rows in enumerate(n_rows):
        parts = max(1, -(-rows // most))
        for part in range(parts):
            if not out or parts > 1 or rows > room:
                out.append([])
                room = most
            out[-1].append((k, part, parts))
            room = 0 if parts > 1 else room - rows
    return out


def bucket_links(t: np.ndarray, threshold: int) -> pa.RecordBatch:
    """A spanning forest of the links of whole buckets (columns k v x y side probe id and the fingerprint's words): small ones
    by shifts, larger ones by tiles."""
    new = np.r_[True, (t[1:, :4] != t[:-1, :4]).any(axis=1)]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(t)])
    group = np.repeat(np.arange(len(start)), size)
    fp, ident, probe, side = t[:, 7:], t[:, 6], t[:, 5], t[:, 4]
    own = t[:, 2] == t[:, 3]
    found = []
    of = np.repeat(np.where(size <= 64, size, 0), size)
    live = np.flatnonzero(of > 1)
    for d in range(1, 64):
        live = live[of[live] > d]
        if not len(live):
            break
        at = live[live >= d]
        at = at[group[at] == group[at - d]]
        ok = (distance(fp[at], fp[at - d]) <= threshold) & (ident[at] != ident[at - d])
        ok &= (probe[at] + probe[at - d] < 2) & (own[at] | (side[at] != side[at - d]))
        at = at[ok]
        found.append(np.column_stack([ident[at], ident[at - d], distance(fp[at], fp[at - d])]).astype(np.int64))
    for g in np.flatnonzero(size > 64):
        rows = slice(start[g], start[g] + size[g])
        f, i, p, s = fp[rows], ident[rows], probe[rows], side[rows]
        base = p == 0
        if own[start[g]]:
            found.append(named(forest(f[base], None, threshold), i[base]))
            if (~base).any():
                found.append(named(forest(f[base], f[~base], threshold), np.r_[i[base], i[~base]]))
        else:
            for one, two in (((s == 0) & base, (s == 1) & base), ((s == 0) & base, (s == 1) & ~base), ((s == 0) & ~base, (s == 1) & base)):
                if one.any() and two.any():
                    found.append(named(forest(f[one], f[two], threshold), np.r_[i[one], i[two]]))
    e = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    e[:, :2] = np.sort(e[:, :2], axis=1)
    e = spanning(e[e[:, 0] != e[:, 1]])
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0], pa.int64()), pa.array(e[:, 1], pa.int64())], names=["a", "b"])


def named(edges: list[tuple[int, int, int]], ids: np.ndarray) -> np.ndarray:
    if not edges:
        return np.zeros((0, 3), np.int64)
    e = np.array(edges, dtype=np.int64)
    e[:, :2] = ids[e[:, :2]]
    return e


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each id in edges (a, b): root is the least id of its component. Alternating large and small stars."""
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: each neighbour above a node goes to the node's least neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its lower neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        then = staged(small)
        stable = then.count() == now.count() and then.join(now, ["a", "b"], "left_anti").isEmpty()
        now = then
        if stable:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, threshold: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text); component_id is the least doc_id reachable."""
    fps = staged(fingerprints(docs.select("doc_id", "text"), ["doc_id"]))
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("id")))
    # ids may be missing: nodes go by their fingerprint, which is unique, and take the least id at the end
    edges = links(nodes.select("fp", F.col("fp").alias("id")), threshold)
    roots = components(edges)
    by_fp = nodes.join(roots.select(F.col("id").alias("fp"), "root"), "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = by_fp.groupBy("root").agg(F.min("id").alias("component_id"))
    return fps.join(by_fp.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# ---- one of each group, by sets of shingles

#: Words of the fingerprint of a set, of 64 bits each.
WORDS = 4
_LANES = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The XXH64 values (seed 42) of a text's shingles, distinct and in order; of fewer words than width, of all of them."""
    import xxhash

    words = lowered(text).split()
    digest, n = xxhash.xxh64_intdigest, len(words)
    found = {digest(b" ".join(words[i : i + width]), 42) for i in range(max(1, n - width + 1))} if words else ()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def node_of(found: np.ndarray) -> int:
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), 42)], np.uint64).view(np.int64)[0])


def words_of(found: np.ndarray) -> list[int]:
    """The fingerprint of a set: each word the majority of another hash of its shingles."""
    out = [majority(found)]
    for lane in _LANES[1:WORDS]:
        x = found ^ np.uint64(lane)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        out.append(majority(x ^ (x >> np.uint64(33))))
    return out


def bits_apart(similarity: float, bits: int, errors: float) -> int:
    """In how many bits the fingerprints of two sets of this Jaccard similarity differ, and so many standard errors more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + errors * math.sqrt(bits * p * (1 - p)))


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5, threshold: int = 14, most_bits: int = 1 << 27) -> DataFrame:
    """One row of docs (doc_id, text) of each group of near-duplicates: that with the least doc_id.

    Texts link if the sets of their shingles of `width` words have this Jaccard similarity or more. A set's shingles set each of
    256 bits by majority, so two sets differ in a share of the bits that is about the angle between them over pi. Sets are probed
    for by the first 64 bits, lossless within `threshold` bits, and told by all bits, with two standard errors to spare; what is
    found is a spanning forest of the fewest bits, whose links are then held to the similarity of the sets themselves. Equal
    sets are one node. Rows with the same doc_id and the same set count as one; rows without a doc_id stay, as nothing tells
    them apart."""
    key = F.xxhash64("text").alias("t")

    def make() -> Callable[[list], list[list]]:
        def of(texts: list[str | None]) -> list[list]:
            found = [shingles(t, width) for t in texts]
            return [[node_of(s) for s in found], *map(list, zip(*(words_of(s) for s in found), strict=True))] if found else [[] for _ in fields]

        return of

    fields = [T.StructField(n, T.LongType()) for n in ("id", "fp", "f1", "f2", "f3")]
    rows = staged(map_text(docs.select("doc_id", key, "text"), make, fields, ["doc_id", "t"]))
    nodes = staged(rows.groupBy("id").agg(*[F.first(c).alias(c) for c in ("fp", "f1", "f2", "f3")], F.min("t").alias("t")))
    edges = staged(links(nodes.drop("t"), threshold, within=bits_apart(similarity, WORDS * BITS, 2.0)).distinct())
    roots = components(alike(docs.select(key, "text"), nodes, edges, similarity, width, most_bits))
    return first_of_each(docs, rows, roots)


def alike(docs: DataFrame, nodes: DataFrame, edges: DataFrame, similarity: float, width: int, most_bits: int) -> DataFrame:
    """The edges (a, b) of nodes whose sets have this similarity. docs (t, text): texts with their hashes; nodes (id, t)."""
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().join(nodes.select("id", "t"), "id")
    named = staged(ends.select(F.col("t").alias("h")))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(named, named.count(), most_bits))  # at most most_bits / 8 bytes

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in small(batch, "text"):
                rows = rows.filter(pa.array(marked(bits.value, rows.column(0).to_numpy().view(np.uint64))))
                found = [shingles(t, width) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "s"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in small(batch, "x"):
                pairs = zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)
                on = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in pairs]
                yield rows.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    sets = docs.mapInArrow(read, "id long, s binary").join(ends.select("id"), "id", "left_semi").dropDuplicates(["id"])
    pairs = edges.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(hold, "a long, b long")


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """The similarity of two sets of distinct numbers; of two empty ones 1."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(len(x) + len(y) - shared, 1) if len(x) or len(y) else 1.0


def first_of_each(docs: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each component the row of docs with the least doc_id, and all rows without one. rows (doc_id, t, id): the hash and the
    node of each row's text; roots (id, root): the component of each node that has links."""
    found = rows.filter("doc_id is not null").select("doc_id", "t", "id").join(roots, "id", "left")
    # a doc_id may be in several components, so a row is known by doc_id and the hash of its text
    chosen = found.groupBy(F.coalesce("root", "id")).agg(F.min(F.struct("doc_id", "t")).alias("c"))
    name, new = fresh(docs, "t"), F.col("c.doc_id").alias("doc_id")
    named = docs.filter("doc_id is not null").withColumn(name, F.xxhash64("text"))
    kept = named.join(chosen.select(new, F.col("c.t").alias(name)), ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter("doc_id is null"))
