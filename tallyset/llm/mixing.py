"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A document's size is its number of words. The target of a source is its share, by weight, of `share` times all words,
at most `cap` times its own words; what a cap cuts off goes to the others by weight. Each source is cut into blocks by
a hash of its rows; whole passes over its blocks, then its blocks in permuted order, each that still fits, make up the
target, and of the other blocks documents are taken in permuted order, each that still fits, until none does. The blocks
so drawn are the source's quota. A binary tree over the output shards splits the vector of quotas: at each node the left
half takes a multivariate-hypergeometric draw, so every shard gets an exact number of blocks, and all draws are disjoint.
Within a shard rows are ordered by a hash.

The driver holds a row for each source, MOST_BLOCKS blocks at most beside one for each source, and the quotas of MOST_TOP
shards; of more shards it holds groups, and each group is split on, by smaller blocks, in a task of its own. What a document
gets is read off its block, which is broadcast, so no row moves before it goes to its shard, and a source that holds most
rows is no task's alone. Which documents fill up a target is found by sums over ever smaller ranges of their order.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a null doc_id is a value like others.
Repeated rows have one place in the order and are taken one by one. No rows: no rows. A source without words has target 0.
Columns of docs keep their names, whatever these are; only `shard` and `copy` give way to the new ones in mix().
Reruns give the same rows: all choices come from `seed` and the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, staged, without

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: Blocks over all sources, beside one for each; shards, or groups of shards, between which the driver splits them.
MOST_BLOCKS, MOST_TOP = 65536, 4096


def water_fill(words: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """The target of each source: by weight, at most cap times its words, the excess reshared until none is above."""
    limits = [cap * n for n in words]
    left, open_ = min(share * sum(words), sum(limits)), set(range(len(words)))
    out = [0.0] * len(words)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit >= limits[i]]
        for i in full or open_:
            out[i] = limits[i] if full else weights[i] * unit
        if not full:
            break
        left -= sum(limits[i] for i in full)
        open_ -= set(full)
    return out


def splitting_tree(quotas: Sequence[int], n_shards: int, seed: int | Sequence[int]) -> np.ndarray:
    """Splits the quotas among shards: row k has what shard k takes of each. Columns add up to the quotas."""
    out = np.zeros((n_shards, len(quotas)), dtype=np.int64)
    nodes = [(0, n_shards, np.asarray(quotas, dtype=np.int64))]
    while nodes:
        low, high, q = nodes.pop()
        if high - low == 1:
            out[low] = q
            continue
        mid, total = (low + high) // 2, int(q.sum())
        take = total * (mid - low) // (high - low)
        rng = np.random.default_rng([*np.atleast_1d(seed), low, high])
        draw = rng.multivariate_hypergeometric(q, take, method="marginals") if 0 < take < total else q * (take == total and total > 0)
        nodes += [(low, mid, draw), (mid, high, q - draw)]
    return out


def keys(seed: int) -> list[Column]:
    """The source, size and place in the order of each row of docs, and a number that tells rows of one place apart."""
    source = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return [source.alias("skey"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("r")]


def mix_plan(docs: DataFrame, seed: int = 42, **how) -> DataFrame:
    """A row for each row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, shards.

    taken: the words that the mix takes of it, repeats counted. shards has the output shard of each time that the document
    is taken (of over n_top shards, the group of shards). how: see planned().
    """
    rows = staged(docs.select("doc_id", *keys(seed)))  # staged, so that row numbers last
    return planned(rows, seed=seed, **how)[0].select("doc_id", "size", "source_size", "target", "taken", "shards")


def planned(
    rows: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    n_blocks: int = MOST_BLOCKS // 4,
    n_shards: int | None = None,
    shard_words: int = 8_000_000,
    n_top: int = MOST_TOP,
    seed: int = 42,
) -> tuple[DataFrame, int, int]:
    """rows (keys() and others) with source_size, target, taken, shards and block; and the numbers of shards, and of shards or
    groups that shards names. n_shards: unless given, one for each shard_words that the mix takes. n_blocks: blocks over all
    sources, dealt by their words; MOST_BLOCKS at most, and 16 for each of n_top at most, where that is more."""
    spark = rows.sparkSession
    # one row for each source; "s..." < "n" is undone so that null comes last
    sources = sorted(rows.groupBy("skey").agg(F.sum("size").alias("words")).collect(), key=lambda r: (r.skey == "n", r.skey.encode()))
    names, words = [r.skey for r in sources], [int(r.words) for r in sources]
    targets = water_fill(words, [weights[i % len(weights)] for i in range(len(words))], share, cap)
    n_shards = n_shards or max(1, -(-int(sum(targets)) // shard_words))
    top = min(n_shards, n_top)
    per = max(1.0, sum(words) / min(MOST_BLOCKS, max(n_blocks, 16 * top)))
    cuts = [max(1, int(np.ceil(n / per))) for n in words]
    passes = [min(int(t // n), int(np.ceil(cap))) if n else 0 for n, t in zip(words, targets, strict=True)]
    rest = [int(t - p * n) for n, t, p in zip(words, targets, passes, strict=True)]
    heads = F.broadcast(spark.createDataFrame(list(zip(names, words, targets, cuts, strict=True)), "skey string, source_size long, target double, n_blocks int"))  # a row a source
    dealt = rows.join(heads, "skey").withColumn("block", F.pmod("h", "n_blocks").cast("int")).drop("n_blocks")

    held: dict[str, dict[int, int]] = {k: {} for k in names}
    for r in dealt.groupBy("skey", "block").agg(F.sum("size").alias("words")).collect():  # MOST_BLOCKS and a row a source at most
        held[r.skey][r.block] = int(r.words)
    whole, left = {}, {}
    for i, k in enumerate(names):
        whole[k], left[k] = first_fit(held[k], rest[i], np.random.default_rng([seed, 1, i]))
    others = spark.createDataFrame([(k, b) for k in names for b in held[k] if b not in whole[k]], "skey string, block int")
    loose = dealt.select("skey", "block", "h", "r", "size").join(F.broadcast(others), ["skey", "block"])  # as many as blocks
    rounds, filled = fill(loose, left)

    plan, units = [], [[(b, p) for b in sorted(held[k]) for p in range(passes[i] + (b in whole[k] or (k, b) in filled))] for i, k in enumerate(names)]
    ends = splitting_tree([len(u) for u in units], top, seed).cumsum(axis=0)
    for i, k in enumerate(names):
        order = np.random.default_rng([seed, 2, i]).permutation(len(units[i]))
        shard_of = dict(zip((units[i][j] for j in order), np.searchsorted(ends[:, i], np.arange(len(order)), side="right").tolist(), strict=True))
        plan += [(k, b, [shard_of[b, p] for p in range(passes[i])], shard_of.get((b, passes[i])), b in whole[k]) for b in held[k]]
    plan_of = F.broadcast(spark.createDataFrame(plan, "skey string, block int, full array<int>, last int, whole boolean"))  # as many as blocks
    steps = spark.createDataFrame([(k, rounds[k]) for k in names], "skey string, rounds array<struct<left:long,h:long,r:long>>")
    out = dealt.join(plan_of, ["skey", "block"]).join(F.broadcast(steps), "skey")
    extra = F.col("whole") | taken_in("rounds")
    out = out.withColumn("shards", F.when(extra, F.concat("full", F.array("last"))).otherwise(F.col("full"))).withColumn("taken", F.col("size") * F.size("shards"))
    return out.drop("full", "last", "whole", "rounds"), n_shards, top


def first_fit(words: dict[int, int], rest: int, rng: np.random.Generator) -> tuple[set[int], int]:
    """Takes blocks in permuted order, each that still fits, and says what they leave of the rest."""
    blocks, taken = sorted(words), set()
    for j in rng.permutation(len(blocks)):
        if words[blocks[j]] <= rest:
            taken.add(blocks[j])
            rest -= words[blocks[j]]
    return taken, rest


def taken_in(rounds: str) -> Column:
    """Whether a document is taken in one of the rounds: it fits what was left then, and comes before the round's end."""
    before = lambda x: (F.col("h") < x["h"]) | ((F.col("h") == x["h"]) & (F.col("r") < x["r"]))
    return (F.col("size") > 0) & F.exists(rounds, lambda x: (F.col("size") <= x["left"]) & before(x))


def fill(docs: DataFrame, left: dict[str, int]) -> tuple[dict[str, list[tuple[int, int, int]]], set[tuple[str, int]]]:
    """Documents of docs (skey, block, h, r, size) that fill up what is left of each source's target, in the order of (h, r).

    In each round the documents that fit what is left, up to the first that does not fit beside those before it, are taken;
    after the last round none fits. Gives what was left and the end (h, r) for each round, and the blocks (skey, block) that
    the documents so taken are of."""
    spark, left = docs.sparkSession, dict(left)
    rounds: dict[str, list[tuple[int, int, int]]] = {k: [] for k in left}
    state = lambda: F.broadcast(spark.createDataFrame([(k, left[k], rounds[k]) for k in left], "skey string, left long, rounds array<struct<left:long,h:long,r:long>>"))
    docs = staged(docs.join(state(), "skey").filter("size > 0 and size <= left").drop("left", "rounds"))
    while left:
        open_ = docs.join(state(), "skey").filter((F.col("size") <= F.col("left")) & ~taken_in("rounds")).select("skey", "h", "r", "size")
        ends = prefix_ends(open_, left)
        if not ends:
            break
        for k, (h, r, used) in ends.items():
            rounds[k].append((left[k], h, r))
            left[k] -= used
    blocks = docs.join(state(), "skey").filter(taken_in("rounds")).select("skey", "block").distinct().collect()  # as many as blocks at most
    return rounds, {(r.skey, r.block) for r in blocks}


HIGHEST = (1 << 63) - 1


def prefix_ends(docs: DataFrame, left: dict[str, int], few: int = 100_000) -> dict[str, tuple[int, int, int]]:
    """For each source of docs (skey, h, r, size) where the longest prefix in the order of (h, r) with at most left words ends,
    exclusive, and its words. Sums over ranges of the order, a few for each source at a time, lead to a range of `few` documents
    at most over all sources, which come to the driver."""
    spark, n = docs.sparkSession, max(1, len(left))
    bits, few = max(2, min(12, int(np.log2(65536 / n)) if n < 65536 else 2)), max(16, few // n)
    used: dict[str, int] = {}
    ends: dict[str, tuple[int, int, int]] = {}
    now = docs
    for column, depth in [(c, d) for c in ("h", "r") for d in [*range(bits, 64, bits), 64]]:
        ranges: dict[str, list] = {}
        for row in now.groupBy("skey", F.shiftright(column, 64 - depth).alias("p")).agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect():
            ranges.setdefault(row.skey, []).append((row.p, int(row.words), row.n))
        small, large = {}, {}
        for k, found in ranges.items():
            used.setdefault(k, 0)
            for p, words, count in sorted(found):
                if used[k] + words > left[k]:
                    (small if count <= few or (column, depth) == ("r", 64) else large)[k] = p
                    break
                used[k] += words
            else:
                ends[k] = (HIGHEST, HIGHEST, used[k])
        if small:
            here = spark.createDataFrame(list(small.items()), "skey string, p long")
            last: dict[str, list] = {}
            for row in now.withColumn("p", F.shiftright(column, 64 - depth)).join(F.broadcast(here), ["skey", "p"]).select("skey", "h", "r", "size").collect():
                last.setdefault(row.skey, []).append((row.h, row.r, row.size))
            for k, found in last.items():
                for h, r, size in sorted(found):
                    if used[k] + size > left[k]:
                        ends[k] = (h, r, used[k])
                        break
                    used[k] += size
        if not large:
            break
        here = spark.createDataFrame(list(large.items()), "skey string, p long")
        now = now.withColumn("p", F.shiftright(column, 64 - depth)).join(F.broadcast(here), ["skey", "p"]).drop("p")
    return ends


def mix(docs: DataFrame, seed: int = 42, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with shard and copy added, a partition for each shard, in
    permuted order. Each row has its own plan, whether or not it shares its doc_id or has none."""
    kept = [F.col(f"`{c}`") for c in without(docs, "shard", "copy").columns]
    rows = staged(docs.select(F.struct(*kept).alias("doc"), *keys(seed)))  # staged, so that row numbers last
    plan, n_shards, top = planned(rows, seed=seed, **how)
    out = plan.select("doc", "skey", "block", "h", "r", F.posexplode("shards").alias("copy", "shard"))
    if n_shards > top:
        out = split_on(out, n_shards, top, seed)
    return out.repartitionById(n_shards, F.col("shard")).sortWithinPartitions(F.xxhash64(F.lit(seed + 3), "h", "copy"), "h", "r", "copy").select("doc.*", "copy", "shard")


def split_on(drawn: DataFrame, n_shards: int, top: int, seed: int) -> DataFrame:
    """drawn (skey, block, h, r, copy, shard) with a shard of the group that `shard` names: each group's blocks are cut into
    smaller ones, about 16 for each of its shards, which a tree splits on in a task."""
    groups = [(g * n_shards // top, (g + 1) * n_shards // top) for g in range(top)]
    blocks = drawn.select("skey", "block", "copy", F.col("shard").alias("group")).distinct().groupBy("group").count().agg(F.avg("count")).first()[0] or 1
    n_parts = max(1, int(np.ceil(16 * n_shards / top / blocks)))

    def split(units: pd.DataFrame) -> pd.DataFrame:
        g = int(units["group"].iloc[0])
        units = units.sort_values(["skey", "order", "block", "copy", "part"], kind="stable")
        low, high = groups[g]
        ends = splitting_tree(units.groupby("skey", sort=True).size().to_numpy(), high - low, [seed, 4, g]).cumsum(axis=0)
        rank, source = units.groupby("skey", sort=True).cumcount().to_numpy(), units.groupby("skey", sort=True).ngroup().to_numpy()
        shard = low + np.array([np.searchsorted(ends[:, s], k, side="right") for s, k in zip(source, rank, strict=True)])
        return units.assign(shard=shard)[["skey", "block", "copy", "part", "group", "shard"]]

    cut = drawn.withColumnRenamed("shard", "group").withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 4), "h", "r"), F.lit(n_parts)).cast("int"))
    units = cut.select("skey", "block", "copy", "part", "group").distinct().withColumn("order", F.xxhash64(F.lit(seed + 5), "skey", "block", "copy", "part"))
    shards = staged(units.groupBy("group").applyInPandas(split, "skey string, block int, copy int, part int, group int, shard int"))
    return cut.join(shards, ["skey", "block", "copy", "part", "group"]).drop("part", "group")
