"""Operators over whole corpora, against brute force on small fixtures."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyset.llm import minhash, mixing, phrases, preference, simhash

DOCS = "doc_id long, text string, source string, h int, part string"
ODD = [None, "", " \t\n", "one", "one", "one two three", "de " * 50, "x " * 20_000]


def frame(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, sources[i] if sources else "s", 7, "clash") for i, t in enumerate(texts)], DOCS).repartition(3)


def near_texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


# ---- SimHash


def plain_fingerprint(t):
    import xxhash

    w = [x.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for x in (t or "").encode().split()]
    runs = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, most):
    label = list(range(len(fps)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("seed", range(2))
def test_simhash(spark, seed):
    texts = ODD + near_texts(seed)
    got = simhash.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    fps = [plain_fingerprint(t) for t in texts]
    assert [r.fp % (1 << 64) for r in got] == fps
    assert [r.component_id for r in got] == plain_components(fps, 4)


@pytest.mark.parametrize("block", [8, 50, 8192])
def test_links_lose_none_in_blocks(spark, block):
    rng = np.random.default_rng(8)
    centres = rng.integers(-(2**63), 2**63 - 1, 6)
    fps = sorted({int(c) ^ simhash.signed(simhash.mask([int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)])) for c in centres for _ in range(60)})
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, id long")
    roots = {r.id: r.root for r in simhash.components(simhash.links(nodes, 4, block=block)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == plain_components([f % (1 << 64) for f in fps], 4)


def test_thresholds_add_up():
    for costs in ([[0, 5, 50, 500, 5000, 9e9]] * 4, [[0, 9, 10, 11, 12, 13], [0, 1, 2, 3, 4, 5]]):
        cost, taus = simhash.allocate(costs, 4 - len(costs) + 1)
        assert sum(taus) == 5 - len(costs) and cost == sum(c[t + 1] for c, t in zip(costs, taus))


def test_simhash_edges(spark):
    assert simhash.near_duplicates(frame(spark, []).limit(0)).count() == 0
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (None, "q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1)]


# ---- repeated passages


def plain_removed(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize(("seed", "shard", "chars"), [(0, 10**7, 10**6), (1, 2000, 300), (2, 500, 50)])
def test_phrases(spark, seed, shard, chars):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "ccc", "dé", "e e", "x,"])
    shared = [[word() for _ in range(rng.randint(8, 40))] for _ in range(4)]
    texts = list(ODD)
    for _ in range(40):
        w = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) - 6)
            w += p[a : a + rng.randint(3, len(p))] + [word() for _ in range(rng.randint(0, 10))]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    got = phrases.strip(frame(spark, texts), width=8, gram=3, shard_bytes=shard, automaton_chars=chars, most_bits=1 << 16).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in got] == plain_removed(texts, 8)


def test_phrases_default_width_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    texts = [text, "lead " + text + " tail", None]
    got = phrases.strip(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in got] == [(60, 60, ""), (62, 60, "lead tail"), (0, 0, "")]
    assert phrases.strip(frame(spark, []).limit(0)).count() == 0


# ---- MinHash


def plain_likeness(a, b):
    def runs(t):
        w = (t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_minhash(spark):
    texts = ODD + near_texts(3, 40)
    got = minhash.edits(frame(spark, texts)).orderBy("doc_id").collect()
    errors = []
    for i, r in enumerate(got):
        t, following = texts[i] or "", texts[i - 1] or ""  # descending doc_id; after the last comes the first
        n = len(t) // 3
        changed = t[: len(t) - n] + following[:n]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        errors += [r.near_edited - plain_likeness(t, changed), r.near_next - plain_likeness(t, following)]
        assert 0 <= r.near_edited <= 1 and len(r.fingerprint) == (512 if t.split() else 0)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.2
    assert got[3].fingerprint == got[4].fingerprint and got[0].near_next == 0.0 and got[1].near_next == 1.0


@pytest.mark.parametrize("per_bucket", [2, 7, 1024])
def test_next_across_ranges(spark, per_bucket):
    rng = random.Random(per_bucket)
    for ids in ([5, 1, 900, 17, 18, 19, 10_000, -4, 3, 2], [*range(200), 2**60, -(2**62)], rng.sample(range(-(10**6), 10**6), 150)):
        docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
        got = {r.doc_id: r.next.text for r in minhash.with_next(docs, per_bucket=per_bucket).collect()}
        order = sorted(ids, reverse=True)
        assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


def test_next_of_equal_and_missing_ids(spark):
    one = spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")
    assert minhash.edits(one).count() == 2 and minhash.edits(one.limit(0)).count() == 0
    rows = [(7, f"seven {i % 40}") for i in range(120)] + [(None, "none")] * 30 + [(i, f"t{i}") for i in range(10)]
    got = minhash.with_next(spark.createDataFrame(rows, "doc_id long, text string"), per_bucket=4).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert Counter(r.next.text for r in got) == Counter(t for _, t in rows)  # one round through all rows
    follows = {(r.doc_id, r.text, r.next.text) for r in got}
    assert {(9, "t9", "t8"), (None, "none", "none"), (None, "none", "t9"), (0, "t0", "none")} <= follows and ("t8" in {b for a, _, b in follows if a == 7}) is False
    assert sum(b.startswith("seven") for a, _, b in follows if a == 8) == 1 and ("t6" in {b for a, _, b in follows if a == 7})


def test_outlying_ids_do_not_share_a_range(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id").union(spark.createDataFrame([(2**60,)], "doc_id long")).withColumn("h", minhash.F.xxhash64("doc_id"))
    o, sub, crowded = minhash.ranges(docs, 100)
    assert docs.groupBy(o, sub).count().agg({"count": "max"}).first()[0] < 400 and not crowded


def test_minhash_plan_is_native(spark):
    plan = minhash.edits(frame(spark, ["a b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- mixing


def test_water_fill():
    for words in ([10, 10, 10, 10], [100, 1, 1, 50], [0, 5, 0], []):
        t = mixing.water_fill(words, [5, 2, 1, 5][: len(words)], 1.5, 2.0)
        assert sum(t) == pytest.approx(1.5 * sum(words)) and all(x <= 2 * n + 1e-9 for x, n in zip(t, words))


def test_splitting_tree():
    leaves = mixing.splitting_tree([100, 7, 0, 893], 13, 1)
    assert leaves.sum(axis=0).tolist() == [100, 7, 0, 893] and set(leaves.sum(axis=1)) <= {76, 77} and leaves.min() >= 0
    assert (leaves == mixing.splitting_tree([100, 7, 0, 893], 13, 1)).all()


def plain_targets(words, weights, share=1.5, cap=2.0):
    """Water filling by bisection on the level, as another way to the same targets."""
    total, low, high = min(share * sum(words), cap * sum(words)), 0.0, cap * sum(words) + 1.0
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(cap * n, w * level) for n, w in zip(words, weights)) < total else (low, level)
    return [min(cap * n, w * high) for n, w in zip(words, weights)]


HOW = [{"n_blocks": 64, "n_shards": 5}, {"n_blocks": 16, "n_shards": 40, "n_top": 3}, {}]


@pytest.mark.parametrize("how", HOW)
def test_mixing(spark, how):
    rng = random.Random(9)
    texts = ["w " * rng.randint(0, 30) for _ in range(900)] + [None, "long " * 500]
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in texts]
    got = {r.doc_id: r for r in mixing.mix_plan(frame(spark, texts, sources), **how).collect()}
    size = [len((t or "").split()) for t in texts]
    order = ["a", "b", "c", None]
    total = [sum(n for n, s in zip(size, sources) if s == o) for o in order]
    for o, n, t in zip(order, total, plain_targets(total, [5, 2, 1, 5])):
        rows = [got[i] for i, s in enumerate(sources) if s == o]
        assert {r.source_size for r in rows} == {n} and rows[0].target == pytest.approx(t)
        left = t - sum(r.taken for r in rows)
        least = [len(r.shards) for r in rows if r.size]
        assert -1e-6 <= left < min((r.size for r in rows if r.size and len(r.shards) == min(least)), default=1) + 1
        assert max(least) - min(least) <= 1
    assert all(r.size == size[i] and r.taken == len(r.shards) * r.size <= 2 * r.size for i, r in got.items())
    again = {r.doc_id: (r.taken, r.shards) for r in mixing.mix_plan(frame(spark, texts, sources).repartition(5), **how).collect()}
    assert again == {i: (r.taken, r.shards) for i, r in got.items()}
    mixed = mixing.mix(frame(spark, texts, sources), **how)
    found = mixed.withColumn("at", minhash.F.spark_partition_id()).collect()
    assert Counter(r.doc_id for r in found) == Counter({i: len(r.shards) for i, r in got.items() if r.shards})
    n_shards = how.get("n_shards", 1)
    assert {r.at == r["shard"] for r in found} == {True} and {r["shard"] for r in found} == set(range(n_shards))
    shard_words = Counter()
    for r in found:
        shard_words[r["shard"]] += size[r.doc_id]
    if n_shards == 5:
        assert max(shard_words.values()) < 2 * min(shard_words.values())


def test_mixing_of_nothing(spark):
    empty = frame(spark, []).limit(0)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    wordless = mixing.mix_plan(frame(spark, [None, "", " "])).collect()
    assert [(r.size, r.target, r.taken) for r in wordless] == [(0, 0.0, 0)] * 3


def test_mixing_goes_on_after_a_document_that_does_not_fit(spark):
    texts = ["w " * 9] * 3000 + ["long " * 20_000, "w", "w w"]
    for seed in range(3):
        got = mixing.mix_plan(frame(spark, texts), share=0.55, n_blocks=32, n_shards=3, seed=seed).collect()
        left = got[0].target - sum(r.taken for r in got)
        assert 0 <= left < min((r.size for r in got if not r.shards), default=1e9)


def test_prefix_ends_by_ranges(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([rng.randint(-(2**63), 2**63 - 1), 5]), rng.randint(-(2**63), 2**63 - 1), rng.randint(1, 9)) for k in "ab" for _ in range(800)]
    docs, left = spark.createDataFrame(rows, "skey string, h long, r long, size long"), {"a": 1500, "b": 10**6}
    got = mixing.prefix_ends(docs, left, few=32)  # half of the rows are of one place in the order
    for k in left:
        used = 0
        for _, h, r, size in sorted(x for x in rows if x[0] == k):
            if used + size > left[k]:
                assert got[k] == (h, r, used)
                break
            used += size
        else:
            assert got[k][2] == used


def test_mix_has_rows_without_id_and_with_one_id(spark):
    rows = [(None, f"n{i} x", "s") for i in range(40)] + [(1, f"a{i} x", "s") for i in range(40)] + [(None, "copy x", "s")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, share=2.0, n_shards=2, n_blocks=8)
    assert Counter(r.text for r in mixed.collect()) == Counter({t: 2 * n for t, n in Counter(t for _, t, _ in rows).items()})
    some = Counter(r.text for r in mixing.mix(docs, share=0.5, n_shards=2, n_blocks=8).collect())
    assert sum(some.values()) == 60 and {n for t, n in some.items() if t != "copy x"} == {1}


def test_mix_keeps_columns_of_any_name(spark):
    names = ["shards", "copy", "doc", "skey", "block", "h", "r", "size", "taken", "__row"]
    docs = frame(spark, ["a b", "c"]).select("doc_id", "text", "source", *[minhash.F.lit(n).alias(n) for n in names])
    mixed = mixing.mix(docs, share=2.0)
    assert mixed.columns == [*(c for c in docs.columns if c != "copy"), "copy", "shard"]
    assert {tuple(r[n] for n in names if n != "copy") for r in mixed.collect()} == {tuple(n for n in names if n != "copy")} and mixed.count() == 4


# ---- preference pairs


def test_preference(spark):
    kind = "array<struct<role:string,text:string>>"
    rows = [
        (0, [("system", "s"), ("user", "q"), ("assistant", "good")], [("system", "s"), ("user", "q"), ("assistant", "bad"), ("user", "x"), ("assistant", "yé")], "keep"),
        (1, [("user", "same")], [("user", "same")], "keep"),
        (2, [], [("assistant", "a")], "keep"),
        (3, None, [("user", "")], "keep"),
    ]
    got = preference.format_pairs(spark.createDataFrame(rows, f"id int, chosen {kind}, rejected {kind}, PROMPT string")).orderBy("id").collect()
    assert [r.n_prompt_turns for r in got] == [2, 1, 0, 0] and got[0].prompt == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n"
    assert [got[0].rejected[s.start : s.end] for s in got[0].rejected_spans] == ["bad<|end|>\n", "yé<|end|>\n"]
    assert [got[0].chosen[s.start : s.end] for s in got[0].chosen_spans] == ["good<|end|>\n"]
    assert (got[1].chosen, got[1].chosen_spans, got[2].chosen, got[3].chosen) == ("", [], "", "")
    turns = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    pairs = {r.conv_id: (len(r.chosen), len(r.rejected)) for r in preference.paired(turns).collect()}
    assert pairs == {None: (1, 1), 1: (3, 3), 2: (1, 1)} and preference.format_pairs(preference.paired(turns.limit(0))).count() == 0
