"""One row of each group of near-duplicates, against brute force over the sets of shingles."""

import random

import numpy as np
import pytest

from tallyset.llm import simhash


def sets(t):
    w = [x.lower() for x in (t or "").split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def plain_kept(texts, least=0.8):
    found, label = [sets(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(found):
        for j, y in enumerate(found[:i]):
            if likeness(x, y) >= least and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if v == b else v for v in label]
    return sorted(set(label))


def texts_of(seed, most):
    """Texts and copies with up to `most` words changed in a hundred and fifty."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    line = [rng.choice(words) for _ in range(14)]
    out = [None, "", "one", "One", "one two three four five", " ".join(words * 3)]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(130, 170))] + (line if rng.random() < 0.5 else [])
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            t = list(base)
            for _ in range(rng.randint(0, most)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t).title() if rng.random() < 0.3 else " ".join(t))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_keeps_one_of_all_that_are_near(spark, seed):
    texts = texts_of(seed, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(texts)
    assert got.columns == docs.columns


def test_links_are_of_the_similarity_and_nearly_all(spark):
    texts = [t for t in dict.fromkeys(t.lower() for t in texts_of(7, 5) + texts_of(8, 5) if t)]
    found, ids = [sets(t) for t in texts], [simhash.node_of(simhash.shingles(t, 5)) for t in texts]
    nodes = spark.createDataFrame([(i, *simhash.words_of(simhash.shingles(t, 5))) for i, t in zip(ids, texts)], "id long, fp long, f1 long, f2 long, f3 long")
    edges = simhash.links(nodes, 14, within=simhash.bits_apart(0.8, 256, 2.0)).distinct()
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select(simhash.F.xxhash64("text").alias("t"), "text")
    named = docs.join(spark.createDataFrame(list(zip(texts, ids)), "text string, id long"), "text").select("id", "t")
    held = simhash.alike(docs, named, edges, 0.8, 5, 1 << 16).collect()
    at = {i: k for k, i in enumerate(ids)}
    assert held and all(likeness(found[at[e.a]], found[at[e.b]]) >= 0.8 for e in held)
    label = list(range(len(ids)))
    for e in held:
        a, b = label[at[e.a]], label[at[e.b]]
        label = [a if v == b else v for v in label]
    near = [(i, j) for i in range(len(ids)) for j in range(i) if likeness(found[i], found[j]) >= 0.8]
    assert len(near) > 30 and sum(label[i] == label[j] for i, j in near) >= 0.9 * len(near)


@pytest.mark.parametrize("tile", [7, 1024])
def test_forest_is_of_the_fewest_bits(tile):
    rng = np.random.default_rng(0)
    flip = lambda: simhash.signed(simhash.mask([int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)]))
    for n in (2, 5, 40):
        centres = rng.integers(-(2**63), 2**63 - 1, (4, 2))
        fps = np.stack([centres[rng.integers(4)] ^ np.array([flip(), flip()]) for _ in range(n)])
        label, bits = list(range(n)), 0
        for d, i, j in sorted((int(simhash.distance(fps[i], fps[j])), i, j) for i in range(n) for j in range(i)):
            if d <= 9 and label[i] != label[j]:
                a, b, bits = label[i], label[j], bits + d
                label = [a if v == b else v for v in label]
        edges = simhash.forest(fps, None, 9, tile)
        assert (sum(e[2] for e in edges), len(edges)) == (bits, n - len(set(label)))


def test_rows_with_one_id_and_unrelated_texts_stay(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = spark.createDataFrame([(1, one, "x"), (1, two, "x"), (1, two, "x"), (2, one, "x"), (None, one, "x")], "doc_id long, text string, t string")
    got = simhash.keep_one(docs)
    assert sorted(((r.doc_id or 0), r.text[0]) for r in got.collect()) == [(0, "a"), (1, "a"), (1, "b")] and got.columns == docs.columns
    assert simhash.keep_one(docs.limit(0)).count() == 0
