"""Near-duplicates leave no shuffle files behind, and links found in rounds lose none."""

import time

import numpy as np
import pytest

from tallyset.llm import simhash
from tallyset.staging import staged


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_staged_tables_leave_no_shuffle_files(spark):
    key, at_first = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files(spark)
    before = spark.conf.get(key)
    table = staged(spark.range(10000).selectExpr("id % 997 AS k").groupBy("k").count().repartition(3, "count"))
    until = time.time() + 10
    while shuffle_files(spark) - at_first and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - at_first
    assert table.count() == 997 and spark.conf.get(key) == before


@pytest.mark.parametrize("block", [20, 16384])
def test_links_in_rounds_lose_none(spark, block, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(-(2**63), 2**63 - 1, 4)
    flip = lambda: simhash.signed(simhash.mask([int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)]))
    fps = sorted({int(c) ^ flip() for c in centres for _ in range(40)})
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, id long")
    written = []
    monkeypatch.setattr(simhash, "staged", lambda df: written.append(staged(df)) or written[-1])
    edges = simhash.links(nodes, 4, block=block, at_once=2, least=1)
    assert len([x for x in written if x.columns == ["a", "b"]]) > 1
    roots = {r.id: r.root for r in simhash.components(edges).collect()}
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 4 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert [roots.get(i, i) for i in range(len(fps))] == label


def test_rounds_have_every_part_once():
    for n_rows, most in (([13, 14, 14, 14, 14], 28), ([5, 100, 3, 0, 4], 10), ([], 10), ([7], 100)):
        found = simhash.rounds(n_rows, most)
        assert sorted(x for r in found for x in r) == [(k, p, max(1, -(-rows // most))) for k, rows in enumerate(n_rows) for p in range(max(1, -(-rows // most)))]
        assert all(sum(n_rows[k] / parts for k, _, parts in r) <= most for r in found)


def test_few_links_are_those_of_all_words():
    rng = np.random.default_rng(6)
    x = rng.integers(-(2**63), 2**63 - 1, (60, 4))
    y = np.concatenate([x[:20] ^ 7, rng.integers(-(2**63), 2**63 - 1, (30, 4))])
    bits = simhash.distance(x[:, None], y[None, :])
    for words in (4, 1):
        want = [(r, c) for r, c in zip(*np.nonzero(simhash.distance(x[:, None, :words], y[None, :, :words]) <= 50 * (words > 1) + 3 * (words == 1)), strict=True)]
        got = simhash.few_links(np.ascontiguousarray(x[:, :words]), np.ascontiguousarray(y[:, :words]), 50 if words > 1 else 3, 100)
        assert sorted((r, c) for r, c, _ in got.tolist()) == sorted((int(r), int(c)) for r, c in want) and len(want) >= 20
    assert simhash.few_links(x, y, 50, 19) is None and (bits <= 50).sum() == 20
