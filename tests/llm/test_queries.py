"""Each registered query on a small table with nulls and odd rows, column by column against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from test_corpus_operators import plain_components, plain_fingerprint, plain_likeness, plain_removed, plain_targets
from test_text_operators import distance_within, plain_quality, plain_spans, speech

from tallyset.llm import decontaminate, langid, pii, quality, queries, toxicity


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = " ".join(f"shared{i}" for i in range(60))
    out = []
    for i in range(150):
        kind = ("en", "de", "fr")[i % 3]
        text = speech(kind, rng)
        if i % 4 == 0:
            text += " idiot you moron scum" * 3
        if i % 10 == 0:
            text += " " + shared
        if i % 11 == 0:
            text += f" mail a{i}@b{i}.com or 10.0.0.{i}, +1 (212) 555-01{i:02d}"
        out.append((i, text, kind if i % 8 else None, f"s{i % 4}" if i % 7 else None, len(text)))
    items = ["the quick brown fox jumps over the lazy dog and runs away home", "paris is nice"]
    odd = [None, "", " \n", "42", "one two", "one two", out[3][1], out[4][1] + " x", f"lead {items[0].replace('lazy', 'laxy')} tail", "in Paris is nice, yes", "comparis is nice"]
    out += [(150 + k, t, None, "s0", None) for k, t in enumerate(odd)]
    return out, items


@pytest.fixture(scope="module")
def made(spark, rows, tmp_path_factory):
    docs, items = rows
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 2 == 0), int(i % 4 == 0)) for i in range(150)] + [(3, None, None), (None, 1, 1), (9999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate([*items, None, " "])), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def result(spark, made, name):
    return sorted(queries.QUERIES[name](spark, made).collect(), key=lambda r: r.doc_id)


def docs_of(spark, made):
    return spark.read.parquet(f"{made}/documents.parquet"), spark.read.parquet(f"{made}/labels.parquet")


def test_op1(spark, made, rows):
    docs, _ = docs_of(spark, made)
    names, code, w = langid.train(docs.filter(langid.F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")))
    got = result(spark, made, "op1_language_id")
    assert names == ["de", "en", "fr"] and [r.doc_id for r in got] == [r[0] for r in rows[0]]
    right = 0
    for r, (i, text, lang, *_) in zip(got, rows[0]):
        assert r.held_out == (crc(i) % 4 == 2)
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        raw, counts = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()), np.zeros(langid.DIM)
        for k in range(1, 5):
            for a in range(len(raw) - k + 1):
                h = raw[a]
                for c in raw[a + 1 : a + k]:
                    h = (h * 0x01000193 + c) % 2**32
                counts[((h * 0x9E3779B1) % 2**32 >> 8) % langid.DIM] += 1
        x = np.sqrt(counts) / np.linalg.norm(np.sqrt(counts))
        loss = [sum(np.log1p(np.exp(-c * m)) for c, m in zip(row, x @ w[:-1] + w[-1])) for row in code]
        assert r.lang_pred == names[int(np.argmin(loss))]
        assert r.score == pytest.approx(1 / sum(np.exp(-(v - min(loss))) for v in loss), abs=1e-4)
        right += r.held_out and r.lang_pred == ("en", "de", "fr")[i % 3]
    assert right >= 0.95 * sum(r.held_out for r in got if r.doc_id < 150)


def test_op2(spark, made, rows):
    docs, labels = docs_of(spark, made)
    net = quality.train(docs, labels.filter(langid.F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")))
    for r, (i, text, *_) in zip(result(spark, made, "op2_quality"), rows[0], strict=True):
        want = plain_quality(net, text) if text else 1 / (1 + np.exp(-net.out[-1]))
        assert (r.doc_id, r.held_out, r.predicted) == (i, crc(i) % 4 == 2, int(r.score >= 0.7)) and r.score == pytest.approx(want, abs=1e-4)


def test_op3(spark, made, rows):
    docs, labels = docs_of(spark, made)
    model = toxicity.train(docs, labels.filter(langid.F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")))
    got = result(spark, made, "op3_toxicity")
    for r, (i, text, *_) in zip(got, rows[0], strict=True):
        assert (r.doc_id, r.held_out, r.predicted) == (i, crc(i) % 5 == 0, int(r.score >= 0.5)) and r.score == pytest.approx(model.score([text])[0])
    held = [r for r in got if r.held_out and r.doc_id < 150]
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in held)


def test_op4(spark, made, rows):
    texts, items = rows
    want = set()
    for i, text, *_ in texts:
        for k, item in enumerate(items):
            n = decontaminate.normal(item)
            if text and (d := distance_within(n, decontaminate.normal(text))) <= len(n) // 10:
                want.add((i, k, d))
    got = queries.QUERIES["op4_decontaminate"](spark, made).collect()
    assert len(got) == len(want) == 2 and {(r.doc_id, r.item_id, r.edits) for r in got} == want


def test_op5(spark, made, rows):
    got = result(spark, made, "op5_phrases")
    want = [(n, gone, hashlib.sha256(kept.encode()).hexdigest()) for n, gone, kept in plain_removed([r[1] for r in rows[0]], 35)]
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == want and sum(r.n_removed for r in got) > 900


def test_op6(spark, made, rows):
    for r, (i, text, *_) in zip(result(spark, made, "op6_pii"), rows[0], strict=True):
        base = plain_spans(text or "")
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert (r.doc_id, r.base_sha256) == (i, hashlib.sha256(told.encode()).hexdigest()) and set(told.split(",")) - {""} <= set(r.spans.split(","))


def test_op8(spark, made, rows):
    texts, errors = [r[1] or "" for r in rows[0]], []
    for i, r in enumerate(result(spark, made, "op8_minhash")):
        n, following = len(texts[i]) // 3, texts[i - 1]
        changed = texts[i][: len(texts[i]) - n] + following[:n]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(texts[i]), hashlib.sha256(changed.encode()).hexdigest())
        errors += [r.near_edited - plain_likeness(texts[i], changed), r.near_next - plain_likeness(texts[i], following)]
        assert len(r.fingerprint) == (512 if texts[i].split() else 0) and len(r.edited_fingerprint) == (512 if changed.split() else 0)
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.02


def test_op9(spark, made, rows):
    got = result(spark, made, "op9_mixing")
    order = ["s0", "s1", "s2", "s3", None]
    size = [len((r[1] or "").split()) for r in rows[0]]
    total = [sum(n for n, r in zip(size, rows[0]) if r[3] == o) for o in order]
    target = dict(zip(order, plain_targets(total, [5, 2, 1, 5, 2])))
    for r, n, row in zip(got, size, rows[0], strict=True):
        assert (r.doc_id, r["size"], r.source_size) == (row[0], n, total[order.index(row[3])]) and r.target == pytest.approx(target[row[3]])
        assert r.taken <= 2 * n and (r.taken % n == 0 if n else r.taken == 0)
    for o in order:
        taken = sum(r.taken for r, row in zip(got, rows[0]) if row[3] == o)
        assert target[o] - max(size) <= taken <= target[o] + 1e-6
    assert [tuple(r) for r in got] == [tuple(r) for r in result(spark, made, "op9_mixing")]


def test_op10(spark, made, rows):
    fps = [plain_fingerprint(r[1]) for r in rows[0]]
    got = result(spark, made, "op10_simhash")
    assert [(r.fingerprint, r.component_id) for r in got] == [(f"{f:016x}", c) for f, c in zip(fps, plain_components(fps, 4))]


def test_results_are_of_the_stated_types(spark, made):
    kinds = {
        "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op2_quality": "doc_id bigint, held_out boolean, score double, predicted int",
        "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op5_phrases": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
        "op6_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
        "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    }
    for name, want in kinds.items():
        have = dict(queries.QUERIES[name](spark, made).dtypes)
        assert {k: have[k] for k in (w.split()[0] for w in want.split(", "))} == dict(w.split() for w in want.split(", "))
