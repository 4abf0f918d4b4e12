"""Operators that judge a text at a time, against plain versions and planted cases."""

import random
import re

import numpy as np
import pytest

from tallyset.llm import common, decontaminate, langid, pii, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, SCORE string"


def rows_of(texts):
    return [(i, t, "x", "s", None, "clash") for i, t in enumerate(texts)]


ODD = [None, "", " \n\t", "42 %%", "word", "é" * 5, "word " * 30_000, "word", "word"]


# ---- language


def speech(kind: str, rng: random.Random) -> str:
    parts = {"en": ["the", "ing", "and", "er", "on"], "de": ["der", "ung", "und", "sch", "ei"], "fr": ["le", "eau", "et", "oi", "eux"]}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 40)))


def test_language_held_out(spark):
    rng = random.Random(1)
    rows = [(i, speech(k := ("en", "de", "fr")[i % 3], rng), k) for i in range(300)]
    model = langid.train(spark.createDataFrame(rows[:200], "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame(rows[200:], "doc_id long, text string, lang string"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    model = langid.learn(["the and", "der und"], ["en", "de"])
    got = langid.identify(spark.createDataFrame(rows_of(ODD), DOCS), model).collect()
    assert [r.lang_pred for r in got[:4]] == ["und"] * 4 and all(r.lang_pred in ("en", "de") for r in got[4:])
    assert got[4].score == got[7].score == got[8].score and got[4]["SCORE" if "SCORE" in got[4].asDict() else "score"] is not None
    assert langid.identify(spark.createDataFrame([], DOCS), model).count() == 0
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame(rows_of(["abc"]), DOCS), langid.learn([], [])).collect()] == ["und"]
    assert [r.doc_id for r in langid.keep_known(spark.createDataFrame(rows_of(ODD), DOCS), model).collect()] == [4, 5, 6, 7, 8]
    names, code, w = model
    silent = (names, code, np.zeros_like(w))  # bits that say nothing are far from any codeword; of a short text that tells little
    kept = langid.keep_known(spark.createDataFrame(rows_of(["the and the and the and the", "the and", None]), DOCS), silent).collect()
    assert [r.doc_id for r in kept] == [1]
    rng = random.Random(2)
    rows = [(speech(k := ("en", "de", "fr")[i % 3], rng), k) for i in range(200)]
    three = langid.learn(*map(list, zip(*rows)))
    assert langid.keep_known(spark.createDataFrame(rows_of([speech(("en", "de", "fr")[i % 3], rng) for i in range(60)]), DOCS), three).count() == 60


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(n)
        gap = (code.shape[1] - code @ code.T) // 2
        assert gap[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2)


# ---- quality and toxicity


def test_quality(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["soft", "rain", "falls", "gently"]) for _ in range(60)) for _ in range(60)]
    bad = [" ".join(rng.choice(["soft$$$", "rain%%%", "falls###"]) for _ in range(60)) for _ in range(60)]
    net = quality.fit(good[:50] + bad[:50], [1] * 50 + [0] * 50)
    assert min(net.score(t) for t in good[50:]) > 0.7 > 0.3 > max(net.score(t) for t in bad[50:])
    long = good[0] * 400 + " $$$ %%% " * 4000
    assert net.score(long) < net.score(good[0] * 400)
    got = quality.score(spark.createDataFrame(rows_of(ODD), DOCS), net, ["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert quality.score(spark.createDataFrame([], DOCS), net).count() == 0


def test_chunks_cover_the_text():
    net = quality.Network()
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 1023, 1024, 1025, 5000, 70_001, 130_000):
        raw = quality.padded(rng.integers(0, 256, n).astype(np.uint8))
        pooled, at = net.pooled(raw, True)
        whole = net.windows(raw) @ net.filters
        assert np.allclose(pooled.max(axis=0), whole.max(axis=0) + net.shift, atol=1e-4)
        assert (np.abs(net.pooled(raw)[0] - pooled) < 1e-5).all()


def plain_quality(net, text):
    """The network by loops: each filter over every second byte of each chunk."""
    raw = list(text.encode())
    raw += [32] * max(8 - len(raw), len(raw) % 2)
    chunks = []
    for c in range(0, max(1, len(raw) - 128), 896):
        part = raw[c : c + 1024]
        found = [net.embed[part[i : i + 8]].reshape(-1) @ net.filters + net.shift for i in range(0, len(part) - 7, 2)]
        chunks.append(np.maximum(np.max(found, axis=0), 0))
    return 1 / (1 + np.exp(-(np.mean(chunks, axis=0) @ net.out[:-1] + net.out[-1])))


@pytest.mark.parametrize("n", [1, 5, 8, 9, 25, 26, 27, 1024, 1025, 1153, 2001])
def test_quality_is_the_network_and_reads_each_of_the_last_bytes(n):
    net = quality.Network()
    net.out[:-1] = np.linspace(-1, 1, len(net.out) - 1)
    text = "".join(chr(97 + (i * 7) % 26) for i in range(n))
    assert net.score(text) == pytest.approx(plain_quality(net, text), abs=1e-5)
    for k in range(1, min(8, n) + 1):
        others = {net.score(text[: n - k] + c + text[n - k + 1 :]) for c in "#$%&+<=>@~^|0123456789"}
        assert others != {net.score(text)}


def test_learning_takes_a_repeated_row_once_and_holds_the_bound(spark):
    docs = spark.createDataFrame([(1, "a" * 50)] * 500 + [(i, "b" * 50) for i in range(2, 40)] + [(None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, mark int")
    texts, found = common.sampled(docs, marks, 10**6)
    assert len(texts) == 39 and texts[0] == "a" * 50 and found == [i % 2 for i in range(1, 40)]
    assert 0 < sum(map(len, common.sampled(docs, marks, 600)[0])) <= 600
    many = spark.createDataFrame([(i, "the same text", "en") for i in range(3000)] + [(i, f"der und {i}", "de") for i in range(60)], "doc_id long, text string, lang string")
    assert langid.train(many, per_language=20)[0] == ["de", "en"]


def test_quality_without_labels(spark):
    docs = spark.createDataFrame(rows_of(["a", "b"]), DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, labels)).collect()} == {0.5}


def toxic_rows():
    rng = random.Random(4)
    plain = lambda: [rng.choice(["hill", "river", "stone", "bread", "walks", "under"]) for _ in range(30)]
    out = []
    for i in range(200):
        words = plain()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum"]))
        out.append((" ".join(words), int(i % 4 == 0)))
    return out


def test_toxicity(spark):
    rows = toxic_rows()
    model = toxicity.fit([t for t, _ in rows], [v for _, v in rows])
    assert model.score(["you are an idiot and a moron under the hill"])[0] >= 0.5 > model.score(["bread under the stone by the river"])[0]
    got = toxicity.score(spark.createDataFrame(rows_of(ODD), DOCS), model, ["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows)] + [(0, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).score(["idiot"]) == toxicity.train(docs, labels).score(["idiot"])
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels.limit(0))).count() == 0


def test_toxicity_counts_have_no_cap():
    at = toxicity.NAMES.index
    none = toxicity.Words()
    few, many = (toxicity.features("idiot bread " * n, none) for n in (60, 600))
    assert many[at("lexicon_count")] > few[at("lexicon_count")]
    learned = toxicity.Words(frozenset(["bread"]), frozenset(["idio"]))
    few, many = (toxicity.features("idiots bread hill " * n, learned) for n in (60, 600))
    assert many[at("learned_count")] > few[at("learned_count")] and few[at("learned_share")] == pytest.approx(2 / 3)


def test_toxicity_is_its_trees_and_steps():
    rows = toxic_rows()
    model = toxicity.fit([t for t, _ in rows], [v for _, v in rows])
    for text, _ in [*rows[:20], ("", 0)]:
        x, margin = toxicity.features(text, model.words), model.trees.base
        for f, c, value in model.trees.trees:
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (f[node] >= 0 and x[f[node]] > c[node])
            margin += value[node - len(f)]
        knots, steps = model.knots
        k = int(np.searchsorted(knots, margin))
        if k == 0 or k == len(knots):
            want = steps[min(k, len(knots) - 1)]
        else:
            share = (margin - knots[k - 1]) / (knots[k] - knots[k - 1])
            want = steps[k - 1] + share * (steps[k] - steps[k - 1])
        assert model.score([text])[0] == pytest.approx(want)


def test_toxic_stems_are_learned():
    rng = random.Random(11)
    end = lambda: "".join(rng.choice("aeioubdfgk") for _ in range(rng.randint(2, 4)))
    texts = [" ".join(rng.choice(["stone", "river", "bread"]) + end() for _ in range(30)) for _ in range(300)]
    toxic = [int(i % 5 == 0) for i in range(300)]
    texts = [t + " grimzol" + end() + " grimzol" + end() if v else t for t, v in zip(texts, toxic)]
    model = toxicity.fit(texts, toxic)
    assert any(s.startswith("grim") for s in model.words.stems)
    assert model.score(["stonea grimzolxy breadu"])[0] >= 0.5 > model.score(["stonea riverx breadu"])[0]


def test_isotonic():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=300), rng.random(300) < 0.4
    k, v = toxicity.isotonic(x, y)
    assert (np.diff(v) >= 0).all() and (np.diff(k) >= 0).all() and v.min() > 0 and v.max() < 1


# ---- decontamination


def distance_within(item: str, text: str) -> int:
    """The least edits between the item and any passage from one word edge to another, passage by passage."""
    edge = [not (0 < p < len(text) and text[p - 1].isalnum() and text[p].isalnum()) for p in range(len(text) + 1)]
    best = len(item)
    for start in (p for p, e in enumerate(edge) if e):
        row = list(range(len(item) + 1))
        for p in range(start, min(len(text), start + 2 * len(item))):
            new = [row[0] + 1]
            for i, x in enumerate(item):
                new.append(min(row[i] + (x != text[p]), row[i + 1] + 1, new[i] + 1))
            row = new
            if edge[p + 1]:
                best = min(best, row[-1])
    return best


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_is_brute_force(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 14)))) for i in range(12)]
    block, rate = decontaminate.Items(items, 0.1), 0.1
    for _ in range(60):
        item = decontaminate.normal(rng.choice(items)[1])
        chars = list(item)
        for _ in range(rng.randint(0, 2 + len(item) // 8)):
            at = rng.randrange(len(chars) or 1)
            chars[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "q"])
        text = " ".join(word() for _ in range(rng.randint(0, 20))) + " " + "".join(chars) + " " + word()
        want = {i: d for i, t in items if (n := decontaminate.normal(t)) and (d := distance_within(n, decontaminate.normal(text))) <= int(len(n) * rate)}
        assert {m[0]: m[1] for m in block.matches(text)} == want


def test_decontamination_holds_short_items_and_word_edges():
    item = "seventeen brown foxes jump over 21 dogs"
    block = decontaminate.Items([(0, "paris"), (1, item), (2, "会議は東京で")], 0.1)
    found = lambda t: [m[:2] for m in block.matches(t)]
    assert found("the comparison with parishes") == [] and found("in Paris, the") == [(0, 0)] and found("(paris)") == [(0, 0)]
    assert found(f"x {item.replace('foxes', 'fixes')}. y") == [(1, 1)] and found(f"x{item}") == [(1, 1)]
    assert found("来週の会議は東京でします") == [(2, 0)]


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(0, "the quick brown fox jumps over the lazy dog again"), (1, None), (2, ""), (3, "the quick brown fox jumps over the lazy dog again")], "item_id long, text string")
    texts = [*ODD, "x The  quick brown\nfox jumps over the lazy dog again y", "the quick brown fox"]
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    assert sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.contained(docs, items).collect()) == [(9, 0, 0), (9, 3, 0)]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contained(docs, items, most_chars=10).collect()) == [(9, 0), (9, 3)]
    assert [r.doc_id for r in decontaminate.clean(docs, items).orderBy("doc_id").collect()] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10]
    assert decontaminate.clean(docs, items).columns == docs.columns
    assert decontaminate.contained(docs, items.limit(0)).count() == 0 and decontaminate.contained(docs.limit(0), items).count() == 0


# ---- personal data


def plain_spans(t: str) -> list:
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(6)
    for alphabet in ("a1234.@+- ()%b9", "0123456789 -", "1.2"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert plain_spans(t) == pii.detect(t), t


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail john.doe (at) mail7 (dot) example (dot) com now", [("email", "john.doe (at) mail7 (dot) example (dot) com")]),
        ("write to mary at example dot com today", [("email", "mary at example dot com")]),
        ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]),
        ("+１ (０１７) ５５５-７７１３ ok", [("phone", "+１ (０１７) ５５５-７７１３")]),
        ("four five three nine one four eight eight zero three four three six four six seven", [("card", "four five three nine one four eight eight zero three four three six four six seven")]),
        ("ip 10[.]20[.]30[.]40 x", [("ip", "10[.]20[.]30[.]40")]),
        ("10 dot 0 dot 0 dot 1", [("ip", "10 dot 0 dot 0 dot 1")]),
        ("a​b@c​.de", [("email", "a​b@c​.de")]),
        ("see you at example.com, one two three", []),
        ("stay-at-home.com and look-at-me.org, one-at-a-time.net", []),
        ("meet anna_b at noon.Then we go", []),
        ("v1.2 at host.name", []),
        ("look at the dot matrix", []),
        ("price (at) 5.50 each", []),
        ("j.doe at example.com", [("email", "j.doe at example.com")]),
        ("ask john99 at gmail.com", [("email", "john99 at gmail.com")]),
        ("jane-at-example-dot-org or", [("email", "jane-at-example-dot-org")]),
        ("first dot last at mail dot example dot de", [("email", "first dot last at mail dot example dot de")]),
        ("un deux trois soleil", []),
        (None, []),
    ],
)
def test_disguises(text, want):
    base, every = pii.spans(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in every if (a, k, b) not in base] == want


def test_long_runs_stay_cheap():
    for t in ("a" * 200_000, "1" * 200_000, "@" * 50_000, "+1" + "(" * 100_000, "1." * 100_000, "zero " * 20_000, "a@" * 50_000, "a dot " * 30_000, "a at b dot " * 10_000, "a-at-" * 30_000):
        pii.spans(t)


def test_pii_columns(spark):
    docs = spark.createDataFrame(rows_of([*ODD, "a@b.co and 1.2.3.4"]), DOCS)
    got = pii.find(docs, ["doc_id"]).orderBy("doc_id").collect()
    assert got[0].spans == "" and got[0].base_sha256 == got[1].base_sha256 and (got[9].n_email, got[9].n_ip, got[9].spans) == (1, 1, "email:0:6,ip:11:18")
    masked = pii.masked(docs)
    assert masked.columns == docs.columns
    out = masked.orderBy("doc_id").collect()
    clash = pii.masked(docs.select("doc_id", "text", docs.doc_id.alias("__masked"))).orderBy("doc_id").collect()
    assert clash[9]["__masked"] == 9 and clash[9].text == "[EMAIL] and [IP]"
    assert out[0].text is None and out[9].text == "[EMAIL] and [IP]" and out[9].n_chars == 16 and out[6].text == ODD[6]
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_disguise_after_a_valid_prefix():
    text = "write to john@mail.exаmple.com now"  # a Cyrillic letter
    base, every = pii.spans(text)
    assert [text[a:b] for a, _, b in base] == ["john@mail.ex"]
    assert [text[a:b] for a, _, b in every] == ["john@mail.ex", "john@mail.exаmple.com"]
    assert pii.mask_text(text) == "write to [EMAIL] now"


def test_learning_from_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert langid.train(docs)[0] == []
    for marks in (labels, some):
        assert quality.train(docs, marks).score("a") == 0.5 and toxicity.train(docs, marks).score(["a"]) == [0.0]


def test_equal_rows_and_a_third_of_all_under_one_id(spark):
    rows = [(7 if i % 3 == 0 else i, f"text {'abcde'[i % 5] * 8} of many words " * 3, "en", "s", None, "clash") for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    net = quality.Network()
    got = quality.score(docs, net).collect()
    assert len(got) == 90 and len({r.score for r in got}) == 5
    items = spark.createDataFrame([(0, "text dddddddd of many words")], "item_id long, text string")
    assert decontaminate.contained(docs, items).count() == 18 and decontaminate.clean(docs, items).count() == 72
    assert pii.masked(docs).count() == 90
