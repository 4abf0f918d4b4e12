"""Edge semantics of the operators."""

import pytest
from pyspark.sql import functions as F

from tallyset.operators import agents, aggregates, candidates, chunking, constraints, kb, metrics, protocols, qrels, retrieval, selection, stats, wikitext
from tallyset.sources import readers, writers


def test_aggregate_validity(spark):
    rows = spark.createDataFrame([("one", 1.0), ("two", 0.0), ("two", 4.0), ("ties", 3.0), ("ties", 3.0), ("ties", 3.0), ("four", 1.0), ("four", 2.0), ("four", 4.0), ("four", 10.0)], "g string, v double")
    names = {"SUM": (), "SUM_TOP_K": (2,), "MIN": (), "MEDIAN": (), "DIFFERENCE(MAX−MIN)": (), "RATIO(MAX/MIN)": (), "AVG_BOTTOM_K": (3,)}
    got = {r.g: r for r in aggregates.aggregate(rows, ["g"], "v", names).collect()}
    assert got["one"]["sum"] is None and got["two"]["min"] is None and got["two"].ratio_max_min is None and got["two"].median is None
    assert got["ties"].difference_max_min is None and got["ties"].sum_top_k == 6.0
    assert (got["four"].median, got["four"].sum_top_k, got["four"].difference_max_min, got["four"].avg_bottom_k) == (3.0, 14.0, 9.0, pytest.approx(7 / 3))
    with pytest.raises(ValueError):
        aggregates.operation("MODE")
    assert aggregates.allowed("Time") == ("EARLIEST", "LATEST", "AVG") and aggregates.allowed("x") == ("COUNT",)


def test_unique_mode(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 1), ("b", 2), ("b", 2), ("c", 1)], "g string, v int")
    assert [(r.g, r.v, r.n) for r in aggregates.unique_mode(rows, ["g"], "v").collect()] == [("a", 1, 2)]


def test_item_constraints(spark):
    rows = spark.createDataFrame([(["a", "b"],), ([],), (["a", "a"],)], "items array<string>")
    got = rows.select(*[constraints.items(n, F.col("items"), ["a", "z"]).alias(n) for n in ("HAS", "HAS_ANY", "HAS_ALL", "NOT_HAS_ALL")]).collect()
    assert [tuple(r) for r in got] == [(True, True, False, True), (False, False, False, True), (True, True, False, True)]
    assert all(not r.HAS_ALL or r.HAS_ANY for r in got)
    with pytest.raises(ValueError):
        constraints.predicate("Time", "GT", F.lit(1), 1)


def test_chain_stops_at_first_fit(spark):
    rows = spark.range(20).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = {r.g: (r.n_constraints, r.n_entities) for r in constraints.chain(rows, ["g"], [F.col("v") > 1, F.col("v") > 11, F.col("v") > 15], 2, 4).collect()}
    assert got == {0: (2, 4), 1: (2, 4)}


def test_metrics_edges(spark):
    rows = spark.createDataFrame([("none", [], ["a-1"]), ("empty", ["a-1"], []), ("twice", ["a-1", "b-1"], ["a-1", "a-1", "c-1"]), ("entity", ["a-1"], ["a-2", "a-3"])], "qid string, gold array<string>, found array<string>")
    got = {r.qid: r for r in metrics.ranking_bundle(rows, ks=(3,)).collect()}
    assert got["none"].recall_3 == 0 and got["none"].ap == 0 and got["none"].ndcg_3 == 0 and got["empty"].precision_3 == 0 and got["empty"].mrr == 0
    assert got["twice"].recall_3 == 0.5 and got["twice"].precision_3 == pytest.approx(1 / 3) and got["twice"].ap == pytest.approx(1.0) and got["twice"].mrr == 1.0
    assert got["twice"].ndcg_3 == pytest.approx(1.0)
    ents = {r.qid: r for r in metrics.entity_bundle(rows, ks=(1,)).collect()}
    assert ents["entity"].entity_recall == 1.0 and ents["entity"].num_retrieved_entities == 1 and ents["none"].entity_recall == 0.0


def test_recall_grows_with_k(spark):
    rows = spark.createDataFrame([("q", ["a", "b", "c"], ["x", "a", "y", "c", "b"])], "qid string, gold array<string>, found array<string>")
    r = metrics.ranking_bundle(rows, ks=(1, 2, 3, 4, 5)).first()
    assert [r[f"recall_{k}"] for k in (1, 2, 3, 4, 5)] == sorted(r[f"recall_{k}"] for k in (1, 2, 3, 4, 5))


def test_fusion(spark):
    steps = spark.createDataFrame([("q", 0, 1, "a"), ("q", 0, 2, "b"), ("q", 0, 3, "c"), ("q", 1, 1, "b"), ("q", 1, 2, "d")], "qid string, step int, rank int, doc string")
    got = sorted((r.rank, r.doc) for r in retrieval.fuse(steps).collect())
    assert got == [(1, "a"), (2, "b"), (3, "d"), (4, "c")] and retrieval.fuse(steps, cap=2).count() == 2


def test_searches(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, None)], "doc_id int, text string")
    hits = retrieval.bm25(spark.createDataFrame([("q", "red FOX"), ("none", "zzz")], "qid string, text string"), retrieval.bm25_index(docs), 5).collect()
    assert [(h.qid, h.doc) for h in sorted(hits, key=lambda h: h["rank"])] == [("q", 1), ("q", 2)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "doc int, embedding array<float>")
    got = retrieval.dense_search(v.select(F.col("doc").alias("qid"), "embedding"), v, 1, block=1).collect()
    assert {(r.qid, r.doc, r.score) for r in got} == {(1, 1, 1.0), (2, 2, 4.0)}
    assert retrieval.dense_search(v.limit(0).select(F.col("doc").alias("qid"), "embedding"), v, 1).count() == 0
    with pytest.raises(ValueError):
        retrieval.search("none", 1)


def test_impact_weights(spark):
    w = spark.createDataFrame([({"a": 2.5, "b": 0.001},)], "w map<string,double>")
    assert w.select(retrieval.quantized(F.col("w"))).first()[0] == {"a": 128}
    p = spark.createDataFrame([([[0.0, 1.0], [3.0, -1.0], [9.0, 9.0]], [1.0, 1.0, 0.0])], "l array<array<double>>, m array<double>")
    got = p.select(retrieval.pooled_impacts(F.col("l"), F.col("m"))).first()[0]
    assert got == pytest.approx([1.3862943611, 0.6931471806])
    assert p.select(retrieval.mean_pooled(F.col("l"), F.col("m"))).first()[0] == pytest.approx([1.5, 0.0])


def test_coverage_rules(spark):
    e = spark.createDataFrame([("q1", "e1", "p1"), ("q1", "e2", None), ("q2", None, None), ("q3", "e3", "p1"), ("q4", "e4", "p4")], "query_id string, entity_id string, page_id string")
    q = spark.createDataFrame([("q1", "p1-0000"), ("q4", "p4-0001")], "query_id string, doc_id string")
    own = {r.query_id: r.valid for r in qrels.coverage(e, q).collect()}
    assert own == {"q1": False, "q2": True, "q3": False, "q4": True}
    assert {r.query_id: r.valid for r in qrels.coverage(e, q, per_query=False).collect()} == {"q1": False, "q2": False, "q3": False, "q4": True}


def test_overlay_keeps_rows(spark):
    corpus = spark.createDataFrame([("a", "t", "x"), ("b", "t", "y")], "id string, title string, contents string")
    new = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two"), ("zz", 1, "lost")], "passage_id string, seq int, rewritten string")
    assert sorted((r.id, r.contents) for r in qrels.overlay(corpus, new).collect()) == [("a", "two"), ("b", "y")]


def test_routing_fallbacks(spark):
    rows = spark.createDataFrame([("a", 1, "NO-RELATED"), ("a", 2, "NO-RELATED"), ("b", 1, "NO-UNRELATED"), ("c", 1, "YES-DIFFERENT"), ("c", 2, "YES-SAME")], "e string, pos int, label string")
    first = sorted((r.e, r.pos, r.rewrite_type) for r in qrels.routed(rows, ["e"], "pos").collect())
    assert first == [("a", 1, "ADD"), ("c", 1, "REPLACE"), ("c", 2, None)]
    assert ("b", 1, "ADD") in {(r.e, r.pos, r.rewrite_type) for r in qrels.routed(rows, ["e"], "pos", fallback="any").collect()}


def test_judges_are_injected(spark):
    rows = spark.createDataFrame([("the Blue one", "blue"), ("red", "green"), ("Yes sir", "yes")], "contents string, value string")
    got = qrels.judged(rows, lambda: lambda b: ["YES-DIFFERENT"] * len(b), shortcut=("contents", "value"))
    assert {r.contents: r.label for r in got.collect()} == {"the Blue one": "YES-SAME", "red": "YES-DIFFERENT", "Yes sir": "YES-DIFFERENT"}

    def broken():
        def ask(b):
            raise RuntimeError

        return ask

    assert {r.label for r in qrels.judged(rows, broken).collect()} == {"NO-UNRELATED"}


def test_kb(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "a")], "child string, parent string")
    up = kb.closure(edges)
    assert {(r.node, r.ancestor) for r in up.collect()} >= {("c", "a"), ("c", "c"), ("d", "a")} and up.count() == 8
    classes = spark.createDataFrame([("a",), ("b",), ("d",)], "class_id string")
    assert sorted(r.class_id for r in kb.most_specific(classes, up).collect()) == ["b", "d"]
    st = spark.createDataFrame([("e", "1", "p", "normal"), ("e", "2", "p", "preferred"), ("f", "3", "p", "normal"), ("f", "4", "p", "deprecated"), ("g", "5", "p", "deprecated")], "entity_id string, stmt_id string, prop_id string, rank string")
    assert sorted(r.stmt_id for r in kb.truthy(st).collect()) == ["2", "3"]
    assert [r.prop_id for r in kb.full_properties(st, st.select("entity_id")).collect()] == ["p"]


def test_selection(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert selection.sample(rows, "k", n=7).count() == 7 and selection.sample(rows, "k").count() == 1000
    assert {r.k for r in selection.sample(rows, "k", share=0.3).collect()} == {r.k for r in selection.sample(rows.repartition(5), "k", share=0.3).collect()}
    c = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), ("y", "q")], "class_id string, prop_id string")
    got = selection.balanced(c).collect()
    assert sorted(r.class_id for r in got) == ["x", "y"] and len({r.prop_id for r in got}) == 2


def test_wilcoxon(spark):
    a = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8])], "qid int, m double")
    b = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 2, 2, 2, 3, 9])], "qid int, m double")
    w = stats.wilcoxon(stats.paired(a, b, "m"))
    assert w["n"] == 7 and w["statistic"] == 1.5 and 0.01 < w["p_value"] < 0.05
    assert stats.wilcoxon(stats.paired(a, a, "m"))["p_value"] == 1.0
    r = stats.compare(a, b, "m", resamples=300).first()
    assert r.low <= r.mean_diff <= r.high


# ---- passages and wikitext


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (19, 0), (20, 1), (100, 1), (101, 1), (120, 2)])
def test_word_chunks(spark, n, chunks):
    docs = spark.createDataFrame([("", "T", " ".join("w" for _ in range(n)) or " ")], "doc_id string, title string, text string")
    got = chunking.word_chunks(docs).collect()
    assert len(got) == chunks and all(len(r.doc_id) == 12 and r.id.endswith(f"-{r.chunk_idx:04d}") for r in got)


def test_sections():
    text = "lead\n# Page\nx\n## A.\na\n### B\nb\n## C\nc"
    got = [(text[a:b].split("\n")[0], t) for a, b, t in chunking.sections(text)]
    assert got == [("lead", []), ("## A.", ["A"]), ("### B", ["A", "B"]), ("## C", ["C"])]
    parent = chunking.sections(text)[1]
    assert "### B" in text[parent[0] : parent[1]]


def test_parts():
    text = "One. Two.\n- i1\n- i2\nmore\n--- List:Start ---\n- x\njunk\n--- List:End ---\n--- Infobox:Start ---\na = 1\nb\n--- Infobox:End ---\n--- List:End ---\nend"
    assert [(p.kind, p.units) for p in chunking.parts(text)] == [("text", ["One.", "Two."]), ("list", ["i1", "i2"]), ("text", ["more"]), ("list", ["x"]), ("box", ["a: 1", "b"]), ("text", ["end"])]
    assert [p.kind for p in chunking.parts("--- List:Start ---\n- a\n- b")] == ["list"]


def test_section_chunks(spark):
    say = lambda n, c="W": " ".join([c] + ["w"] * (n - 2) + ["w."])
    got = list(chunking.section_chunks(f"## H\n{say(6)} {say(6)} {say(3)}\n- {say(4)}", 10))
    assert [(len(c.split()), t) for c, t in got] == [(12, ["H"]), (7, ["H"])]
    box = "--- Infobox:Start ---\n" + "\n".join(f"k{i} = a b c" for i in range(6)) + "\n--- Infobox:End ---\nTail."
    chunks = [c for c, _ in chunking.section_chunks(box, 10)]
    assert all(c.startswith("Infobox:") for c in chunks) and chunks[-1].endswith("Tail.")
    docs = spark.createDataFrame([("d", "T", f"## H\n{say(30)}"), ("e", "", "x"), ("f", "T", None)], "doc_id string, title string, text string")
    rows = chunking.context_chunks(docs, width=20).collect()
    assert [(r.id, r.section) for r in rows] == [("d-0000", ["H"])]


def test_wikitext():
    ex = wikitext.Expander({"Greet": "Hello {{{1|you}}}{{{x|}}}", "Deep": "{{Greet|{{Greet}}}}", "Loop": "{{Loop}}"}, {"Hi": "Greet"}, discard=frozenset({"Gone"}))
    cases = {
        "{{Hi|Bob|x=!}}": "Hello Bob!", "{{Deep}}": "Hello Hello you", "{{Loop}}": "", "{{unknown}}": "", "{{convert|5|km|mi}}": "5 km",
        "{{#if: a | yes | no }}": "yes", "{{#if: | yes | no }}": "no", "{{#ifeq: a | a | 1 | 2}}": "1", "{{#switch: b | a=1 | b | c=2 | #default=3}}": "2", "{{#switch: z | a=1 | #default=3}}": "3",
        "{{#expr: 2 + 3 * 4}}": "14", "{{#iferror: {{#expr: 1/0}} | bad | ok}}": "bad", "{{#expr: __import__('os')}}": '<strong class="error">', "{{lc:ABC}}": "abc", "{{padleft:7|3|0}}": "007",
        "{{CURRENTYEAR}}": "2025",
    }
    for text, want in cases.items():
        assert ex.expand(text).strip() == want, text
    clean = lambda t: wikitext.clean(t, ex).strip()
    assert clean("'''Bold''' [[Target|shown]] [[File:a.png|thumb|[[x]]]] [http://x.org site] a<ref>gone</ref>&amp;b") == "Bold shown site a&b"
    assert clean("x {| class=t\n|-\n| cell {| inner |}\n|} y") == "x y"
    assert clean("[[unclosed and {{open") == "[[unclosed and {{open"
    page = "{{Infobox city|name=X|box={{Infobox in|a=1}}|pop = [[n|5]]}}\nText.\n== Empty ==\n== Full ==\n* item\n=== Sub ===\nmore\n== References ==\nr\n=== under ===\nq"
    got = wikitext.page_text(page, ex, frozenset({"References"}))
    assert got == "--- Infobox:Start ---\nname = X\npop = 5\n--- Infobox:End ---\nText.\n## Full\n- item\n### Sub\nmore"
    assert wikitext.page_text("{{Gone}} text", ex) is None


# ---- readers, writers and agents


def test_trec_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("q1 0 d1 1\nq1 0 d2 0\nshort\nq1 0 d1 2\n")
    got = readers.qrels(spark, str(tmp_path / "q.txt")).orderBy("pos").collect()
    assert [(r.query_id, r.doc_id, r.relevance) for r in got] == [("q1", "d1", 1), ("q1", "d1", 2)]
    (tmp_path / "r.txt").write_text("q Q0 d1 1 x run\nq Q0 d2 2 0.5 run\nbad line\n")
    assert [(r.pid, r.score) for r in readers.run(spark, str(tmp_path / "r.txt")).orderBy("pos").collect()] == [("d1", 0.0), ("d2", 0.5)]
    rows = spark.createDataFrame([("q", "d", 1, 0.25, "r")], "qid string, pid string, rank int, score double, run_id string")
    assert writers.run_lines(rows).first().value == "q Q0 d 1 0.2500 r"


def test_document_readers(spark, tmp_path):
    (tmp_path / "wiki_00").write_text('<doc id="1" url="u" title="A">\nbody one\n</doc>\n<doc id="2" title="B">\ntail')
    (tmp_path / "x.jsonl").write_text('\n{"_id": "3", "title": "C", "contents": "c"},\n{"title": "", "text": "no"}\nbroken\n')
    assert readers.document_format(spark, str(tmp_path / "x.jsonl")) == "jsonl" and readers.document_format(spark, str(tmp_path / "wiki_00")) == "doc"
    assert sorted((r.doc_id, r.title, r.text) for r in readers.document_tree(spark, str(tmp_path)).collect()) == [("1", "A", "body one"), ("2", "B", "tail"), ("3", "C", "c")]
    assert [r.doc_id for r in readers.documents(spark, str(tmp_path / "x.jsonl")).collect()] == ["3"]


def test_query_set(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "a", "answer": {"type": "n", "value": 2.5}}\n{"qid": "2", "query": "b", "answer": 7}\n{"qid": "2", "ask": "c", "best": 9, "answer": 7}\n')
    got = sorted((r.qid, r.question, r.answer, r.answer_type) for r in readers.query_set(spark, str(tmp_path / "q.jsonl"), ("ask", "query", "question"), ("best",)).collect())
    assert got == [("1", "a", 2.5, "n"), ("2", "c", 9.0, None)]


def test_dump_reader(spark, tmp_path):
    page = "<page><title>{t}</title><ns>{n}</ns><id>{i}</id>{r}<revision><id>9</id><text>{x}</text></revision></page>"
    body = page.format(t="A", n=0, i=1, r="", x="text a") + page.format(t="B", n=0, i=2, r='<redirect title="A"/>', x="#R") + page.format(t="Template:T", n=10, i=3, r="", x="x&lt;noinclude&gt;doc&lt;/noinclude&gt;y") + page.format(t="A", n=0, i=1, r="", x="text a")
    (tmp_path / "d.xml").write_text(f"<mediawiki><siteinfo><sitename>S</sitename><base>https://en.x.org/</base></siteinfo>{body}</mediawiki>")
    rows = readers.dump_rows(spark, str(tmp_path / "d.xml"))
    assert [(r.page_id, r.wikitext) for r in readers.articles(rows).collect()] == [(1, "text a")]
    assert [(r.name, r.body) for r in readers.template_rows(rows).collect()] == [("T", "xy")]
    assert readers.site_info(spark, str(tmp_path / "d.xml")).first().language == "en"


def test_fixture_source(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Q1": {"label": "x"}, "Q2": "y"}')
    got = readers.answers(spark, f"{tmp_path}/*.json").collect()
    assert {(r.key, r.value) for r in got} == {("Q1", '{"label":"x"}'), ("Q2", "y")}


def test_lines_keep_the_order_of_their_files(spark, tmp_path):
    lines = [f'{{"passage_id": "p", "query_id": "{i}", "rewrite_type": "{"x" * 200}"}}' for i in range(4000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:3900]))
    (tmp_path / "b.jsonl").write_text("\n".join(lines[3900:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = readers.rewrites(spark, str(tmp_path))
        assert [r.query_id for r in rows.orderBy("seq").collect()] == [str(i) for i in range(4000)]
        assert readers.last_of(rows, "passage_id", "seq").first().query_id == "3999"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_vectors_are_numbered_over_files(spark, tmp_path):
    import numpy as np

    for name, low in (("a.bin", 0), ("b.bin", 3)):
        np.arange(low * 2, low * 2 + 6, dtype="<f4").tofile(tmp_path / name)
    got = sorted((r.vec_id, r.embedding) for r in readers.vectors(spark, str(tmp_path), 2).collect())
    assert got == [(i, [2.0 * i, 2.0 * i + 1]) for i in range(6)]


def test_compressed_lines_are_read(spark, tmp_path):
    import bz2
    import gzip

    text = b'{"id": "1", "title": "A", "text": "a"}\n'
    (tmp_path / "x.jsonl.gz").write_bytes(gzip.compress(text))
    (tmp_path / "y.jsonl.bz2").write_bytes(bz2.compress(text.replace(b"1", b"2")))
    assert {r.doc_id for r in readers.tolerant_jsonl(spark, str(tmp_path)).collect()} == {"1", "2"}


def test_agents(spark, tmp_path):
    queries = spark.createDataFrame([("q1", "red?"), ("q2", "done?")], "qid string, question string")

    def make():
        def asked(t):
            with open(tmp_path / "calls", "a") as f:
                f.write("x")
            return said(t)

        return asked

    def said(t):
        return (lambda t: {"think": "t", "answer": "7"} if "d1" in t or t.startswith("done") else {"think": "hm", "search": "red"})(t)

    found = lambda q: q.select("qid", F.lit("d1").alias("doc"), F.lit(1).alias("rank"))
    got = {r.qid: r for r in agents.stepwise(queries, make, found, most=3).collect()}
    assert (tmp_path / "calls").read_text() == "xxx"  # once for each open query and step
    assert got["q1"].answer == "7" and [s.doc_ids for s in got["q1"].steps] == [["d1"]] and got["q2"].steps == []
    rows = agents.path_steps(spark.createDataFrame([("q", [("a", "s", ["x", "y"]), ("b", "s", [])])], "qid string, reasoning_path " + agents.STEP)).collect()
    assert [(r.step, r["rank"], r.doc) for r in rows] == [(0, 0, "x"), (0, 1, "y")]


# ---- plans that hold for large groups


def test_closure_ends_on_circles_and_ladders(spark):
    circle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "d"), (None, "a")], "child string, parent string")
    assert {(r.node, r.ancestor) for r in kb.closure(circle).collect()} == {(x, y) for x in "abc" for y in "abc"} | {("d", y) for y in "abcd"}
    rungs = [(f"{s}{i}", f"{t}{i + 1}") for i in range(25) for s in "xy" for t in "xy"]
    got = kb.closure(spark.createDataFrame(rungs, "child string, parent string"))
    assert got.count() == sum(1 + 2 * (25 - i) for i in range(26) for _ in "xy")


def test_pairwise_distance_in_blocks(spark):
    import math
    import random

    rng = random.Random(4)
    rows = [(g, i, rng.uniform(-80, 80), rng.uniform(-170, 170)) for g in ("a", "b") for i in range(40)] + [("a", 0, 1.0, 1.0), ("a", 99, None, None), ("c", 1, 0.0, 0.0)]

    def km(p, q):
        la, lo, lb, lob = map(math.radians, (*p[2:], *q[2:]))
        return 2 * 6371.0 * math.asin(math.sqrt(min(1, math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lob - lo) / 2) ** 2)))

    docs = spark.createDataFrame(rows, "g string, e long, lat double, lon double")
    for block in (7, 4096):
        got = {r.g: r for r in aggregates.pairwise_distance(docs, ["g"], "e", block=block).collect()}
        assert set(got) == {"a", "b"}
        for g in got:
            own = [r for r in rows if r[0] == g]
            pairs = [(p, q) for i, p in enumerate(own) for q in own[:i] if p[1] != q[1]]
            far = [km(p, q) for p, q in pairs if None not in (*p, *q)]
            assert got[g].n_pairs == len(pairs) and abs(got[g].max_km - max(far)) < 1e-6 and abs(got[g].min_km - min(far)) < 1e-6


def test_documents_that_hold_an_item(spark):
    docs = spark.createDataFrame([(1, "a red fox"), (2, "red"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "red"), ("y", "red fox"), ("z", "blue"), ("w", "red"), ("e", ""), ("n", None)], "item string, text string")
    for most in (1, 100):
        got = {(r.item, r.doc) for r in retrieval.holding(docs, items, most_chars=most).collect()}
        assert got == {("x", 1), ("x", 2), ("w", 1), ("w", 2), ("y", 1)}
    assert retrieval.holding(docs, items.limit(0)).count() == 0


def test_search_without_an_index_is_as_with_one(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} common {'extra ' * (i % 4)}") for i in range(12)] + [(99, None)], "doc_id long, text string")
    queries = spark.createDataFrame([("p", "word1 common"), ("q", "extra zebra"), ("r", "")], "qid string, text string")
    a = sorted(tuple(r) for r in retrieval.bm25(queries, retrieval.bm25_index(docs), 5).select("qid", "doc", "score", "rank").collect())
    assert a == sorted(tuple(r) for r in retrieval.bm25_scan(queries, docs, 5).select("qid", "doc", "score", "rank").collect()) and len(a) == 10


def test_a_judge_that_fails_on_one_row(spark):
    rows = spark.createDataFrame([("a",), ("bad",), ("c",)], "contents string").coalesce(1)

    def make():
        def ask(b):
            if "bad" in set(b["contents"]):
                raise ValueError("no")
            return ["YES-SAME"] * len(b)

        return ask

    got = {r.contents: (r.label, r.error) for r in qrels.judged(rows, make).collect()}
    assert got == {"a": ("YES-SAME", None), "bad": ("NO-UNRELATED", "ValueError: no"), "c": ("YES-SAME", None)}


def test_exact_signed_ranks(spark):
    a = spark.createDataFrame([(i, float(d)) for i, d in enumerate([1, 2, 3, -4, 5, 6, 7, -8])], "qid long, m double")
    b = a.withColumn("m", F.lit(0.0))
    got = stats.wilcoxon(stats.paired(a, b, "m"))
    every = [sum(r for r in range(1, 9) if s >> (r - 1) & 1) for s in range(256)]
    assert (got["n"], got["statistic"]) == (8, 12.0) and abs(got["p_value"] - 2 * sum(x <= 12 for x in every) / 256) < 1e-12


def test_greedy_choice_is_its_loop_and_has_a_bound(spark):
    pairs = [(f"c{i % 7}", f"p{i % 5}") for i in range(60)] + [("c9", "p0")]
    c = spark.createDataFrame(pairs, "class_id string, prop_id string")
    got = selection.balanced(c, per_class=2).collect()
    held = {k: {p for x, p in pairs if x == k} for k in {k for k, _ in pairs}}
    used, order = {}, []
    for r in got:
        order.append(r.class_id)
        least = min(used.get(p, 0) for p in held[r.class_id] - {x.prop_id for x in got[: len(order) - 1] if x.class_id == r.class_id})
        assert used.get(r.prop_id, 0) == least
        used[r.prop_id] = used.get(r.prop_id, 0) + 1
    assert order == [k for k in sorted(held, key=lambda k: (len(held[k]), k)) for _ in range(min(2, len(held[k])))]
    with pytest.raises(ValueError):
        selection.balanced(c, most_rows=3)


# ---- agents' protocols

SAID = {
    "research": ("<think>hm</think><search> search query: red </search>", "<think>so</think><answer> \\boxed{ 7 } </answer>", "<result>Doc 1 (Title: T) The red one. More"),
    "search_r1": ("<think>hm</think><search>red</search>", "<answer>7</answer>", "<information>Doc 1 (Title: T) The red one. More"),
    "step_search": ("<think>hm</think><search> red </search>", "<answer> 7 </answer>", "<information>Doc 1 (Title: T) The red one. More"),
    "search_o1": ("hm <|begin_search_query|>red<|end_search_query|>", "so \\boxed{7}", "<|begin_search_result|>Doc 1 (Title: T) The red one. More"),
    "react": ("hm\nAction 1: Search[red]", "so\nAction 2: Finish[7]", "Observation 1: Doc 1 (Title: T) The red one. More"),
    "self_ask": ("hm\nFollow up: red", "So the final answer is: 7", "Intermediate answer: Doc 1 (Title: T) The red one. More"),
}


@pytest.mark.parametrize("name", sorted(SAID))
def test_protocols(spark, name):
    first, last, shown = SAID[name]
    queries = spark.createDataFrame([("q1", "which?"), ("q2", "never?")], "qid string, question string")
    corpus = spark.createDataFrame([("d1", "T", "The red one. More")], "id string, title string, contents string")

    def make():
        return lambda prompts: ["lost" if p.startswith("never") else last if shown in p else first for p in prompts]

    found = lambda q: q.filter("text = 'red'").select("qid", F.lit("d1").alias("doc"), F.lit(1).alias("rank"))
    got = {r.qid: r for r in protocols.run(name, queries, make, found, corpus, most=3).collect()}
    assert (got["q1"].answer, [(s.think, s.search_query, s.doc_ids) for s in got["q1"].steps]) == ("7", [("hm", "red", ["d1"])])
    assert (got["q2"].answer, got["q2"].steps) == (None, [])


def test_a_look_up_reads_the_last_page(spark):
    queries = spark.createDataFrame([("q", "which?")], "qid string, question string")
    corpus = spark.createDataFrame([("d1", "T", "The red one. More red. Blue")], "id string, title string, contents string")

    def make():
        def say(p):
            if "Observation 2: (Result 1 / 2) The red one" in p and p.endswith("Thought 3:"):
                return "Action 3: Finish[ok]"
            return "Action 2: Lookup[RED]" if "Observation 1:" in p else "Action 1: Search[x]"

        return lambda prompts: [say(p) for p in prompts]

    found = lambda q: q.select("qid", F.lit("d1").alias("doc"), F.lit(1).alias("rank"))
    assert protocols.run("react", queries, make, found, corpus).first().answer == "ok"


# ---- candidates and rewrites


def test_a_quota_takes_the_least_used(spark):
    rows = [("x", f"c{i}", f"a{j}", i != j) for i in range(4) for j in range(4)] + [("y", "c0", "a0", False)]
    options = spark.createDataFrame(rows, "category string, constrained string, aggregated string, fits boolean")
    got = candidates.filled_quota(options, quota=4).collect()
    assert len(got) == 4 and {r.category for r in got} == {"x"} and all(r.constrained[1] != r.aggregated[1] for r in got)
    assert len({r.constrained for r in got}) == 4 and len({r.aggregated for r in got}) >= 3
    assert candidates.filled_quota(options, quota=100, most_tries=1).filter("category = 'x'").count() == 12
    assert sorted(map(tuple, got)) == sorted(map(tuple, candidates.filled_quota(options.repartition(3), quota=4).collect()))


def test_a_rewriter_that_fails_on_one_row(spark):
    rows = spark.createDataFrame([("a", "REPLACE", "x  y", "v", 1), ("b", "ADD", "bad", "v", 2), ("c", "ADD", "none", "v", 3), ("d", None, "z", "v", 4)], "passage_id string, rewrite_type string, contents string, value string, pos long")

    def make():
        def write(contents, value):
            if contents == "bad":
                raise ValueError("no")
            return "" if contents == "none" else f" {contents} \n {value} "

        return write

    got = {r.passage_id: (r.rewritten, r.error) for r in qrels.rewritten(rows, make).collect()}
    assert got == {"a": ("x y v", None), "b": (None, "ValueError: no"), "c": (None, "empty")}


def test_files_of_about_a_size(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id"), F.lit("x" * 80).alias("contents"))
    writers.passages(rows, str(tmp_path / "p"), file_bytes=40_000)
    sizes = [p.stat().st_size for p in (tmp_path / "p").glob("*.json")]
    assert len(sizes) == 6 and max(sizes) < 45_000 and readers.line_count(spark, str(tmp_path / "p")) == 2000
