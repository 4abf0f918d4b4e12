"""The pipeline's stages on a small table: each decision takes effect, and clean documents stay."""

import corpus_pipeline
from tallyset.llm import queries


def test_stages(spark, tmp_path):
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    clean = [" ".join(words[(i * 7 + k * (i + 3)) % 100] for k in range(60)) for i in range(30)]
    item = "the quick brown fox jumps over the lazy dog and then runs home"
    texts = [*clean, clean[3], "123 456", None, "lead " + item.upper() + " tail", "write to jo@example.com " + " ".join(words[:50])]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, str(tmp_path))
        if name != "mixed":
            assert new.columns == docs.columns
        docs = spark.createDataFrame(new.collect(), new.schema)
        kept[name] = {r.doc_id for r in docs.collect()}
    everyone = set(range(len(texts)))
    assert kept["language"] == everyone - {31, 32}
    assert kept["near_duplicates"] == kept["language"] - {30}
    assert kept["benchmark"] == kept["near_duplicates"] - {33}
    assert kept["personal_data"] == kept["benchmark"]
    assert {r.text for r in docs.collect() if r.doc_id == 34} <= {"write to [EMAIL] " + " ".join(words[:50])}
    assert kept["mixed"] <= kept["benchmark"] and len(kept["mixed"]) > 20
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_every_operator_is_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
