"""Retrieval: BM25, impact and dense search, stored runs, reranking and fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..staging import staged

TOKEN = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN), lambda t: t != "")


def bm25_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """Tables of an index: postings (term, doc, tf), doc_stats (doc, dl), term_stats (term, df)."""
    words = docs.select(F.col(doc_id).alias("doc"), tokens(F.col(text)).alias("t"))
    postings = words.select("doc", F.explode("t").alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf"))
    return {"postings": postings, "doc_stats": words.select("doc", F.size("t").alias("dl")), "term_stats": postings.groupBy("term").agg(F.count("*").alias("df"))}


def bm25(queries: DataFrame, index: dict[str, DataFrame], k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(qid, doc, score, rank): the k best for each query (qid, text) by a stored index. Only the queries' terms leave the
    postings; scores are rounded to six decimals, and ties go to the least doc."""
    terms = query_terms(queries)
    held = index["postings"].join(terms.select("term").distinct(), "term")
    return scored(terms, held.join(index["doc_stats"], "doc"), index["doc_stats"], k, k1, b)


def bm25_scan(queries: DataFrame, docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """As bm25(), without an index: the tokens of docs that no query has go before any are counted or moved."""
    terms = query_terms(queries)
    words = docs.select(F.col(doc_id).alias("doc"), tokens(F.col(text)).alias("t")).select("doc", "t", F.size("t").alias("dl"))
    met = words.select("doc", "dl", F.explode("t").alias("term")).join(terms.select("term").distinct(), "term")
    held = staged(met.groupBy("term", "doc", "dl").agg(F.count("*").alias("tf")))
    return scored(terms, held, words, k, k1, b)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def scored(terms: DataFrame, held: DataFrame, lengths: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """The k best by terms (qid, term, qtf), postings of these terms (term, doc, tf, dl) and the lengths (dl) of all docs."""
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighed = held.join(df, "term").join(F.broadcast(corpus)).select("term", "doc", weight.alias("w"))  # corpus is one row
    return best(weighed.join(terms, "term").groupBy("qid", "doc").agg(F.round(F.sum(F.col("w") * F.col("qtf")), 6).alias("score")), k)


def holding(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", most_chars: int = 4_000_000) -> DataFrame:
    """(item, doc) for each item (item, text) whose text stands in a document: a stated set of items against all documents,
    by an automaton for each block of items of most_chars characters. The driver holds one block at a time, and so do tasks.
    Null and empty items are in no document."""
    spark, parts = docs.sparkSession, []
    kind = T.StructType([T.StructField("item", items.schema["item"].dataType), T.StructField("doc", docs.schema[doc_id].dataType)])
    for block in text_blocks(items, most_chars):

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            by_text: dict[str, list] = {}
            for item, t in block:
                by_text.setdefault(t, []).append(item)
            for t in by_text:
                automaton.add_word(t, t)
            automaton.make_automaton()
            for batch in batches:
                found = [(i, d) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for w in {w for _, w in automaton.iter(t)} for i in by_text[w]]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], to_arrow_type(f.dataType)) for c, f in enumerate(kind)], names=kind.names)

        parts.append(docs.select(doc_id, text).mapInArrow(run, kind))
        if len(parts) > 1:
            parts = [staged(parts[0].unionByName(parts[1]))]
    return parts[0] if parts else spark.createDataFrame([], kind)


def text_blocks(items: DataFrame, most_chars: int) -> Iterator[list[tuple]]:
    """Items (item, text) in blocks of most_chars characters at most (a longer one is a block), one block at a time."""
    block: list[tuple] = []
    held = 0
    for r in items.select("item", "text").filter("text <> ''").toLocalIterator():
        if block and held + len(r.text) > most_chars:
            yield block
            block, held = [], 0
        block.append((r.item, r.text))
        held += len(r.text)
    if block:
        yield block


def best(hits: DataFrame, k: int, qid: str = "qid", doc: str = "doc", score: str = "score") -> DataFrame:
    """The k best of each query with their rank: a ranked limit, so Spark keeps k a task before the shuffle."""
    w = Window.partitionBy(qid).orderBy(F.desc(score), doc)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def quantized(weights: Column, scale: float = 5.0, levels: int = 256) -> Column:
    """Impact weights (map of token to float) as whole numbers; those under 1 go."""
    q = F.transform_values(weights, lambda t, w: F.round(w / scale * levels).cast("int"))
    return F.map_filter(q, lambda t, w: w >= 1)


def pooled_impacts(token_logits: Column, mask: Column) -> Column:
    """For each vocabulary entry the maximum over a text's tokens of log(1 + max(logit, 0)), masked tokens out.
    token_logits: an array over tokens of arrays over the vocabulary."""
    active = F.transform(F.arrays_zip(token_logits.alias("l"), mask.alias("m")), lambda x: F.transform(x["l"], lambda v: F.log1p(F.greatest(v, F.lit(0.0))) * x["m"]))
    return F.aggregate(F.slice(active, F.lit(2), F.greatest(F.size(active) - 1, F.lit(0))), F.get(active, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))


def weights(vectors: DataFrame, key: str) -> DataFrame:
    """Rows (key, token, weight) of vectors (key, vector) that are maps."""
    return vectors.select(key, F.explode("vector").alias("token", "weight"))


def impact_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, doc, score, rank) by the dot product of whole-number vectors: queries (qid, token, weight), docs (doc, token,
    weight)."""
    q = queries.select("qid", "token", F.col("weight").alias("qw"))
    return best(docs.join(q, "token").groupBy("qid", "doc").agg(F.sum(F.col("qw").cast("long") * F.col("weight")).alias("score")), k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(n > 0, F.transform(a, lambda v: v / n)).otherwise(F.transform(a, lambda v: v.cast("double")))


def mean_pooled(states: Column, mask: Column) -> Column:
    """The mean of token vectors under a 0/1 mask."""
    masked = F.zip_with(states, mask, lambda s, m: F.transform(s, lambda v: v.cast("double") * m))
    zero = F.transform(F.get(states, F.lit(0)), lambda v: F.lit(0.0))
    n = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)
    return F.transform(F.aggregate(masked, zero, lambda a, s: F.zip_with(a, s, lambda x, y: x + y)), lambda v: F.try_divide(v, n))


def first_pooled(states: Column) -> Column:
    return F.get(states, F.lit(0))


def model_text(title: Column, contents: Column, style: str = "plain") -> Column:
    """What a document encoder reads."""
    return F.concat(F.lit("passage: " if style == "e5" else ""), F.lit('"'), F.coalesce(title, F.lit("")), F.lit('"\n'), F.coalesce(contents, F.lit("")))


def query_text(text: Column, style: str = "plain") -> Column:
    return F.concat(F.lit({"e5": "query: ", "bge": "Represent this sentence for searching relevant passages: "}.get(style, "")), text)


def dense_search(queries: DataFrame, docs: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(qid, doc, score, rank) by exact inner product: a stated query set (qid, embedding) against all docs (doc,
    embedding), in blocks of queries. A block is at most `block` rows, and is all that the driver holds and tasks get; a
    task multiplies it with each batch of docs and hands on k hits a query, and those that equal the last of them."""
    kind = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("doc", docs.schema["doc"].dataType), T.StructField("score", T.DoubleType())])
    parts = []
    for names, matrix in vector_blocks(queries, block):

        def run(batches: Iterator[pa.RecordBatch], names: list = names, matrix: np.ndarray = matrix) -> Iterator[pa.RecordBatch]:
            kept: list[list[tuple[float, object]]] = [[] for _ in names]
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), batch.column(1)
                if not len(ids):
                    continue
                m = np.array(rows.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(ids), -1)
                for q, scores in enumerate(np.round(matrix @ m.T, 6)):
                    floor = np.partition(scores, -k)[-k] if len(scores) > k else -np.inf
                    all_ = kept[q] + [(float(scores[i]), ids[i]) for i in np.flatnonzero(scores >= floor - 2e-6)]
                    if len(all_) > k:
                        last = sorted((s for s, _ in all_), reverse=True)[k - 1] - 2e-6
                        all_ = [x for x in all_ if x[0] >= last]
                    kept[q] = all_
            found = [(n, d, s) for n, hits in zip(names, kept, strict=True) for s, d in hits]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], to_arrow_type(f.dataType)) for c, f in enumerate(kind)], names=kind.names)

        hits = docs.select("doc", "embedding").filter("doc is not null and embedding is not null").mapInArrow(run, kind)
        parts.append(best(hits.withColumn("score", F.round("score", 6)), k))
        if len(parts) > 1:
            parts = [staged(parts[0].unionByName(parts[1]))]
    return parts[0] if parts else docs.sparkSession.createDataFrame([], T.StructType([*kind, T.StructField("rank", T.IntegerType())]))


def vector_blocks(queries: DataFrame, block: int) -> Iterator[tuple[list, np.ndarray]]:
    """Queries as (ids, matrix), `block` rows at most at a time."""
    held: list = []
    for r in queries.select("qid", "embedding").filter("embedding is not null").toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield [r.qid for r in held], np.array([r.embedding for r in held], dtype=np.float64)
            held = []
    if held:
        yield [r.qid for r in held], np.array([r.embedding for r in held], dtype=np.float64)


def oracle_search(qrels: DataFrame, k: int) -> DataFrame:
    """The first k gold ids of each query in file order, with score 1."""
    w = Window.partitionBy("query_id").orderBy("pos")
    return qrels.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("query_id").alias("qid"), F.col("doc_id").alias("doc"), F.lit(1.0).alias("score"), "rank")


def stored_search(run: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """A stored run's first k ids of each query that the corpus has, each with its own score, ranked anew."""
    w = Window.partitionBy("qid").orderBy("pos")
    first = run.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
    kept = first.join(corpus.select(F.col("id").alias("pid")).distinct(), "pid", "left_semi")
    return kept.select("qid", F.col("pid").alias("doc"), "score", F.row_number().over(Window.partitionBy("qid").orderBy("__r")).alias("rank"))


def rerank(hits: DataFrame, scored: Callable[[DataFrame], DataFrame], k: int, first: int = 1000) -> DataFrame:
    """The k best by a second score among the first hits of each query. scored adds `second` to (qid, doc, score, rank)."""
    w = Window.partitionBy("qid").orderBy(F.desc("second"), "doc")
    out = scored(hits.filter(F.col("rank") <= first)).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
    return out.select("qid", "doc", F.col("second").alias("score"), F.col("__r").alias("rank"))


def encoded(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], text: str, out: str = "embedding") -> DataFrame:
    """rows with a vector from an injected encoder, which is made once a task."""
    schema = T.StructType([*rows.schema, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for b in batches:
            yield b.assign(**{out: encode(b[text].fillna("").tolist())})

    return rows.mapInPandas(run, schema)


RETRIEVERS = ("bm25", "dense", "impact", "oracle", "stored")


def search(kind: str, k: int, **tables) -> DataFrame:
    """One signature for every retriever."""
    makers = {
        "bm25": lambda: bm25(tables["queries"], tables["index"], k),
        "dense": lambda: dense_search(tables["queries"], tables["docs"], k),
        "impact": lambda: impact_search(tables["queries"], tables["docs"], k),
        "oracle": lambda: oracle_search(tables["qrels"], k),
        "stored": lambda: stored_search(tables["run"], tables["corpus"], k),
    }
    if kind not in makers:
        raise ValueError(f"no retriever: {kind}")
    return makers[kind]()


def two_depths(hits: DataFrame, shown: int) -> DataFrame:
    """One ranked list for scoring; shown marks what a prompt gets."""
    return hits.withColumn("shown", F.col("rank") <= shown)


def fuse(steps: DataFrame, retriever: str = "bm25", cap: int | None = None) -> DataFrame:
    """Round robin over a query's search steps (qid, step, rank, doc): first ranks first, each document once; uncapped for
    metrics. (qid, doc, rank, score, run_id)."""
    once = Window.partitionBy("qid", "doc").orderBy("rank", "step")
    first = steps.withColumn("__o", F.row_number().over(once)).filter("__o = 1")
    n = steps.groupBy("qid").agg(F.max("step").alias("n_steps"))
    ranked = first.withColumn("__r", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "step"))).join(n, "qid")
    out = ranked.select("qid", "doc", F.col("__r").alias("rank"), (1.0 / F.col("__r")).alias("score"), F.concat(F.lit(f"{retriever}_sq"), F.col("n_steps"), F.lit("_rank"), F.col("__r")).alias("run_id"))
    return out if cap is None else out.filter(F.col("rank") <= cap)


def step_list(docs: Column, ids: Column) -> Column:
    """A step's (doc, score) list: the live one, or stored ids with score 1."""
    return F.coalesce(docs, F.transform(ids, lambda i: F.struct(i.alias("doc"), F.lit(1.0).alias("score"))))


def docs_in_order(lists: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, ids) against a corpus (id, ...): the documents in the list's order, missing ones dropped."""
    rows = lists.select("qid", F.posexplode("ids").alias("pos", "id"))
    return rows.join(corpus, "id").select("qid", "pos", *corpus.columns)
