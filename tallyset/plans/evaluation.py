"""Queries of retrieval, metrics, relevance judgements, rewrites and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import staging
from ..functions import numbers as N
from ..functions.strings import judgement
from ..operators import chunking, metrics, qrels, retrieval, stats
from ..sources import readers, writers
from .registry import query
from .text import CHUNKS, documents

TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def bm25_sql(docs: str, queries: str, k: int, extra: str = "", x: str = "") -> str:
    """WITH-clauses that end in hits(qid, doc, score, rank); x tells two sets of them apart."""
    return f"""{extra} d{x} AS ({docs}), dt{x} AS (SELECT doc, {TOKENS} AS t FROM d{x}), ds{x} AS (SELECT doc, len(t) AS dl FROM dt{x}),
p{x} AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM dt{x}) GROUP BY 1, 2), df{x} AS (SELECT term, count(*) AS df FROM p{x} GROUP BY 1),
q{x} AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({TOKENS}) AS term FROM ({queries})) GROUP BY 1, 2), s{x} AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM ds{x}),
sc{x} AS (SELECT qid, doc, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))), 6) AS score FROM q{x} JOIN p{x} USING (term) JOIN df{x} USING (term) JOIN ds{x} USING (doc), s{x} GROUP BY 1, 2),
hits{x} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rank FROM sc{x}) WHERE rank <= {k})"""


BENCH = "SELECT item_id AS qid, text FROM benchmark"
DOCS = "SELECT doc_id AS doc, text FROM documents"
GOLD = "gold AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def benchmark_queries(t):
    return t.benchmark.select(F.col("item_id").alias("qid"), "text")


def gold(t):
    """Documents that hold a benchmark item's text: a stated set of items against all documents."""
    found = retrieval.holding(t.documents, t.benchmark.select(F.col("item_id").alias("item"), "text"))
    return found.select(F.col("item").alias("query_id"), F.col("doc").cast("string").alias("doc_id"), F.col("doc").alias("pos"))


def document_hits(t, k=10):
    return retrieval.bm25_scan(benchmark_queries(t), t.documents, k)


def stored_index(t):
    """The documents' index, written once and read by each search."""
    path = staging.new_path(t.spark)
    writers.index_tables(retrieval.bm25_index(t.documents), path)
    return readers.index_tables(t.spark, path)


@query(f"WITH {bm25_sql(DOCS, BENCH, 10)} SELECT qid, doc, score, rank FROM hits")
def bm25_topk(t):
    return document_hits(t)


@query(f"""WITH {bm25_sql("SELECT doc_id || '-' || lpad(CAST(chunk_idx AS VARCHAR), 4, '0') AS doc, contents AS text FROM chunks", BENCH, 10, CHUNKS + ',')}, {GOLD},
g AS (SELECT qid, list(CAST(doc_id AS VARCHAR)) AS g FROM gold GROUP BY 1), f AS (SELECT qid, list(DISTINCT regexp_replace(doc, '-[^-]*$', '')) AS f FROM hits GROUP BY 1)
SELECT b.item_id AS qid, coalesce(round(len(list_intersect(g, coalesce(f, []))) / len(g), 6), 0) AS entity_recall_10 FROM benchmark b LEFT JOIN g ON g.qid = b.item_id LEFT JOIN f ON f.qid = b.item_id""")
def bm25_entity_recall(t):
    """Items as queries, documents as passages, BM25, and the share of gold documents among the ten best passages."""
    passages = chunking.word_chunks(documents(t)).select(F.col("id").alias("doc_id"), F.col("contents").alias("text"))
    hits = retrieval.bm25_scan(benchmark_queries(t), passages, 10)
    found = hits.groupBy("qid").agg(F.collect_set(F.regexp_replace("doc", "-[^-]*$", "")).alias("found"))
    want = gold(t).groupBy(F.col("query_id").alias("qid")).agg(F.collect_list("doc_id").alias("gold"))
    rows = benchmark_queries(t).select("qid").join(want, "qid", "left").join(found, "qid", "left")
    none = F.array().cast("array<string>")
    return rows.select("qid", F.round(metrics.recall(F.coalesce("gold", none), F.coalesce("found", none)), 6).alias("entity_recall_10"))


@query(f"""WITH {bm25_sql(DOCS, BENCH, 10)}, {GOLD}, ng AS (SELECT qid, count(*) AS ng FROM gold GROUP BY 1),
r AS (SELECT h.qid, h.rank, g.doc_id IS NOT NULL AS rel FROM hits h LEFT JOIN gold g ON h.qid = g.qid AND h.doc = g.doc_id),
c AS (SELECT *, sum(CAST(rel AS INTEGER)) OVER (PARTITION BY qid ORDER BY rank) AS seen FROM r),
m AS (SELECT qid, count(*) AS n, sum(CAST(rel AS INTEGER)) AS hit, min(CASE WHEN rel THEN rank END) AS first, sum(CASE WHEN rel THEN seen / rank ELSE 0 END) AS ap, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM c GROUP BY 1)
SELECT qid, round(coalesce(1.0 / first, 0), 6) AS mrr, round(ap / ng, 6) AS ap, round(hit / ng, 6) AS recall_10, round(hit / n, 6) AS precision_10, CASE WHEN hit > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_10,
  round(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, CAST(least(ng, n) AS BIGINT) + 1)]), 6) AS ndcg_10 FROM m JOIN ng USING (qid)""")
def ranking_metrics(t):
    rows = metrics.ranking_bundle(metrics.lists(gold(t), document_hits(t).withColumn("doc", F.col("doc").cast("string"))))
    return rows.select("qid", *[F.round(c, 6).alias(c) for c in ("mrr", "ap", "recall_10", "precision_10")], "hit_10", F.round("ndcg_10", 6).alias("ndcg_10"))


@query(f"""WITH {bm25_sql(DOCS, BENCH, 10)}, {GOLD}, a AS (SELECT qid, count(*) AS n FROM gold GROUP BY 1), b AS (SELECT h.qid, count(g.doc_id) AS k FROM hits h LEFT JOIN gold g ON h.qid = g.qid AND h.doc = g.doc_id GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(k / n), 6) AS recall_10, CASE WHEN avg(k / n) >= 0.9 THEN 'PASS' WHEN avg(k / n) >= 0.5 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM a JOIN b USING (qid)""")
def index_verdict(t):
    rows = metrics.ranking_bundle(metrics.lists(gold(t), document_hits(t).withColumn("doc", F.col("doc").cast("string"))), ks=(10,))
    m = metrics.means(rows, ["recall_10"])
    return m.select("n_queries", F.round("recall_10", 6).alias("recall_10"), metrics.verdict(F.col("recall_10")).alias("verdict"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id AS doc, round(list_sum([CAST(q.e[i] AS DOUBLE) * CAST(d.embedding[i] AS DOUBLE) FOR i IN range(1, 65)]), 6) AS score FROM q, embeddings d)
SELECT qid, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10""")
def dense_topk(t):
    """Every twentieth vector as a query against all vectors."""
    e = t.embeddings
    return retrieval.dense_search(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("doc"), "embedding"), 10).select("qid", "doc", "score")


IMPACT = f"""d AS (SELECT doc_id AS doc, term, count(*) AS w FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2), q AS (SELECT item_id AS qid, term, count(*) AS qw FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY 1, 2)"""


def worded(df, key, name):
    return df.select(F.col(key).alias(name), F.explode(retrieval.tokens(F.col("text"))).alias("token"))


def weighed(words, name):
    return words.groupBy(name, "token").agg(F.count("*").cast("int").alias("weight"))


@query(f"""WITH {IMPACT}, s AS (SELECT qid, doc, CAST(sum(qw * w) AS BIGINT) AS score FROM q JOIN d USING (term) GROUP BY 1, 2) SELECT qid, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10""")
def impact_topk(t):
    """Word counts as impacts; the documents' words that no item has go before they are counted."""
    q = weighed(worded(t.benchmark, "item_id", "qid"), "qid")
    words = worded(t.documents, "doc_id", "doc").join(q.select("token").distinct(), "token", "left_semi")
    return retrieval.impact_search(q, weighed(words, "doc"), 10).select("qid", "doc", "score")


@query(f"""WITH {bm25_sql(DOCS, BENCH, 100)}, x AS (SELECT h.qid, h.doc, length(documents.text) AS second FROM hits h JOIN documents ON doc_id = h.doc) SELECT qid, doc, second AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY second DESC, doc) AS r FROM x) WHERE r <= 10""")
def reranked_topk(t):
    lengths = t.documents.select(F.col("doc_id").alias("doc"), F.length("text").cast("long").alias("second"))
    return retrieval.rerank(document_hits(t, 100), lambda h: h.join(lengths, "doc"), 10, first=100).select("qid", "doc", "score")


@query(f"WITH {GOLD} SELECT qid, CAST(doc_id AS VARCHAR) AS doc, 1.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS r FROM gold) WHERE r <= 3")
def oracle_topk(t):
    return retrieval.oracle_search(gold(t), 3).select(F.col("qid"), "doc", "score")


@query(f"""WITH {bm25_sql(DOCS, BENCH, 10)} SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM hits WHERE doc IN (SELECT doc_id FROM labels)""")
def stored_topk(t):
    run = document_hits(t).withColumnsRenamed({"doc": "pid", "rank": "pos"})
    return retrieval.stored_search(run, t.labels.select(F.col("doc_id").alias("id")), 10).withColumn("rank", F.col("rank").cast("long"))


FIRST = r"SELECT item_id AS qid, regexp_extract(text, '^[^.]*') AS text FROM benchmark"


@query(f"""WITH {bm25_sql(DOCS, BENCH, 10)}, {bm25_sql(DOCS, FIRST, 10, x='2')}, a AS (SELECT qid, 0 AS step, rank, doc FROM hits),
b AS (SELECT * FROM a UNION ALL SELECT qid, 1, rank, doc FROM hits2), o AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY rank, step) AS o FROM b)
SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY rank, step) AS rank FROM o WHERE o = 1""")
def fused_ranking(t):
    first = t.benchmark.select(F.col("item_id").alias("qid"), F.regexp_extract("text", r"^[^.]*", 0).alias("text"))
    both = benchmark_queries(t).withColumn("step", F.lit(0)).unionByName(first.withColumn("step", F.lit(1)))
    hits = retrieval.bm25_scan(both.select(F.struct("qid", "step").alias("qid"), "text"), t.documents, 10)
    return retrieval.fuse(hits.select("qid.qid", "qid.step", "rank", "doc")).select("qid", "doc", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {bm25_sql(DOCS, BENCH, 10)} SELECT qid || ' Q0 ' || doc || ' ' || rank || ' ' || printf('%.4f', 1.0::DOUBLE / rank) || ' bm25' AS "value" FROM hits""")
def run_lines(t):
    return writers.run_lines(document_hits(t).select(F.col("qid").cast("string").alias("qid"), F.col("doc").cast("string").alias("pid"), "rank", (F.lit(1.0) / F.col("rank")).alias("score"), F.lit("bm25").alias("run_id")))


@query(f"WITH {GOLD} SELECT qid || ' 0 ' || doc_id || ' 1' AS \"value\" FROM gold")
def qrel_lines(t):
    return writers.qrel_lines(gold(t).withColumn("relevance", F.lit(1)))


# ---- answers

ANSWERS = "(SELECT event_id, event_type, CAST(\"value\" AS DOUBLE) AS gold, \"value\" * (1 + (event_id % 13) * 0.0093) AS pred FROM events)"


def answers(t):
    return t.events.select("event_id", "event_type", F.col("value").alias("gold"), (F.col("value") * (1 + (F.col("event_id") % 13) * F.lit(0.0093))).alias("pred"))


SOFT = "CASE WHEN round(gold, 3) = 0 THEN abs(round(pred, 3) - round(gold, 3)) = 0 ELSE abs(round(pred, 3) - round(gold, 3)) <= abs(round(gold, 3)) * ({p} / 100.0::DOUBLE) END"


@query(f"""SELECT event_type, sum(CASE WHEN round(gold, 3) = round(pred, 3) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS exact, sum(CASE WHEN {SOFT.format(p='5.0::DOUBLE')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS soft_5, sum(CASE WHEN {SOFT.format(p='10.0::DOUBLE')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS soft_10 FROM {ANSWERS} GROUP BY 1""")
def answer_matches(t):
    rows = metrics.answer_scores(answers(t), "gold", "pred")
    return rows.groupBy("event_type").agg(F.sum("exact_match").alias("exact"), F.sum("soft_match_5").alias("soft_5"), F.sum("soft_match_10").alias("soft_10"))


@query(f"""SELECT count(*) AS n, count(abs(pred - gold)) AS n_comparable, round(avg(abs(pred - gold)), 6) AS mean_abs_error, round(avg(CASE WHEN gold = 0 THEN CASE WHEN pred = 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE abs(pred - gold) / abs(gold) END), 6) AS mean_rel_error FROM {ANSWERS}""")
def answer_errors(t):
    out = metrics.error_summary(answers(t), "gold", "pred")
    return out.select("n", "n_comparable", F.round("mean_abs_error", 6).alias("mean_abs_error"), F.round("mean_rel_error", 6).alias("mean_rel_error"))


@query()
def significance(t):
    """BM25 by the whole item against BM25 by its first sentence, on recall at ten."""
    index, held = stored_index(t), staging.staged(gold(t))
    first = t.benchmark.select(F.col("item_id").alias("qid"), F.regexp_extract("text", r"^[^.]*", 0).alias("text"))
    score = lambda q: metrics.ranking_bundle(metrics.lists(held, retrieval.bm25(q, index, 10).withColumn("doc", F.col("doc").cast("string"))), ks=(10,))
    return stats.compare(score(benchmark_queries(t)), score(first), "recall_10", resamples=1000)


# ---- judgements, rewrites, coverage

LABELLED = """(SELECT d.source AS entity, d.doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'YES-SAME' WHEN quality = 1 THEN 'YES-DIFFERENT' WHEN toxic = 0 THEN 'NO-RELATED' ELSE 'NO-UNRELATED' END AS label FROM documents d JOIN labels USING (doc_id))"""


def labelled(t):
    said = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "yes-same, surely").when(F.col("quality") == 1, "YES-DIFFERENT").when(F.col("toxic") == 0, "No-Related").otherwise("no idea")
    return t.documents.select("doc_id", F.col("source").alias("entity")).join(t.labels, "doc_id").select("entity", "doc_id", judgement(said).alias("label"))


@query(f"""WITH l AS (SELECT * FROM {LABELLED}), w AS (SELECT *, max(CASE WHEN label LIKE 'YES%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id // 4) AS any_, doc_id // 4 AS grp FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE label WHEN 'NO-RELATED' THEN 0 WHEN 'NO-UNRELATED' THEN 1 ELSE 2 END, doc_id) AS r FROM w)
SELECT grp, doc_id, label, CASE WHEN label = 'YES-DIFFERENT' THEN 'REPLACE' WHEN label NOT LIKE 'YES%' THEN 'ADD' END AS rewrite_type FROM f WHERE label LIKE 'YES%' OR (any_ = 0 AND r = 1)""")
def qrel_routing(t):
    rows = labelled(t).withColumn("grp", F.floor(F.col("doc_id") / 4))
    return qrels.routed(rows, ["grp"], "doc_id", fallback="any").select("grp", "doc_id", "label", "rewrite_type")


REWRITES = "(SELECT doc_id, 1 AS seq, lower(text) AS rewritten FROM documents JOIN labels USING (doc_id) WHERE quality = 0 UNION ALL SELECT doc_id, 2, text || '!' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"


def rewrite_rows(t):
    d = t.documents.select("doc_id", "text").join(t.labels, "doc_id")
    a = d.filter("quality = 0").select(F.col("doc_id").alias("passage_id"), F.lit(1).alias("seq"), F.lower("text").alias("rewritten"))
    return a.unionByName(d.filter("toxic = 1").select(F.col("doc_id").alias("passage_id"), F.lit(2).alias("seq"), F.concat("text", F.lit("!")).alias("rewritten")))


@query(f"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS r FROM {REWRITES}) WHERE r = 1) SELECT d.doc_id AS id, md5(coalesce(rewritten, text)) AS digest FROM documents d LEFT JOIN r USING (doc_id)""")
def corpus_overlay(t):
    corpus = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("contents"))
    return qrels.overlay(corpus, rewrite_rows(t)).select("id", F.md5(F.col("contents").cast("binary")).alias("digest"))


@query(f"""SELECT doc_id AS passage_id, md5(arg_max(rewritten, seq)) AS digest, CAST(count(*) AS INTEGER) AS n_versions FROM {REWRITES} GROUP BY 1""")
def rewrites_unified(t):
    out = qrels.unified(rewrite_rows(t).withColumn("dataset", F.col("seq")))
    return out.select("passage_id", F.md5(F.col("rewritten").cast("binary")).alias("digest"), "n_versions")


@query(f"""SELECT 1 AS a, 2 AS b, count(*) AS n FROM (SELECT doc_id FROM {REWRITES} GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0""")
def rewrite_overlaps(t):
    return qrels.file_overlaps(rewrite_rows(t).withColumn("dataset", F.col("seq")))


ENTITIES = "(SELECT source AS query_id, doc_id AS entity_id, doc_id AS page_id FROM documents)"


def entities(t):
    return t.documents.select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("entity_id"), F.col("doc_id").cast("string").alias("page_id"))


def labelled_qrels(t):
    d = t.documents.select("doc_id", "source").join(t.labels.filter("quality = 1").select("doc_id"), "doc_id")
    return d.select(F.col("source").alias("query_id"), F.concat(F.col("doc_id").cast("string"), F.lit("-0000")).alias("doc_id"), F.col("doc_id").alias("pos"))


@query("""SELECT source AS query_id, count(*) AS n_entities, count(CASE WHEN quality = 1 THEN 1 END) AS n_covered, count(*) = count(CASE WHEN quality = 1 THEN 1 END) AS valid FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def coverage_by_query(t):
    return qrels.coverage(entities(t), labelled_qrels(t))


@query("""WITH e AS (SELECT source AS query_id, doc_id FROM documents UNION ALL SELECT 'lang-' || lang, doc_id FROM documents WHERE lang IS NOT NULL), g AS (SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT query_id, count(*) AS n_entities, count(g.doc_id) AS n_covered, count(*) = count(g.doc_id) AND coalesce(query_id IN (SELECT source FROM g), FALSE) AS valid FROM e LEFT JOIN g USING (doc_id) GROUP BY 1""")
def coverage_overall(t):
    """Each language is a query too, whose pages are judged for their sources alone."""
    lang = t.documents.filter("lang is not null").select(F.concat(F.lit("lang-"), "lang").alias("query_id"), F.col("doc_id").cast("string").alias("entity_id"), F.col("doc_id").cast("string").alias("page_id"))
    return qrels.coverage(entities(t).unionByName(lang), labelled_qrels(t), per_query=False)


@query("""SELECT source AS query_id, doc_id AS entity_id, 'not judged relevant' AS reason FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality <> 1""")
def coverage_missing(t):
    passages = t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit("-0000")).alias("id"))
    return qrels.uncovered(entities(t), passages, labelled_qrels(t)).select("query_id", F.col("entity_id").cast("long").alias("entity_id"), "reason")


@query("""SELECT min(n) AS least, max(n) AS most, avg(n) AS mean, median(n) AS median, count(*) AS n_queries FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)""")
def entity_counts(t):
    return qrels.entity_count_summary(entities(t))


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS t FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS t FROM supplier WHERE s_acctbal > 5000), f AS (SELECT a.t AS x, b.t AS y FROM a FULL JOIN b ON a.t = b.t), c AS (SELECT count(x) AS n_a, count(y) AS n_b, count(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) AS b2, count(*) AS e FROM f)
SELECT n_a, n_b, b2 AS "both", n_a - b2 AS only_a, n_b - b2 AS only_b, b2 / n_b AS coverage, b2 / e AS jaccard, abs(n_a - n_b) AS size_gap FROM c""")
def title_overlap(t):
    return qrels.title_overlap(t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("title")), t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("title")))


@query("""SELECT source AS page_id, count(*) AS n FROM documents GROUP BY 1""")
def page_index(t):
    ids = t.documents.select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("id"))
    return qrels.page_index(ids).select("page_id", F.size("passage_ids").cast("long").alias("n"))


@query("""SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def final_qrel_filter(t):
    return qrels.final_qrels(t.documents.select("doc_id"), t.labels.filter("quality = 1").select(F.col("doc_id").alias("q")), [("doc_id", "q")])


@query("""SELECT item_id AS qid FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))""")
def queries_without_qrels(t):
    return qrels.without_qrels(benchmark_queries(t).select("qid"), gold(t))


@query("""SELECT doc_id, coalesce(lower(text) LIKE '%the%', FALSE) AS m FROM documents""")
def lexical_match(t):
    from ..operators.constraints import lexical_match as match

    return t.documents.select("doc_id", F.coalesce(match(F.col("text"), F.lit("The")), F.lit(False)).alias("m"))


@query("""SELECT event_id, CAST(round(CAST("value" AS DECIMAL(18, 4)), 1) AS DOUBLE) AS tenths, CAST(round(CAST("value" AS DECIMAL(18, 4)), 0) AS DOUBLE) AS whole FROM events""")
def rounded_values(t):
    """Half up on the decimal rendering: a double's own binary value may lie on the other side."""
    return t.events.select("event_id", N.rounded(F.col("value"), 1).alias("tenths"), N.rounded(F.col("value"), 0).alias("whole"))
