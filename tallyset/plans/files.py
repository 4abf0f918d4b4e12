"""Queries that write tables as files of a format to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import staging
from ..operators import retrieval
from ..sources import readers, writers
from .registry import query


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, text AS contents FROM documents""")
def file_passages(t):
    """Passages as JSON lines, some under another name of their id, in files of 1,000 rows, read as a corpus."""
    path = staging.new_path(t.spark)
    d = t.documents.select(F.col("doc_id").cast("string").alias("i"), F.col("source").alias("title"), F.col("text").alias("contents"))
    even = F.when(F.col("i").cast("long") % 2 == 0, F.col("i"))
    writers.passages(d.select(even.alias("id"), F.when(even.isNull(), F.col("i")).alias("docid"), "title", "contents"), path, per_file=1000)
    return readers.passages(t.spark, path).select("id", "title", "contents")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS title, text FROM documents WHERE coalesce(text, '') <> '' AND coalesce(source, '') <> ''""")
def file_tolerant_lines(t):
    """Documents a line, with a comma after some, in compressed files."""
    path = staging.new_path(t.spark)
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text"))
    t.documents.select(F.when(F.col("doc_id") % 2 == 0, F.concat(line, F.lit(","))).otherwise(line).alias("value")).write.option("compression", "gzip").text(path)
    return readers.documents(t.spark, path)


@query(r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS title, regexp_replace(regexp_replace(text, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', '') AS text FROM documents WHERE text IS NOT NULL AND text NOT LIKE '%</doc>%'""")
def file_doc_blocks(t):
    path = staging.new_path(t.spark)
    d = t.documents.filter("text is not null").filter(~F.contains("text", F.lit("</doc>")))
    d.select(F.concat(F.lit('<doc id="'), "doc_id", F.lit('" url="u" title="'), "source", F.lit('">\n'), "text", F.lit("\n</doc>")).alias("value")).write.option("compression", "bzip2").text(path)
    return readers.doc_blocks(t.spark, path)


@query("""SELECT CAST(o_custkey AS VARCHAR) AS query_id, CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(o_orderkey % 3 AS INTEGER) AS relevance FROM orders WHERE o_orderkey % 3 > 0""")
def file_qrels(t):
    path = staging.new_path(t.spark)
    writers.qrels(t.orders.select(F.col("o_custkey").cast("string").alias("query_id"), F.col("o_orderkey").cast("string").alias("doc_id"), (F.col("o_orderkey") % 3).alias("relevance")), path)
    return readers.qrels(t.spark, path).select("query_id", "doc_id", "relevance")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS qid, CAST(o_orderkey AS VARCHAR) AS pid, CAST(rank AS INTEGER) AS rank, CAST(1 AS DOUBLE) / 4 AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders)""")
def file_run(t):
    path = staging.new_path(t.spark)
    ranked = retrieval.best(t.orders.select(F.col("o_custkey").cast("string").alias("qid"), F.col("o_orderkey").alias("doc"), F.lit(0.25).alias("score")), 1 << 30)
    writers.run(ranked.select("qid", F.col("doc").cast("string").alias("pid"), "rank", "score", F.lit("r").alias("run_id")), path)
    return readers.run(t.spark, path).select("qid", "pid", "rank", "score")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS qid, 'is it ' || c_name || '?' AS question, round(c_acctbal, 2) AS answer FROM customer""")
def file_query_set(t):
    """Questions under two names, the last line of an id counting."""
    path = staging.new_path(t.spark)
    c = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("is it "), "c_name", F.lit("?")).alias("q"), F.round("c_acctbal", 2).alias("answer"))
    writers.jsonl(c.select("id", F.lit("old").alias("query"), F.lit(0).alias("answer")).coalesce(1), path)
    writers.jsonl(c.select("id", F.col("q").alias("query"), "answer").coalesce(1), f"{path}/z=1", mode="append")
    older, newer = readers.query_set(t.spark, f"{path}/*.json"), readers.query_set(t.spark, f"{path}/z=1")
    return newer.join(older.select("qid"), "qid", "left_semi").select("qid", "question", "answer")


@query("""SELECT doc_id AS id, md5(text) AS digest FROM documents JOIN labels USING (doc_id) WHERE quality = 1""")
def file_rewrites(t):
    """Rewrites as JSON lines in files by their order; the last version of each counts."""
    path = staging.new_path(t.spark)
    d = t.documents.join(t.labels.filter("quality = 1").select("doc_id"), "doc_id")
    said = lambda text: F.struct(F.lit(None).cast("string").alias("id"), text.alias("contents")).alias("rewritten_passage")
    for name, text in (("a", F.lit("old")), ("b", F.col("text"))):
        writers.jsonl(d.select(F.col("doc_id").cast("string").alias("passage_id"), said(text)), f"{path}/{name}")
    rows = readers.rewrites(t.spark, f"{path}/*")
    return readers.last_of(rows, "passage_id", "seq").select(F.col("passage_id").cast("long").alias("id"), F.md5(F.col("rewritten_passage.contents").cast("binary")).alias("digest"))


@query("""SELECT page_id, url AS title, 'see ' || page_id AS wikitext FROM pages WHERE page_id % 4 <> 0""")
def file_xml_dump(t):
    """Pages as the files of an XML dump, some of them redirects, read page by page."""
    path = staging.new_path(t.spark)
    redirect = F.when(F.col("page_id") % 4 == 0, '<redirect title="x"/>').otherwise("")
    text = F.concat(F.lit("<page><title>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</title><ns>0</ns><id>"), "page_id", F.lit("</id>"), redirect, F.lit("<revision><id>1</id><text>see "), "page_id", F.lit("</text></revision></page>"))
    pages = t.pages.select((F.col("page_id") % 50).alias("part"), text.alias("v")).groupBy("part").agg(F.array_join(F.collect_list("v"), "\n").alias("v"))
    pages.select(F.concat(F.lit("<mediawiki>\n"), "v", F.lit("\n</mediawiki>")).alias("value"), "part").write.partitionBy("part").text(path)
    return readers.articles(readers.dump_rows(t.spark, path)).select("page_id", "title", "wikitext")


@query("""SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents)) GROUP BY 1""".replace("\\\\", "\\"))
def file_index(t):
    """The index of the documents, written and read as tables."""
    path = staging.new_path(t.spark)
    writers.index_tables(retrieval.bm25_index(t.documents), path)
    return readers.index_tables(t.spark, path)["term_stats"]


@query("""SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 6) AS total FROM embeddings""")
def file_answers(t):
    """Vectors as JSON answers by key, an object a file."""
    path = staging.new_path(t.spark)
    keyed = t.embeddings.select(F.map_from_entries(F.array(F.struct(F.col("vec_id").cast("string"), F.to_json(F.col("embedding").cast("array<double>"))))).alias("m"))
    keyed.select(F.to_json("m").alias("value")).write.text(path)
    lines = t.spark.read.text(path)
    parts = staging.new_path(t.spark)
    lines.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.substring("value", F.lit(2), F.length("value") - 2)), ","), F.lit("}")).alias("value")).write.text(parts)
    said = readers.answers(t.spark, parts).select(F.col("key").cast("long").alias("vec_id"), F.from_json("value", "array<double>").alias("e"))
    return said.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS qid, max(o_totalprice) AS mrr FROM orders GROUP BY 1""")
def file_query_metrics(t):
    """Metrics by query in two files, the later one counting."""
    path = staging.new_path(t.spark)
    for name, m in (("a", F.min("o_totalprice")), ("b", F.max("o_totalprice"))):
        writers.jsonl(t.orders.groupBy(F.col("o_custkey").cast("string").alias("qid")).agg(m.alias("mrr")), f"{path}/{name}")
    return readers.query_metrics(t.spark, f"{path}/*", ("mrr",))


@query("""SELECT p_brand AS class_id, p_type AS property_id, CAST(p_partkey AS VARCHAR) AS entity_id, CAST(p_size AS VARCHAR) AS passages FROM part""")
def file_qrel_results(t):
    """Results by class, property and entity as nested objects, a line for each class."""
    path = staging.new_path(t.spark)
    leaf = t.part.groupBy("p_brand", "p_type").agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), F.array(F.col("p_size").cast("string"))))).alias("m"))
    top = leaf.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "m"))).alias("m"))
    top.select(F.to_json(F.create_map("p_brand", "m")).alias("value")).write.text(path)
    return readers.qrel_results(t.spark, path).select("class_id", "property_id", "entity_id", F.array_join("relevant_passages", ",").alias("passages"))


@query("""SELECT qid, pid, rank FROM (SELECT CAST(o_custkey AS VARCHAR) AS qid, CAST(o_orderkey AS VARCHAR) AS pid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_custkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END) AS INTEGER) AS rank FROM orders)""")
def file_merged_runs(t):
    """A run, and a later one that has some of its queries again, as one."""
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("qid"), F.col("o_orderkey").cast("string").alias("pid"), F.col("o_orderkey").alias("k"))
    ranked = lambda df, order: df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(order))).select("qid", "pid", "rank", F.lit(1.0).alias("score"), F.lit("r").alias("run_id"))
    path = staging.new_path(t.spark)
    writers.run(writers.merged_runs([ranked(rows, F.col("k")), ranked(rows.filter("cast(qid as long) % 3 = 0"), F.desc("k"))]), path)
    return readers.run(t.spark, path).select("qid", "pid", "rank")
