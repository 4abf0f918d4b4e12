"""Queries of record keeping: candidates, corpora, identities and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, strings
from ..operators import agents, kb, qrels, retrieval
from ..operators import aggregates as A
from .registry import query


@query("""SELECT CAST(CASE WHEN "value" < 0 THEN 0 WHEN "value" >= 100 THEN 11 ELSE floor("value" / 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM events WHERE "value" IS NOT NULL GROUP BY 1""")
def value_histogram(t):
    return A.histogram(t.events, "value", 0.0, 100.0, 10).withColumn("bin", F.col("bin").cast("long"))


@query("""SELECT count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_calls FROM (SELECT DISTINCT source, lang, n FROM (SELECT source, lang, count(*) OVER (PARTITION BY source, lang) AS n FROM documents))""")
def judge_calls(t):
    n = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return qrels.expected_calls(t.documents.select("source", "lang").join(n, ["source", "lang"]), ["source", "lang"], "n")


@query("""SELECT source AS query_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1""")
def candidate_relevance(t):
    """Each source as a candidate whose filtered entities are its documents."""
    d = t.documents.select("doc_id", F.col("source").alias("query_id"))
    candidates = d.select("query_id", F.lit("c").alias("class_id"), F.lit("p").alias("property_id"), F.array("doc_id").alias("filtered_entity_ids"))
    results = t.labels.filter("quality = 1").select(F.lit("c").alias("class_id"), F.lit("p").alias("property_id"), F.col("doc_id").alias("entity_id"), F.array("doc_id").alias("relevant_passages"))
    return qrels.candidate_qrels(candidates, results)


@query("""WITH g AS (SELECT user_id AS qid, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), m AS (SELECT DISTINCT user_id AS qid FROM events)
SELECT CASE WHEN n IS NULL THEN 'unknown' WHEN n = 0 THEN 'none' WHEN n <= 5 THEN '1-5' WHEN n <= 20 THEN '6-20' ELSE 'over 20' END AS bucket, count(*) AS n FROM m LEFT JOIN g USING (qid) GROUP BY 1""")
def missing_by_size(t):
    sizes = t.events.filter("event_type = 'error'").groupBy(F.col("user_id").alias("qid")).agg(F.count("*").alias("n_entities"))
    return qrels.missing_by_size(t.events.select(F.col("user_id").alias("qid")).distinct(), sizes)


@query("""SELECT doc_id AS id FROM (SELECT doc_id, row_number() OVER (ORDER BY quality IS NULL, CASE WHEN quality IS NULL THEN doc_id END) AS r, quality FROM documents LEFT JOIN labels USING (doc_id)) WHERE quality IS NOT NULL OR r <= 150""")
def sub_corpus(t):
    """The labelled documents, and the first others up to 150 in all."""
    corpus = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"))
    return qrels.distractors(t.labels.select(F.col("doc_id").alias("id")).join(corpus, "id", "left_semi"), corpus, 150).select("id")


@query("""SELECT o_custkey AS entry, string_agg('Q' || o_orderkey, ',' ORDER BY 'Q' || o_orderkey) AS qids FROM orders GROUP BY 1 HAVING bool_and(o_orderkey % 10 <> 0)""")
def mapped_entries(t):
    links = t.orders.select(F.col("o_custkey").alias("entry"), F.concat(F.lit("t"), "o_orderkey").alias("title"))
    pages = t.orders.select(F.concat(F.lit("t"), "o_orderkey").alias("title"), F.col("o_orderkey").alias("page_id"))
    items = t.orders.filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("Q"), "o_orderkey").alias("qid"))
    return qrels.mapped_ids(links, pages, items).select("entry", F.array_join("qids", ",").alias("qids"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN 'region' || n_regionkey ELSE n_name END AS title FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def resolved_redirects(t):
    titles = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("title"))
    aliases = t.nation.filter("n_nationkey < 10").select(F.col("n_name").alias("alias"), F.concat(F.lit("region"), "n_regionkey").alias("target"))
    return qrels.redirected(titles, aliases).select("c_custkey", "title")


@query("""SELECT source AS qid, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS pos, doc_id AS id, n_chars FROM documents""")
def ordered_documents(t):
    """Each source's ids in order, after one that the corpus lacks, against the corpus."""
    lists = t.documents.groupBy(F.col("source").alias("qid")).agg(F.concat(F.array(F.lit(-1).cast("long")), F.sort_array(F.collect_list("doc_id"))).alias("ids"))
    return retrieval.docs_in_order(lists, t.documents.select(F.col("doc_id").alias("id"), "n_chars"))


@query("""SELECT event_type AS query_id, min(event_id) AS "first", count(*) AS n FROM events GROUP BY 1""")
def query_order(t):
    return qrels.query_order(t.events.select(F.col("event_type").alias("query_id"), F.col("event_id").alias("pos")))


@query("""SELECT user_id AS id, max(event_id) AS last FROM events GROUP BY 1""")
def last_versions(t):
    rows = t.events.select(F.col("user_id").alias("passage_id"), F.col("event_id").alias("seq"))
    return qrels.latest(rows).select(F.col("passage_id").alias("id"), F.col("seq").alias("last"))


@query("""SELECT event_type AS id, min(event_id) AS pos, arg_max("value", event_id) AS contents FROM events GROUP BY 1""")
def last_by_id(t):
    return agents.last_by_id(t.events.select(F.col("event_type").alias("id"), F.col("event_id").alias("pos"), F.col("value").alias("contents")))


@query("""WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT event_type AS "value" FROM events GROUP BY 1 HAVING count(DISTINCT user_id) = (SELECT n FROM n)""")
def kb_shared_qualifier(t):
    e = t.events
    return kb.shared_qualifier(e.select(F.col("event_id").alias("stmt_id"), F.col("user_id").alias("entity_id")), e.select(F.col("event_id").alias("stmt_id"), F.lit("kind").alias("qualifier"), F.col("event_type").alias("value")), "kind")


@query("""SELECT o_orderkey AS stmt_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def kb_nested_statements(t):
    q = t.lineitem.select(F.col("l_orderkey").alias("stmt_id"), F.col("l_returnflag").alias("qualifier"), F.col("l_linenumber").cast("string").alias("value"))
    out = kb.nested(t.orders.select(F.col("o_orderkey").alias("stmt_id")), q)
    sizes = F.aggregate(F.transform(F.map_values("qualifiers"), lambda v: F.size(v)), F.lit(0), lambda a, b: a + b)
    return out.select("stmt_id", F.coalesce(sizes, F.lit(0)).cast("long").alias("n"))


@query("""SELECT p_type, bool_and(NOT regexp_matches(p_name, '[0-9]')) AS plain, count(*) AS n FROM part GROUP BY 1""")
def string_domains(t):
    return t.part.groupBy("p_type").agg(F.collect_set("p_name").alias("v"), F.count("*").alias("n")).select("p_type", kb.string_domain(F.col("v")).alias("plain"), "n")


@query("""SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS number FROM events""")
def typed_values(t):
    binding = F.concat(F.lit('{"value": "+'), F.get_json_object("props", "$.k"), F.lit('"}'))
    return t.events.select("event_id", kb.typed_value(binding, F.lit("Quantity"))["number"].alias("number"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'agg' ELSE event_type END AS property FROM events""")
def qrel_properties(t):
    listed = F.array(F.struct(F.col("event_type").alias("label"), F.lit("GT").alias("constraint")), F.struct(F.lit("x").alias("label"), F.lit("LISTED").alias("constraint")))
    return t.events.select("event_id", qrels.qrel_property(listed, F.when(F.col("event_id") % 2 == 0, "agg")).alias("property"))


@query("""SELECT l_orderkey, l_linenumber, l_orderkey || '_Q' || l_suppkey || '_P' || l_partkey || '-P' || l_linenumber AS id FROM lineitem""")
def candidate_ids(t):
    from ..operators.selection import candidate_id

    p = lambda c, h: F.concat(F.lit(h), F.col(c).cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", candidate_id(F.col("l_orderkey"), p("l_suppkey", "Q"), p("l_partkey", "P"), p("l_linenumber", "P")).alias("id"))


@query("""SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS number, '5.0' AS key FROM events""")
def coerced_numbers(t):
    return t.events.select("event_id", numbers.coerce(F.get_json_object("props", "$.k")).alias("number"), strings.soft_key(F.lit(5)).alias("key"))
