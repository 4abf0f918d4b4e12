"""Queries of entities and their passages, entity metrics, use counts, what agents write, and stored vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions import times
from ..functions.register import register
from ..operators import aggregates as A
from ..operators import candidates, chunking, kb, metrics, qrels, retrieval, selection
from .evaluation import CHUNKS, rewrite_rows
from .evaluation import REWRITES as REWRITTEN
from .registry import query
from .text import documents

# ---- entity metrics

LISTS = """g AS (SELECT source AS qid, list(doc_id || '-0000' ORDER BY doc_id) AS gold FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1),
f AS (SELECT source AS qid, list(doc_id || '-000' || (doc_id % 3) ORDER BY n_chars, doc_id) AS found FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
l AS (SELECT qid, [regexp_replace(x, '-[^-]*$', '') FOR x IN gold] AS g, gold, coalesce([regexp_replace(x, '-[^-]*$', '') FOR x IN found], []) AS f, coalesce(found, []) AS found FROM g LEFT JOIN f USING (qid))"""
_AT = ", ".join(f"round(len(list_intersect(list_distinct(g), f[1:{k}])) / len(list_distinct(g)), 9) AS entity_recall_{k}, CASE WHEN len(list_intersect(g, f[1:{k}])) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS entity_hit_{k}" for k in (1, 3, 5, 10, 20, 50, 100))


def source_lists(t):
    """Labelled documents of a source as its gold passages, and every other document as what was found, shortest first."""
    d = t.documents
    good = d.join(t.labels.filter("quality = 1").select("doc_id"), "doc_id")
    gold = good.select(F.col("source").alias("query_id"), F.concat(F.col("doc_id").cast("string"), F.lit("-0000")).alias("doc_id"), F.col("doc_id").alias("pos"))
    found = d.filter("doc_id % 2 = 0").select(F.col("source").alias("qid"), F.concat(F.col("doc_id").cast("string"), F.lit("-000"), (F.col("doc_id") % 3).cast("string")).alias("doc"), F.struct("n_chars", "doc_id").alias("rank"))
    return metrics.lists(gold, found)


@query(f"""WITH {LISTS} SELECT qid, CAST(len(gold) AS INTEGER) AS num_gold_passages, CAST(len(list_distinct(g)) AS INTEGER) AS num_gold_entities, CAST(len(found) AS INTEGER) AS num_retrieved_passages, CAST(len(list_distinct(f)) AS INTEGER) AS num_retrieved_entities,
  round(len(list_intersect(list_distinct(g), f)) / len(list_distinct(g)), 9) AS entity_recall, {_AT} FROM l""")
def entity_metrics(t):
    out = metrics.entity_bundle(source_lists(t))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if "recall" in c})


_RANKED = ", ".join(f"round(len(list_intersect(list_distinct(gold), found[1:{k}])) / len(list_distinct(gold)), 9) AS recall_{k}, CASE WHEN len(list_intersect(gold, found[1:{k}])) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_{k}, CASE WHEN len(found) > 0 THEN round(len(list_intersect(list_distinct(gold), found[1:{k}])) / least(len(found), {k}), 9) ELSE 0 END AS precision_{k}" for k in (1, 3, 5))


@query(f"WITH {LISTS} SELECT qid, {_RANKED} FROM l")
def ranking_at_depths(t):
    """Recall, hit and precision at 1, 3 and 5."""
    out = metrics.ranking_bundle(source_lists(t), ks=(1, 3, 5))
    names = [f"{m}_{k}" for k in (1, 3, 5) for m in ("recall", "hit", "precision")]
    return out.select("qid", *[F.round(n, 9).alias(n) for n in names])


@query("""SELECT source AS query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS entities FROM documents GROUP BY 1""")
def gold_entities(t):
    gold = t.documents.select(F.col("source").alias("query_id"), F.concat(F.col("doc_id").cast("string"), F.lit("-0007")).alias("doc_id"))
    return metrics.gold_entities(gold.unionByName(gold)).select("query_id", F.array_join("entities", ",").alias("entities"))


@query("""WITH q AS (SELECT user_id AS qid, max("value") AS a, min("value") AS b FROM events GROUP BY 1) SELECT qid, a, CASE WHEN qid % 5 = 0 THEN 0 ELSE b END AS b, a - CASE WHEN qid % 5 = 0 THEN 0 ELSE b END AS diff FROM q""")
def paired_systems(t):
    """Two systems' values of a metric by query, a missing one as 0."""
    from ..operators import stats

    e = t.events.groupBy(F.col("user_id").alias("qid")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    return stats.paired(e.select("qid", F.col("hi").alias("m")), e.select("qid", F.when(F.col("qid") % 5 != 0, F.col("lo")).alias("m")), "m")


# ---- entities, pages and passages


def passages(t):
    return chunking.word_chunks(documents(t))


@query(f"WITH {CHUNKS} SELECT doc_id AS entity_id, chunk_idx FROM chunks WHERE CAST(doc_id AS BIGINT) % 3 <> 0")
def entity_passages(t):
    """Entities without a page, or with a page that has no passages, keep no row."""
    entities = t.documents.select(F.col("doc_id").cast("string").alias("entity_id"))
    pages = t.documents.filter("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("entity_id"), F.col("doc_id").cast("string").alias("page_id"))
    return qrels.entity_passages(entities, pages, passages(t)).select("entity_id", "chunk_idx")


@query(f"WITH {CHUNKS} SELECT n_nationkey, count(*) AS n FROM nation JOIN chunks ON title = 'src' || n_nationkey GROUP BY 1")
def passages_by_title(t):
    entities = t.nation.select("n_nationkey", F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("label"))
    return qrels.by_title(entities, passages(t)).groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query(f"WITH {CHUNKS} SELECT doc_id AS page_id, count(*) AS n, CAST(min(chunk_idx) AS BIGINT) AS least, CAST(max(chunk_idx) AS BIGINT) AS most FROM chunks GROUP BY 1")
def chunk_positions(t):
    out = qrels.chunk_positions(passages(t).select("id", F.col("chunk_idx").cast("long").alias("pos")))
    of = F.map_values("positions")
    return out.select("page_id", F.size("positions").cast("long").alias("n"), F.array_min(of).alias("least"), F.array_max(of).alias("most"))


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_passages, avg(n) AS mean, CAST(min(n) AS INTEGER) AS least, CAST(max(n) AS INTEGER) AS most FROM n""")
def page_index_stats(t):
    index = qrels.page_index(t.documents.select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("id")))
    return qrels.page_index_stats(index)


@query("""SELECT doc_id, md5(lower(text)) AS digest FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND coalesce(toxic, 0) <> 1 AND lower(text) <> text
UNION ALL SELECT doc_id, md5(text || '!') FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""")
def changed_passages(t):
    """Passages whose text a rewrite has changed: the later version counts."""
    corpus = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("contents"))
    out = qrels.changed(corpus, qrels.overlay(corpus, rewrite_rows(t)))
    return out.select(F.col("id").alias("doc_id"), F.md5(F.col("after").cast("binary")).alias("digest"))


@query("""SELECT source AS id, CASE WHEN source LIKE '%1' THEN 'asked ' || source ELSE 'made ' || source END AS question, n AS answer, 'main' AS src FROM (SELECT source, count(*) AS n, bool_and(quality IS NOT NULL) AS ok, max(doc_id) AS last FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) WHERE last % 2 = 0""")
def final_queries(t):
    """Valid queries with their question, else the generation's own."""
    g = t.documents.groupBy("source").agg(F.count("*").alias("answer"), F.max("doc_id").alias("last"))
    made = g.select(F.col("source").alias("qid"), F.concat(F.lit("made "), "source").alias("original_query"), "answer", F.lit("main").alias("src"))
    asked = g.filter(F.col("source").endswith("1")).select(F.col("source").alias("qid"), F.concat(F.lit("asked "), "source").alias("question"))
    return qrels.final_queries(made, asked, g.select(F.col("source").alias("query_id"), (F.col("last") % 2 == 0).alias("valid")))


@query("""SELECT doc_id, source FROM documents WHERE source <> 'src1' OR source IS NULL""")
def query_deleted(t):
    return qrels.without_query(t.documents.select("doc_id", "source"), "src1", "source")


@query("""SELECT count(*) AS n_queries, CAST(sum(CASE WHEN quality IS NULL THEN 0 ELSE quality END) AS BIGINT) AS quality, CAST(sum(coalesce(toxic, 0)) AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def result_summary(t):
    return qrels.result_summary(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), ["quality", "toxic"])


@query(f"""SELECT count(*) AS n FROM (SELECT doc_id FROM {REWRITTEN} GROUP BY 1 HAVING count(*) > 1)""")
def rewrites_in_two_files(t):
    return qrels.shared_between(rewrite_rows(t).withColumn("dataset", F.col("seq"))).agg(F.count("*").alias("n"))


# ---- a knowledge base


@query("""SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN n_name END AS link FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def kb_site_links(t):
    """Entities with an optional link."""
    rows = t.supplier.select(F.col("s_suppkey").alias("entity_id"), "s_nationkey")
    links = rows.filter("s_nationkey < 10").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("entity_id", F.col("n_name").alias("link"))
    return kb.with_links(rows.select("entity_id"), links).select(F.col("entity_id").alias("s_suppkey"), "link")


@query("""SELECT p_partkey, p_type AS prop_id FROM part WHERE p_type NOT IN (SELECT p_type FROM part GROUP BY 1 HAVING count(*) % 2 = 0)""")
def kb_not_structural(t):
    structural = t.part.groupBy("p_type").agg(F.count("*").alias("n")).filter("n % 2 = 0").select(F.col("p_type").alias("prop_id"))
    return kb.not_structural(t.part.select("p_partkey", F.col("p_type").alias("prop_id")), structural).select("p_partkey", "prop_id")


@query("""SELECT o_custkey AS list_id, min(o_orderstatus) AS class_id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS topics FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1""")
def kb_main_topics(t):
    lists = t.orders.select(F.col("o_custkey").alias("list_id"), F.col("o_orderstatus").alias("class_id"), F.lit("P").alias("prop_id"), F.lit("v").alias("value"), F.col("o_orderpriority").alias("topic"))
    return kb.main_topics(lists).select("list_id", "class_id", F.array_join("topics", ",").alias("topics"))


@query("""SELECT 'N' || c_nationkey AS id, CASE WHEN c_nationkey < 12 THEN n_name ELSE 'N' || c_nationkey END AS label, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def kb_labels(t):
    named = t.nation.filter("n_nationkey < 12").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return kb.labels(t.customer.select(F.concat(F.lit("N"), "c_nationkey").alias("id")), named).groupBy("id", "label").agg(F.count("*").alias("n"))


@query("""SELECT p_brand, p_type, count(DISTINCT p_partkey) AS entity_count, count(DISTINCT p_size) AS n_values, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) >= 2""")
def kb_value_records(t):
    return kb.value_records(t.part.withColumn("entity_id", F.col("p_partkey")), ["p_brand", "p_type"], "p_size")


CIRCLES = "SELECT 'N' || n_nationkey AS child, 'N' || ((n_nationkey * 7 + 3) % 25) AS parent FROM nation UNION ALL SELECT 'N' || n_nationkey, 'N' || (n_nationkey // 2) FROM nation"


@query(f"WITH RECURSIVE edges AS ({CIRCLES}), up(node, ancestor) AS (SELECT child, child FROM edges UNION SELECT up.node, e.parent FROM up JOIN edges e ON e.child = up.ancestor) SELECT node, ancestor FROM up UNION SELECT parent, parent FROM edges")
def kb_closure_of_circles(t):
    """Classes that are their own superclasses by way of others."""
    n = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("N"), c.cast("long").cast("string"))
    return kb.closure(t.nation.select(name(n).alias("child"), name((n * 7 + 3) % 25).alias("parent")).union(t.nation.select(name(n), name(F.floor(n / 2)))))


# ---- use counts and choices


@query("""WITH d AS (SELECT event_type AS k, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1), h AS (SELECT event_type AS k, count(*) AS n FROM events WHERE user_id % 3 = 0 GROUP BY 1) SELECT k, coalesce(d.n, 0) AS direct, coalesce(h.n, 0) AS hop FROM d FULL JOIN h USING (k)""")
def use_counts(t):
    rows = t.events.select(F.col("event_type").alias("k"), "user_id")
    return selection.usage(rows.filter("user_id % 2 = 0"), rows.filter("user_id % 3 = 0"), "k")


@query("""SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n, m, p_type) AS r FROM (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS m FROM part GROUP BY 1, 2)) WHERE r = 1""")
def least_used(t):
    options = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("m"))
    return selection.least_used(options, ["p_brand"], ["n", "m"], "p_type").select("p_brand", "p_type", "n")


@query("""SELECT prop_id, num_classes, row_number() OVER (ORDER BY num_classes, prop_id) AS place FROM (SELECT p_type AS prop_id, count(DISTINCT p_brand) AS num_classes FROM part GROUP BY 1)""")
def scarce_first(t):
    rows = selection.scarce_first(selection.property_stats(t.part.select(F.col("p_type").alias("prop_id"), F.col("p_brand").alias("class_id"))))
    return rows.select("prop_id", "num_classes").withColumn("place", F.row_number().over(selection.Window.orderBy("num_classes", "prop_id")).cast("long"))


# ---- what generators and agents write

GENERATED = "'[Query]: q ' || conv_id || chr(10) || '[Aggregation]: SUM' || chr(10) || '[Answer]: ' || turn || ',000'"


@query("""SELECT conv_id, turn, 'q ' || conv_id AS question, 'SUM' AS aggregation, turn || ',000' AS answer, CAST(turn || '000' AS DOUBLE) AS number FROM conversations""")
def generated_parts(t):
    c = t.conversations
    text = F.concat(F.lit("[Query]: q "), "conv_id", F.lit("\n[Aggregation]: SUM\n[Answer]: "), "turn", F.lit(",000"))
    g = S.generation(text)
    return c.select("conv_id", "turn", g["query"].alias("question"), g["aggregation"].alias("aggregation"), g["answer"].alias("answer"), g["number"].alias("number"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN 'about ' || conv_id END AS q FROM conversations""")
def generated_json(t):
    body = F.concat(F.lit('{"query": "about '), "conv_id", F.lit('"}'))
    kind = F.col("turn") % 4
    text = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("I say "), body, F.lit(" so"))).otherwise("none")
    return t.conversations.select("conv_id", "turn", S.query_field(text).alias("q"))


@query("""SELECT l_orderkey, l_linenumber, 'Q' || least(l_partkey, l_suppkey) AS one, 'P' || l_linenumber AS prop, 'Q' || l_partkey AS item, 'ab_' || l_partkey AS title FROM lineitem""")
def graph_pattern_ids(t):
    text = F.concat(F.lit("?x wdt:P"), "l_linenumber", F.lit(" wd:Q"), "l_partkey", F.lit(" . ?x wdt:P"), "l_linenumber", F.lit(" wd:Q"), "l_suppkey")
    ids = S.pattern_ids(text)
    low = F.array_min(F.transform(ids["items"], lambda i: F.substring(i, 2, 20).cast("long")))
    url = F.concat(F.lit("http://kb.example.org/entity/Q"), "l_partkey")
    title = S.lower_first(S.title_from_url(F.concat(F.lit("http://w.example.org/wiki/ab%20"), "l_partkey")))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("Q"), low).alias("one"), F.element_at(ids["properties"], 1).alias("prop"), S.knowledge_id(url).alias("item"), title.alias("title"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_nationkey || ' km' WHEN 1 THEN '2020/' || (1 + n_nationkey % 12) || ' (' || monthname(make_date(2020, CAST(1 + n_nationkey % 12 AS INTEGER), 1)) || ' 2020)' WHEN 2 THEN '(' || n_nationkey || '.5, -3.25)' ELSE n_name || ', other' END AS value_, '[' || n_name || ', other] km' AS reference FROM nation""")
def rendered_values(t):
    n = F.col("n_nationkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Quantity", "Time", "GlobeCoordinate", "WikibaseItem")]), (n % 4 + 1).cast("int"))
    when = F.make_date(F.lit(2020), (1 + n % 12).cast("int"), F.lit(1)).cast("timestamp_ntz")
    items = F.array("n_name", F.lit("other"))
    value = S.rendered_value(kind, n.cast("double"), F.lit("km"), when, F.lit("month"), n + F.lit(0.5), F.lit(-3.25), items)
    return t.nation.select("n_nationkey", value.alias("value_"), S.rendered_reference(items, F.lit("km")).alias("reference"))


@query("""SELECT n_regionkey, string_agg('Doc ' || i || ' (Title: ' || n_name || ') key ' || n_nationkey, chr(10) ORDER BY i) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) GROUP BY 1""")
def passages_shown(t):
    p = F.struct(F.col("n_name").alias("title"), F.concat(F.lit("key "), "n_nationkey").alias("text"))
    return t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(p)).alias("p")).select("n_regionkey", S.passages_as_text(F.col("p")).alias("shown"))


@query("""SELECT conv_id, turn, 'T' || conv_id AS title, text AS body FROM conversations""")
def title_and_body(t):
    parts = S.title_and_text(F.concat(F.lit('"T'), "conv_id", F.lit('"\n'), "text"))
    return t.conversations.select("conv_id", "turn", parts["title"].alias("title"), parts["text"].alias("body"))


@query("""SELECT conv_id, turn, 'Search' AS name, 'c' || conv_id AS argument, 2 AS n, 'what ' || turn || '?' AS question, CAST(turn AS VARCHAR) AS answer FROM conversations""")
def agent_actions(t):
    found = S.actions(F.concat(F.lit("Thought: x. Search[c"), "conv_id", F.lit("] then Lookup[y]")))
    asked = S.follow_up(F.concat(F.lit("Follow up: first?\nFollow up: what "), "turn", F.lit("?\nSo the final answer is: "), "turn"))
    return t.conversations.select("conv_id", "turn", found[0]["name"].alias("name"), found[0]["argument"].alias("argument"), F.size(found).alias("n"), asked["question"].alias("question"), asked["answer"].alias("answer"))


@query(r"""WITH s AS (SELECT doc_id, list_filter([trim(x) FOR x IN string_split(text, '. ')], lambda x: x <> '') AS s FROM documents WHERE NOT regexp_matches(text, '[\x00-\x1F]'))
SELECT doc_id, CAST(len(list_filter(s, lambda x: contains(lower(x), 'the'))) AS INTEGER) AS n_found, array_to_string(s[1:5], '. ') AS "first" FROM s""")
def page_lookup(t):
    """Sentences of a page that hold a word, and the first five; of texts of one line."""
    rows = t.documents.filter(~F.col("text").rlike("[\\x00-\\x1F]"))
    return rows.select("doc_id", F.size(S.lookup(F.col("text"), F.lit("The"))).alias("n_found"), S.first_sentences(F.col("text")).alias("first"))


# ---- intervals, vectors


@query("""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS e, DATE '1996-01-01' + CAST(o_custkey % 200 AS INTEGER) AS s2 FROM orders), y AS (SELECT *, s2 + 365 AS e2 FROM x), z AS (SELECT o_orderkey, greatest(s, s2) AS "start", least(e, e2) AS "end" FROM y)
SELECT o_orderkey, "start", "end", CASE WHEN "start" = "end" THEN 'day' WHEN month("start") = 1 AND day("start") = 1 AND month("end") = 12 AND day("end") = 31 THEN 'year' WHEN day("start") = 1 AND "end" = last_day("end") THEN 'month' ELSE 'day' END AS "precision" FROM z WHERE "start" <= "end" """)
def interval_intersections(t):
    d, s2 = F.col("o_orderdate").cast("date"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("o_custkey") % 200).cast("int"))
    both = times.intersection(d, F.date_add(d, (F.col("o_orderkey") % 90).cast("int")), s2, F.date_add(s2, 365))
    rows = t.orders.select("o_orderkey", both.alias("x")).filter("x is not null").select("o_orderkey", "x.start", "x.end")
    return rows.withColumn("precision", times.interval_precision(F.col("start"), F.col("end")))


@query("""SELECT label, count(*) AS n, round(avg(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])), 6) AS mean_square, CAST(sum(len(list_filter([CAST(round(CAST(x AS DOUBLE) / 5.0 * 256) AS INTEGER) FOR x IN embedding], lambda v: v >= 1))) AS BIGINT) AS n_weights FROM embeddings GROUP BY 1""")
def vector_weights(t):
    """Vectors as maps of whole-number weights, those under 1 left out; and their squared lengths."""
    pairs = F.map_from_arrays(F.transform("embedding", lambda v, i: i), F.transform("embedding", lambda v: v.cast("double")))
    rows = t.embeddings.select("label", retrieval.quantized(pairs).alias("w"), retrieval.dot(F.col("embedding"), F.col("embedding")).alias("sq"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("sq"), 6).alias("mean_square"), F.sum(F.size("w")).cast("long").alias("n_weights"))


@query("""WITH p AS (SELECT label, vec_id // 10 AS g, embedding AS e, CAST(vec_id % 3 > 0 AS INTEGER) AS m FROM embeddings), d AS (SELECT g, i, sum(CAST(e[i] AS DOUBLE) * m) / sum(m) AS mean, max(ln(1 + greatest(CAST(e[i] AS DOUBLE), 0)) * m) AS most FROM p, (SELECT unnest(range(1, 65)) AS i) GROUP BY g, i) SELECT g, round(sum(mean), 6) AS mean_, round(sum(most), 6) AS impacts FROM d GROUP BY g""")
def vector_pooling(t):
    """Ten vectors as the tokens of a text, every third masked: their mean, and the largest impact of each entry."""
    rows = t.embeddings.groupBy(F.floor(F.col("vec_id") / 10).alias("g")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("a"))
    states, mask = F.transform("a", lambda x: x["embedding"]), F.transform("a", lambda x: (x["vec_id"] % 3 > 0).cast("int"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), 6)
    logits = F.transform(states, lambda s: F.transform(s, lambda v: v.cast("double")))
    ready = rows.select("g", states.alias("s"), mask.alias("m"), logits.alias("l"))
    return ready.select("g", total(retrieval.mean_pooled(F.col("s"), F.col("m"))).alias("mean_"), total(retrieval.pooled_impacts(F.col("l"), F.col("m"))).alias("impacts"))


# ---- candidates, rewrites and final sets


@query("""WITH c AS (SELECT p_brand AS class_id, p_size % 4 AS k, max(p_size) AS m FROM part GROUP BY 1, 2), j AS (SELECT class_id || '-' || k AS candidate_id, CASE k WHEN 0 THEN 'SUM' WHEN 1 THEN 'MAX' WHEN 2 THEN 'AVG' ELSE 'COUNT' END AS operation, p_partkey, p_retailprice FROM c JOIN part ON p_brand = class_id WHERE CASE WHEN k < 2 THEN p_size < m ELSE p_size >= m END)
SELECT candidate_id, min(operation) AS operation, count(*) AS n_entities, round(CASE min(operation) WHEN 'SUM' THEN sum(p_retailprice) WHEN 'MAX' THEN max(p_retailprice) WHEN 'AVG' THEN avg(p_retailprice) ELSE count(*) END, 6) AS answer FROM j GROUP BY 1 HAVING count(*) >= 2""")
def candidates_answered(t):
    """Four candidates a brand: parts of a size under, or not under, a reference, and an operation on their prices."""
    k = F.col("k")
    c = t.part.groupBy(F.col("p_brand").alias("class_id"), (F.col("p_size") % 4).alias("k")).agg(F.max("p_size").cast("double").alias("reference"))
    op = F.element_at(F.array(*[F.lit(n) for n in ("SUM", "MAX", "AVG", "COUNT")]), (k + 1).cast("int"))
    c = c.select(F.concat_ws("-", "class_id", k.cast("string")).alias("candidate_id"), "class_id", F.lit("size").alias("constrained"), F.when(k < 2, "LT").otherwise("GTE").alias("comparison"), "reference", F.lit("price").alias("aggregated"), op.alias("operation"))
    members = t.part.select(F.col("p_brand").alias("class_id"), F.col("p_partkey").alias("entity_id"))
    values = t.part.select(F.col("p_partkey").alias("entity_id"), F.lit("size").alias("prop_id"), F.col("p_size").cast("double").alias("value")).unionByName(t.part.select(F.col("p_partkey").alias("entity_id"), F.lit("price").alias("prop_id"), F.col("p_retailprice").alias("value")))
    out = candidates.materialised(c, members, values, {"SUM": (), "MAX": (), "AVG": (), "COUNT": ()})
    return out.withColumn("answer", F.round("answer", 6))


@query("""WITH a AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS place FROM orders WHERE o_orderkey % 2 = 0), c AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS place FROM orders WHERE o_orderkey % 2 = 1)
SELECT a.o_custkey, CAST(a.place AS INTEGER) AS place, a.v AS aggregated, c.v AS constrained FROM a JOIN c ON a.o_custkey = c.o_custkey AND a.place = c.place""")
def paired_values(t):
    o = t.orders.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("value"))
    return candidates.paired_values(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), "o_custkey")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey, l_returnflag) IN (SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'A' ELSE 'R' END FROM supplier)""")
def kept_entities(t):
    """By two keys at once."""
    ids = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_nationkey") % 2 == 0, "A").otherwise("R").alias("l_returnflag"))
    return candidates.kept_entities(t.lineitem, ids, ["l_suppkey", "l_returnflag"]).select("l_orderkey", "l_linenumber")


@query("""SELECT doc_id AS passage_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r\\x1C-\\x1F]+', ' ', 'g')) || ' v' || doc_id AS rewritten FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 1 AND NOT regexp_matches(text, '[\\x80-\\xA0\\x{2000}-\\x{3000}]')""".replace("\\\\", "\\"))
def passages_rewritten(t):
    """Passages to replace, by a rewriter that adds the value."""
    d = t.documents.join(t.labels.filter("quality = 1 and toxic = 1").select("doc_id"), "doc_id").filter(~F.col("text").rlike("[\\x80-\\xA0\\x{2000}-\\x{3000}]"))
    rows = d.select(F.col("doc_id").alias("passage_id"), F.lit("REPLACE").alias("rewrite_type"), F.col("text").alias("contents"), F.concat(F.lit("v"), "doc_id").alias("value"), F.col("doc_id").alias("pos"))
    return qrels.rewritten(rows, lambda: lambda contents, value: f"{contents}  {value}").select("passage_id", "rewritten")


@query("""SELECT o.l AS id, o.split, count(*) AS n FROM (SELECT DISTINCT lang || '-' || source AS l, source, lang, CASE WHEN lang < 'f' THEN 'val' ELSE 'test' END AS split FROM documents WHERE lang IS NOT NULL) o JOIN documents USING (source, lang) JOIN labels USING (doc_id) GROUP BY 1, 2 HAVING bool_and(coalesce(quality, 0) = 1)""")
def final_sets(t):
    """Queries of a language and a source, of which all labelled documents are relevant, and their relevance lines by split."""
    d = t.documents.filter("lang is not null").join(t.labels, "doc_id").select(F.concat_ws("-", "lang", "source").alias("query_id"), F.col("doc_id").cast("string").alias("entity_id"), F.col("doc_id").cast("string").alias("page_id"), "lang", "quality")
    lines = d.filter("quality = 1").select("query_id", F.concat("page_id", F.lit("-0000")).alias("doc_id"))
    made = t.documents.filter("lang is not null").select(F.concat_ws("-", "lang", "source").alias("qid"), F.lit("q").alias("original_query"), F.lit(1).alias("answer"), F.lit("s").alias("src"), F.when(F.col("lang") < "f", "val").otherwise("test").alias("split")).distinct()
    _, out = qrels.finalised(d, lines, made, made.select("qid", F.lit("x").alias("question")))
    return out.groupBy(F.col("query_id").alias("id"), "split").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id AS id, md5(text) AS before, md5(arg_max(rewritten, seq)) AS after FROM documents JOIN {REWRITTEN} USING (doc_id) GROUP BY doc_id, text""")
def passage_versions(t):
    corpus = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("contents"))
    new = rewrite_rows(t)
    out = qrels.versions_of(new.select(F.col("passage_id").alias("id")), corpus, qrels.overlay(corpus, new))
    return out.select("id", F.md5(F.col("before").cast("binary")).alias("before"), F.md5(F.col("after").cast("binary")).alias("after"))


@query("""SELECT CAST(doc_id % 7 AS INTEGER) AS worker, count(*) AS n FROM documents GROUP BY 1""")
def worker_shares(t):
    return selection.round_robin(t.documents, "doc_id", 7).groupBy("worker").agg(F.count("*").alias("n"))


@query("""SELECT user_id AS page, round(sum(coalesce("value", 0)), 6) AS views FROM events GROUP BY 1""")
def page_views(t):
    rows = t.events.select(F.col("user_id").alias("page"), F.col("value").alias("views"))
    return A.view_sums(rows, "page", "views").withColumn("views", F.round("views", 6))


@query(r"""SELECT doc_id, TRY_CAST(replace(nullif(regexp_extract(text, '[-+]?(?:\d+(?:,\d{3})*(?:\.\d+)?|\d*\.\d+)'), ''), ',', '') AS DOUBLE) AS n, round(2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(doc_id % 90) / 2), 2)))), 6) AS km FROM documents""".replace("\\\\", "\\"))
def sql_functions(t):
    """Functions by their SQL names."""
    register(t.spark)
    t.documents.createOrReplaceTempView("tallyset_documents")
    return t.spark.sql("SELECT doc_id, first_number(text) AS n, round(haversine_km(0D, 0D, CAST(doc_id % 90 AS DOUBLE), 0D), 6) AS km FROM tallyset_documents")


@query("""WITH w AS (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark), c AS (SELECT item_id, i, w[i:i + 9] AS c FROM (SELECT *, unnest(range(1, len(w) + 1, 10)) AS i FROM w)) SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INTEGER) AS chunk_idx, array_to_string(c, ' ') AS contents FROM c WHERE len(c) >= 4""".replace("\\\\", "\\"))
def sql_word_windows(t):
    """Windows of ten words by a table function."""
    register(t.spark)
    t.benchmark.createOrReplaceTempView("tallyset_benchmark")
    return t.spark.sql("SELECT item_id, w.chunk_idx, w.contents FROM tallyset_benchmark, LATERAL word_windows(text, 10, 4) w")
