"""Queries of text functions, passages and wikitext."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import strings as S
from ..operators import chunking, wikitext
from .registry import query

WORDS = r"list_filter(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')"
CHUNKS = f"""w AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS title, {WORDS} AS w FROM documents WHERE coalesce(text, '') <> '' AND coalesce(source, '') <> ''),
c AS (SELECT doc_id, title, i, w[i:i + 99] AS c FROM (SELECT *, unnest(range(1, len(w) + 1, 100)) AS i FROM w)),
chunks AS (SELECT doc_id, title, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_idx, array_to_string(c, ' ') AS contents FROM c WHERE len(c) >= 20)"""


def documents(t):
    return t.documents.select("doc_id", F.col("source").alias("title"), "text")


@query(f"WITH {CHUNKS} SELECT doc_id || '-' || lpad(CAST(chunk_idx AS VARCHAR), 4, '0') AS id, doc_id, chunk_idx, title, contents FROM chunks")
def passages_by_words(t):
    return chunking.word_chunks(documents(t))


@query()
def passages_by_context(t):
    """Passages that follow sections, lists and boxes, of documents with a heading before each line."""
    marked = documents(t).withColumn("text", F.concat(F.lit("## Part\n"), F.regexp_replace("text", "\n", "\n### Line\n- ")))
    return chunking.context_chunks(marked)


@query(r"""SELECT doc_id, CAST(CASE WHEN text IS NULL THEN NULL WHEN trim(text) = '' THEN 0 ELSE len(regexp_extract_all(text, '[.!?]\s+[A-Z]')) + 1 END AS INTEGER) AS n_sentences FROM documents""")
def sentences_of_documents(t):
    return t.documents.select("doc_id", F.size(chunking.sentences(F.col("text"))).alias("n_sentences"))


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text, '{N.NUMBER}') THEN TRY_CAST(replace(regexp_extract(text, '{N.NUMBER}'), ',', '') AS DOUBLE) END AS n FROM documents""")
def text_first_number(t):
    return t.documents.select("doc_id", N.first_number(F.col("text")).alias("n"))


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS american, round(o_totalprice, 2) AS european, CASE WHEN o_totalprice < 1000 THEN round(o_totalprice, 2) END AS small, CAST(NULL AS DOUBLE) AS none FROM orders""")
def text_locale_number(t):
    """Prices as texts, with commas and points either way round; and as texts that are no numbers."""
    american = F.format_number("o_totalprice", 2)
    european = F.translate(american, ",.", ".,")
    small = F.when(F.col("o_totalprice") < 1000, american)
    return t.orders.select("o_orderkey", N.locale_number(american).alias("american"), N.locale_number(european).alias("european"), N.locale_number(small).alias("small"), N.locale_number(F.concat(american, F.lit(" km"))).alias("none"))


@query("""SELECT o_orderkey, rtrim(rtrim(printf('%.2f', o_totalprice), '0'), '.') AS v, printf('%.2f', o_totalprice) AS g, CASE WHEN o_orderkey = 0 THEN '0' ELSE '-' || o_orderkey END AS signed FROM orders""")
def text_clean_answers(t):
    """Prices in a sentence, as a prediction and as a gold answer; and a number after a dash."""
    said = F.concat(F.lit("It costs "), F.format_number("o_totalprice", 2), F.lit(" dollars"))
    return t.orders.select("o_orderkey", N.clean_prediction(said).alias("v"), N.clean_gold(N.first_number(said)).alias("g"), N.clean_prediction(F.concat(F.lit("ITEM-"), "o_orderkey")).alias("signed"))


@query("""SELECT event_id, round("value", 2) AS tidy, CASE WHEN "value" = floor("value") THEN TRUE ELSE FALSE END AS whole FROM events""")
def number_tidy(t):
    return t.events.select("event_id", N.tidy(F.col("value")).alias("tidy"), (F.col("value") == F.floor("value")).alias("whole"))


@query("""SELECT doc_id, regexp_replace('a-' || doc_id || '-0001', '-[^-]*$', '') AS entity, regexp_replace('a-' || doc_id || '-0001', '-[^-]*$', '') AS page, 'a' AS first_part, CAST(NULL AS VARCHAR) AS none, source AS whole FROM documents""")
def text_identity_rules(t):
    full = F.concat(F.lit("a-"), F.col("doc_id").cast("string"), F.lit("-0001"))
    return t.documents.select("doc_id", S.entity_id(full).alias("entity"), S.page_id(full).alias("page"), S.first_part(full).alias("first_part"), S.page_id(F.col("source")).alias("none"), S.entity_id(F.col("source")).alias("whole"))


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS last_part, substr(md5(url), 1, 12) AS fallback FROM pages""")
def text_url_parts(t):
    return t.pages.select("page_id", S.last_part(F.col("url")).alias("last_part"), S.fallback_id(F.lit(""), F.col("url")).alias("fallback"))


@query("""SELECT conv_id, turn, trim(text) AS answer, trim(text) AS between_, CAST(NULL AS VARCHAR) AS missing, CAST(conv_id AS VARCHAR) AS boxed FROM conversations""")
def text_tags(t):
    c = t.conversations
    body = F.concat(F.lit("<think>x</think>\n<answer>"), "text", F.lit("</answer><answer>no</answer>"))
    return c.select("conv_id", "turn", S.tagged(body, "answer").alias("answer"), S.between(F.concat(F.lit("[[A]]"), "text", F.lit("[[B]]")), "[[A]]", "[[B]]").alias("between_"), S.boxed(F.col("text")).alias("missing"), S.boxed(F.concat(F.lit("so \\boxed{"), "conv_id", F.lit("} or \\boxed{2}"))).alias("boxed"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents""")
def text_collapsed(t):
    return t.documents.select("doc_id", S.collapsed(F.col("text"), unicode=False).alias("t"))


@query("""SELECT n_nationkey, upper(left(n_name, 1)) || substr(n_name, 2) AS up, lower(left(n_name, 1)) || substr(n_name, 2) AS low FROM nation""")
def text_first_letter(t):
    return t.nation.select("n_nationkey", S.upper_first(F.col("n_name")).alias("up"), S.lower_first(F.col("n_name")).alias("low"))


@query("""SELECT n_regionkey, string_agg('- ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' [YES]' ELSE ' [NO]' END, chr(10) ORDER BY n_name) AS report FROM nation GROUP BY 1""")
def text_report(t):
    rows = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_name", (F.col("n_nationkey") % 2 == 0).alias("ok")))).alias("a"))
    return rows.select("n_regionkey", S.bullets(F.col("a.n_name"), F.col("a.ok")).alias("report"))


@query()
def wikitext_pages(t):
    """Wiki-like pages made from the pages table, cleaned to text."""
    body = F.concat(F.lit("'''Bold''' [[Link|shown]] {{convert|5|km|mi}}\n== Head ==\n"), F.regexp_replace("html", "<[^>]*>", " "))
    return wikitext.extracted(t.pages.select("page_id", F.col("url").alias("title"), body.alias("wikitext")), t.spark.createDataFrame([], "name string, redirect string, body string"))
