"""The queries of the corpus operators, one for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, minhash, mixing, phrases, pii, preference, quality, simhash, toxicity
from .common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(fold("doc_id", 4) != 2))
    out = langid.identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    net = quality.train(docs, labels.filter(fold("doc_id", 4) != 2))
    return quality.score(docs, net, ["doc_id"]).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.filter(fold("doc_id", 5) != 0))
    return toxicity.score(docs, model, ["doc_id"]).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it contains within a tenth of the item's length in edits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate.contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


@query
def op5_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.strip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias(c)
    out = preference.format_pairs(preference.paired(turns))
    return out.select("conv_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt", "chosen", "rejected", told("chosen_spans"), told("rejected_spans"))


ORACLE["op7_preference"] = """
WITH convs AS (
  SELECT conv_id, list({'role': coalesce(role, 'user'), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS turns
  FROM conversations GROUP BY conv_id
), beside AS (
  SELECT conv_id, turns,
    coalesce(lead(turns[-1]) OVER w, first_value(turns[-1]) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other
  FROM convs WINDOW w AS (PARTITION BY floor(coalesce(conv_id, -1) / 256) ORDER BY conv_id NULLS FIRST)
), pairs AS (
  SELECT conv_id, turns AS chosen, list_concat(turns[1:len(turns) - 1], [other]) AS rejected FROM beside
), cut AS (
  SELECT *, list_min([i - 1 FOR i IN range(1, least(len(chosen), len(rejected)) + 2) IF i > least(len(chosen), len(rejected)) OR chosen[i] <> rejected[i]]) AS n FROM pairs
), sides AS (
  SELECT conv_id, n, chosen[1:n] AS p, chosen[n + 1:] AS c, rejected[n + 1:] AS r FROM cut
)
SELECT conv_id, CAST(n AS BIGINT) AS n_prompt_turns,
  coalesce(list_aggregate([('<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) FOR t IN p], 'string_agg', ''), '') AS prompt,
  coalesce(list_aggregate([('<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) FOR t IN c], 'string_agg', ''), '') AS chosen,
  coalesce(list_aggregate([('<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) FOR t IN r], 'string_agg', ''), '') AS rejected,
  coalesce(list_aggregate([(coalesce(list_sum([13 + length(u.role) + length(u.text) FOR u IN c[1:i - 1]]), 0) + 5 + length(c[i].role)) || '-' ||
    (coalesce(list_sum([13 + length(u.role) + length(u.text) FOR u IN c[1:i]]), 0)) FOR i IN range(1, len(c) + 1) IF c[i].role = 'assistant'], 'string_agg', ','), '') AS chosen_spans,
  coalesce(list_aggregate([(coalesce(list_sum([13 + length(u.role) + length(u.text) FOR u IN r[1:i - 1]]), 0) + 5 + length(r[i].role)) || '-' ||
    (coalesce(list_sum([13 + length(u.role) + length(u.text) FOR u IN r[1:i]]), 0)) FOR i IN range(1, len(r) + 1) IF r[i].role = 'assistant'], 'string_agg', ','), '') AS rejected_spans
FROM sides
"""
