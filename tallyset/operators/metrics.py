"""Scores of ranked lists and of numeric answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import TOLERANCES, exact_match, soft_match
from ..functions.strings import entity_id


def lists(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, gold, found): gold ids (query_id, doc_id, pos) and ranked hits (qid, doc, rank) as lists in order; a query
    without hits has an empty list."""
    g = gold.groupBy(F.col("query_id").alias("qid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"]).alias("gold"))
    h = hits.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("found"))
    return g.join(h, "qid", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))


def entities(ids: Column) -> Column:
    return F.transform(ids, entity_id)


def _hits(gold: Column, found: Column, k: int | None) -> Column:
    first = found if k is None else F.slice(found, 1, k)
    return F.size(F.array_intersect(gold, first))


def recall(gold: Column, found: Column, k: int | None = None) -> Column:
    """Distinct gold found over distinct gold; 0 without gold."""
    n = F.size(F.array_distinct(gold))
    return F.when(n > 0, _hits(gold, found, k) / n).otherwise(0.0)


def precision(gold: Column, found: Column, k: int) -> Column:
    """Distinct gold found over how many were retrieved, k at most; repeated ids count in the divisor."""
    n = F.least(F.size(found), F.lit(k))
    return F.when(n > 0, _hits(gold, found, k) / n).otherwise(0.0)


def hit(gold: Column, found: Column, k: int) -> Column:
    return F.when(_hits(gold, found, k) > 0, 1.0).otherwise(0.0)


def reciprocal_rank(gold: Column, found: Column) -> Column:
    ranks = F.filter(F.transform(found, lambda d, i: F.when(F.array_contains(gold, d), i + 1)), lambda r: r.isNotNull())
    return F.coalesce(1.0 / F.get(ranks, F.lit(0)), F.lit(0.0))


def average_precision(gold: Column, found: Column) -> Column:
    """The mean, over distinct gold, of the precision at each relevant rank; repeated ids count each time."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("seen"), F.lit(0.0).alias("sum"))

    def step(a: Column, d: Column) -> Column:
        ok = F.array_contains(gold, d)
        seen = a["seen"] + F.when(ok, 1).otherwise(0)
        return F.struct((a["n"] + 1).alias("n"), seen.alias("seen"), (a["sum"] + F.when(ok, seen / (a["n"] + 1)).otherwise(0.0)).alias("sum"))

    n = F.size(F.array_distinct(gold))
    return F.when(n > 0, F.aggregate(found, state, step, lambda a: a["sum"]) / n).otherwise(0.0)


def ndcg(gold: Column, found: Column, k: int) -> Column:
    """The ideal list is as long as the gold list (repeats and all) or the retrieved one, whichever is shorter."""
    first = F.slice(found, 1, k)
    discount = lambda i: 1.0 / F.log2(i + 2.0)
    gain = F.aggregate(F.transform(first, lambda d, i: F.when(F.array_contains(gold, d), discount(i)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    m = F.least(F.size(gold), F.size(first))
    ideal = F.when(m > 0, F.aggregate(F.transform(F.sequence(F.lit(0), m - 1), discount), F.lit(0.0), lambda s, v: s + v))
    return F.coalesce(F.when(ideal > 0, gain / ideal), F.lit(0.0))


def ranking_bundle(rows: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """rows (qid, gold, found) with MRR, MAP and, at each k, recall, precision, hit and NDCG."""
    g, f = F.col("gold"), F.col("found")
    wide = [c for k in ks for c in (recall(g, f, k).alias(f"recall_{k}"), precision(g, f, k).alias(f"precision_{k}"), hit(g, f, k).alias(f"hit_{k}"), ndcg(g, f, k).alias(f"ndcg_{k}"))]
    return rows.select("qid", reciprocal_rank(g, f).alias("mrr"), average_precision(g, f).alias("ap"), *wide)


def entity_bundle(rows: DataFrame, ks: Sequence[int] = (1, 3, 5, 10, 20, 50, 100)) -> DataFrame:
    """rows (qid, gold, found) with counts, entity recall, and entity recall and hit at each k."""
    g, f = F.col("__g"), F.col("__f")
    ready = rows.withColumn("__g", entities(F.col("gold"))).withColumn("__f", entities(F.col("found")))
    counts = [F.size("gold").alias("num_gold_passages"), F.size(F.array_distinct(g)).alias("num_gold_entities"), F.size("found").alias("num_retrieved_passages"), F.size(F.array_distinct(f)).alias("num_retrieved_entities")]
    return ready.select("qid", *counts, recall(g, f).alias("entity_recall"), *[c for k in ks for c in (recall(g, f, k).alias(f"entity_recall_{k}"), hit(g, f, k).alias(f"entity_hit_{k}"))])


def gold_entities(gold: DataFrame) -> DataFrame:
    return gold.groupBy("query_id").agg(F.array_sort(F.collect_set(entity_id(F.col("doc_id")))).alias("entities"))


def means(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mean of each metric over queries, a missing value counting as 0."""
    return rows.agg(F.count("*").alias("n_queries"), *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns])


def answer_scores(rows: DataFrame, gold: str, prediction: str, percents: Sequence[float] = TOLERANCES) -> DataFrame:
    """rows with exact_match and, at each tolerance, soft_match as 0 or 1."""
    g, p = F.col(gold), F.col(prediction)
    return rows.select("*", exact_match(g, p).cast("double").alias("exact_match"), *[soft_match(g, p, t).cast("double").alias(f"soft_match_{t:g}") for t in percents])


def error_summary(rows: DataFrame, gold: str, prediction: str, percents: Sequence[float] = (1.0, 5.0)) -> DataFrame:
    """Mean absolute and relative error over comparable rows (relative error with a gold of 0 is infinite unless met);
    exact and soft rates over all rows."""
    g, p = F.col(gold), F.col(prediction)
    error = F.abs(p - g)
    relative = F.when(g == 0, F.when(error == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(error, F.abs(g)))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), F.count(error).alias("n_comparable"), F.avg(error).alias("mean_abs_error"), F.avg(relative).alias("mean_rel_error"), (F.count_if(exact_match(g, p)) / n).alias("exact"), *[(F.count_if(soft_match(g, p, t)) / n).alias(f"soft_{t:g}") for t in percents])


def verdict(entity_recall: Column) -> Column:
    return F.when(entity_recall >= 0.9, "PASS").when(entity_recall >= 0.5, "PARTIAL").otherwise("FAIL")
