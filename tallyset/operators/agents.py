"""Answering agents: injected generators, a driver of steps, and what their transcripts hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import boxed, tagged
from ..staging import staged

STEP = "array<struct<think:string,search_query:string,doc_ids:array<string>>>"


def generated(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], prompt: str, out: str = "generation") -> DataFrame:
    """rows with what an injected generator says; it is made once a task."""
    schema = T.StructType([*rows.schema, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        say = make()
        for b in batches:
            yield b.assign(**{out: say(b[prompt].fillna("").tolist())})

    return rows.mapInPandas(run, schema)


def prompted(queries: DataFrame, hits: DataFrame | None, corpus: DataFrame | None, shown: int = 3) -> DataFrame:
    """Queries with a prompt: the question alone, or after the passages found for it."""
    if hits is None:
        return queries.withColumn("prompt", F.concat(F.lit("Question: "), "question"))
    docs = hits.filter(F.col("rank") <= shown).join(corpus.select(F.col("id").alias("doc"), "title", "contents"), "doc")
    one = F.concat(F.lit("Doc "), F.col("rank").cast("string"), F.lit(" (Title: "), F.col("title"), F.lit(") "), F.col("contents"))
    text = docs.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", one.alias("t")))), lambda x: x["t"]), "\n").alias("context"))
    return queries.join(text, "qid", "left").withColumn("prompt", F.concat(F.coalesce(F.concat("context", F.lit("\n")), F.lit("")), F.lit("Question: "), "question")).drop("context")


def stepwise(queries: DataFrame, make: Callable[[], Callable[[str], dict]], search: Callable[[DataFrame], DataFrame], most: int = 5) -> DataFrame:
    """All queries step by step: each step asks for every open query at once, then one search serves them all.

    make() gives a function from a transcript to {"think", "search"} or {"think", "answer"}; it is asked once for each open
    query and step, and what it says is staged. search takes (qid, text) and gives (qid, doc, rank). (qid, answer, steps): a
    query without an answer after `most` steps has none."""
    state = queries.select("qid", F.col("question").alias("transcript"), F.lit(None).cast("string").alias("answer"), F.array().cast(STEP).alias("steps"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        think = make()
        for b in batches:
            said = [think(t) for t in b["transcript"]]
            yield pd.DataFrame({"qid": b["qid"], "think": [s.get("think") for s in said], "query": [s.get("search") for s in said], "said": [s.get("answer") for s in said]})

    for _ in range(most):
        open_ = state.filter("answer is null")
        said = staged(open_.select("qid", "transcript").mapInPandas(ask, T.StructType([queries.schema["qid"], *(T.StructField(n, T.StringType()) for n in ("think", "query", "said"))])))
        found = search(said.filter("query is not null").select("qid", F.col("query").alias("text"))).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("doc").cast("string").alias("d")))), lambda x: x["d"]).alias("ids"))
        step = F.struct(F.col("think"), F.col("query").alias("search_query"), F.coalesce("ids", F.array().cast("array<string>")).alias("doc_ids"))
        next_ = open_.join(said, "qid").join(found, "qid", "left")
        next_ = next_.select("qid", F.concat_ws("\n", "transcript", "think", "query", F.array_join("ids", " ")).alias("transcript"), F.col("said").alias("answer"), F.when(F.col("query").isNotNull(), F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"))
        state = staged(state.filter("answer is not null").unionByName(next_))
    return state.select("qid", "answer", "steps")


def transcript(rows: DataFrame, text: str) -> DataFrame:
    """rows with think, search and answer parts of a transcript, a boxed answer counting too."""
    t = F.col(text)
    return rows.select("*", tagged(t, "think").alias("think"), tagged(t, "search").alias("search"), F.coalesce(tagged(t, "answer"), boxed(t)).alias("answer"))


def path_steps(rows: DataFrame, path: str = "reasoning_path") -> DataFrame:
    """A path's search steps as rows (qid, step, rank, doc), ready for fusion."""
    return rows.select("qid", F.posexplode(path).alias("step", "s")).select("qid", "step", F.posexplode("s.doc_ids").alias("rank", "doc"))


def last_by_id(docs: DataFrame, key: str = "id") -> DataFrame:
    """Documents each once: at the first place, with the last value."""
    return docs.groupBy(key).agg(F.min("pos").alias("pos"), F.max_by("contents", "pos").alias("contents"))
