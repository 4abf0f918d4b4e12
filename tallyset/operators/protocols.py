"""Agents that search step by step: how each protocol writes thoughts, searches and answers, over one loop.

A protocol is patterns for what a generator says, and a template for what is put before its next turn. The generator is
injected; parsing, searching and the transcripts are column expressions and joins, and each turn is staged, so the
generator is asked once for each open query and turn.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import lookup
from ..staging import staged
from .agents import STEP, generated


@dataclass(frozen=True)
class Protocol:
    """Patterns, of which group 1 counts, for thought, search and answer, and for a look-up in what was found last; and the
    template of a turn: {said}, {turn} and {found}."""

    think: str
    search: str
    answer: str
    turn: str
    look_up: str = ""
    ask: str = ""


_TAG = r"(?s)<{0}>\s*(.*?)\s*</{0}>"
_BOXED = r"(?s)\\boxed\{\s*(.*?)\s*\}"
# What the protocols' generators were taught to write and to read.
PROTOCOLS = {
    "research": Protocol(_TAG.format("think"), r"(?s)<search>\s*search query:\s*(.*?)\s*</search>", _BOXED, "\n{said}<result>{found}</result>\n"),
    "search_r1": Protocol(_TAG.format("think"), _TAG.format("search"), _TAG.format("answer"), "\n\n{said}<information>{found}</information>\n\n"),
    "step_search": Protocol(_TAG.format("think"), _TAG.format("search"), _TAG.format("answer"), "\n\n{said}<information>{found}</information>\n\n"),
    "search_o1": Protocol(r"(?s)^\s*(.*?)\s*(?:<\|begin_search_query\|>|\\boxed)", r"(?s)<\|begin_search_query\|>\s*(.*?)\s*<\|end_search_query\|>", _BOXED, "\n{said}<|begin_search_result|>{found}<|end_search_result|>\n"),
    "react": Protocol(r"(?s)^\s*(.*?)\s*Action \d+:", r"Search\[([^\]]+)\]", r"Finish\[([^\]]*)\]", "{said}\nObservation {turn}: {found}\n", look_up=r"Lookup\[([^\]]+)\]", ask="Thought {turn}:"),
    "self_ask": Protocol(r"(?s)^\s*(.*?)\s*(?:Follow up:|So the final answer is:)", r"Follow up:\s*([^\n]+)", r"So the final answer is:\s*([^\n]+)", "{said}\nIntermediate answer: {found}\n"),
}


def group(text: Column, pattern: str) -> Column:
    """Group 1 of the first match; null without a match, or without a pattern."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)) if pattern else F.lit(None).cast("string")


def parsed(said: Column, protocol: Protocol) -> Column:
    """(think, answer, query, word): an answer counts before a search, and a search before a look-up."""
    answer, query, word = (group(said, p) for p in (protocol.answer, protocol.search, protocol.look_up))
    query = F.when(answer.isNull(), query)
    return F.struct(group(said, protocol.think).alias("think"), answer.alias("answer"), query.alias("query"), F.when(answer.isNull() & query.isNull(), word).alias("word"))


def looked_up(page: Column, word: Column) -> Column:
    """The first sentence of what was found last that holds a word, and of how many."""
    found = lookup(F.coalesce(page, F.lit("")), word)
    return F.when(F.size(found) > 0, F.concat(F.lit("(Result 1 / "), F.size(found).cast("string"), F.lit(") "), F.get(found, F.lit(0)))).otherwise("No more results.")


def run(name: str, queries: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], search: Callable[[DataFrame], DataFrame], corpus: DataFrame, most: int = 5, shown: int = 3) -> DataFrame:
    """(qid, answer, steps): all queries (qid, question) by a protocol, a turn of all open ones at a time.

    make() gives a function from prompts to what a generator says. search takes (qid, text) and gives (qid, doc, rank);
    corpus has (id, title, contents). A query without an answer after `most` turns has none; a turn that neither answers nor
    searches goes on with nothing found."""
    protocol = PROTOCOLS[name]
    state = queries.select("qid", F.col("question").alias("transcript"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("page"), F.array().cast(STEP).alias("steps"))
    for turn in range(1, most + 1):
        open_ = state.filter("answer is null").withColumn("prompt", F.concat("transcript", F.lit(protocol.ask.replace("{turn}", str(turn)))))
        said = staged(generated(open_, make, "prompt", "said").drop("prompt").withColumn("p", parsed(F.col("said"), protocol)).select("*", "p.think", "p.query", "p.word", F.col("p.answer").alias("final")).drop("p"))
        hits = search(said.filter("query is not null").select("qid", F.col("query").alias("text"))).filter(F.col("rank") <= shown)
        told = hits.join(corpus.select(F.col("id").alias("doc"), "title", "contents"), "doc").select("qid", F.struct("rank", F.col("doc").cast("string").alias("doc"), "title", "contents").alias("h"))
        found = told.groupBy("qid").agg(F.sort_array(F.collect_list("h")).alias("h"))  # `shown` of each query at most
        line = F.transform("h", lambda x: F.concat(F.lit("Doc "), x["rank"].cast("string"), F.lit(" (Title: "), F.coalesce(x["title"], F.lit("")), F.lit(") "), F.coalesce(x["contents"], F.lit(""))))
        rows = said.join(found, "qid", "left").withColumn("page", F.when(F.col("query").isNotNull(), F.array_join(F.transform("h", lambda x: x["contents"]), "\n")).otherwise(F.col("page")))
        shown_text = F.when(F.col("word").isNotNull(), looked_up(F.col("page"), F.col("word"))).otherwise(F.coalesce(F.array_join(line, "\n"), F.lit("")))
        text = F.lit(protocol.turn.replace("{turn}", str(turn)))
        text = F.replace(F.replace(text, F.lit("{said}"), F.col("said")), F.lit("{found}"), shown_text)
        step = F.struct("think", F.col("query").alias("search_query"), F.coalesce(F.transform("h", lambda x: x["doc"]), F.array().cast("array<string>")).alias("doc_ids"))
        steps = F.when(F.col("query").isNotNull(), F.concat("steps", F.array(step))).otherwise(F.col("steps"))
        rows = rows.select("qid", F.concat("transcript", F.lit(protocol.ask.replace("{turn}", str(turn))), text).alias("transcript"), F.col("final").alias("answer"), "page", steps.alias("steps"))
        state = staged(state.filter("answer is not null").unionByName(rows))
        if state.filter("answer is null").isEmpty():
            break
    return state.select("qid", "answer", "steps")
