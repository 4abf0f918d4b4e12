"""Relevance judgements and corpus rewrites: judging, routing, folding, overlay, coverage and final sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.strings import first_part, judgement, page_id
from .constraints import lexical_match


def page_index(passages: DataFrame) -> DataFrame:
    """(page_id, passage_ids) by the id's first part, ids in order."""
    return passages.select(first_part(F.col("id")).alias("page_id"), "id").groupBy("page_id").agg(F.array_sort(F.collect_list("id")).alias("passage_ids"))


def page_index_stats(index: DataFrame) -> DataFrame:
    n = F.size("passage_ids")
    return index.agg(F.count("*").alias("n_pages"), F.sum(n).alias("n_passages"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))


def chunk_positions(passages: DataFrame) -> DataFrame:
    """(page_id, map of chunk to position)."""
    rows = passages.select(page_id(F.col("id")).alias("page_id"), F.substring_index("id", "-", -1).alias("chunk"), "pos").filter("page_id is not null")
    return rows.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk", "pos")))).alias("positions"))


def entity_passages(entities: DataFrame, entity_page: DataFrame, passages: DataFrame) -> DataFrame:
    """Entities with their page's passages: an entity without a page, or a page without passages, keeps no row."""
    pages = entities.join(entity_page, "entity_id", "left")
    p = passages.withColumn("page_id", page_id(F.col("id")))
    return pages.join(p, "page_id")


def by_title(entities: DataFrame, passages: DataFrame) -> DataFrame:
    """Entities with the passages whose title is their label."""
    return entities.join(passages, entities["label"] == passages["title"])


# ---- judging


def judged(rows: DataFrame, make: Callable[[], Callable[[pd.DataFrame], list[str]]], shortcut: tuple[str, str] | None = None, at_once: int | None = None) -> DataFrame:
    """rows with label and error, by an injected judge that is made once a task; what it says is brought to one of the labels.
    Where it fails on a batch it is asked row by row, and a row on which it fails is NO-UNRELATED, with what went wrong as its
    error. shortcut: (contents, value) columns; a passage that holds the value is YES-SAME without asking. at_once: how many
    judges are asked at a time, at most: the rows are dealt into so many tasks."""
    schema = T.StructType([*rows.schema, T.StructField("said", T.StringType()), T.StructField("error", T.StringType())])

    def one(ask: Callable[[pd.DataFrame], list[str]], row: pd.DataFrame) -> tuple[str, str | None]:
        try:
            return ask(row)[0], None
        except Exception as wrong:  # noqa: BLE001  a judge is foreign code; what it raises is told
            return "NO-UNRELATED", f"{type(wrong).__name__}: {wrong}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for b in batches:
            try:
                said = [(s, None) for s in ask(b)]
            except Exception:  # noqa: BLE001  row by row it shows which rows fail
                said = [one(ask, b.iloc[[i]]) for i in range(len(b))]
            yield b.assign(said=[s for s, _ in said], error=[e for _, e in said])

    dealt = lambda df: df.repartition(at_once) if at_once else df
    if shortcut is None:
        return dealt(rows).mapInPandas(run, schema).withColumn("label", judgement(F.col("said"))).drop("said")
    sure = F.coalesce(lexical_match(F.col(shortcut[0]), F.col(shortcut[1])), F.lit(False))
    asked = dealt(rows.filter(~sure)).mapInPandas(run, schema).withColumn("label", judgement(F.col("said"))).drop("said")
    return rows.filter(sure).withColumns({"error": F.lit(None).cast("string"), "label": F.lit("YES-SAME")}).unionByName(asked)


def rewritten(rows: DataFrame, make: Callable[[], Callable[[str, str], str]], order: str = "pos") -> DataFrame:
    """(passage_id, rewrite_type, rewritten, error, seq) of routed passages (passage_id, rewrite_type, contents, value) that are to
    be rewritten: REPLACE or ADD the value, by an injected rewriter that is made once a task. White space of what it writes is
    collapsed; where it fails or writes nothing there is no text, and the error tells why."""
    schema = T.StructType([T.StructField("passage_id", rows.schema["passage_id"].dataType), *(T.StructField(n, T.StringType()) for n in ("rewrite_type", "rewritten", "error")), T.StructField("seq", rows.schema[order].dataType)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        write = make()

        def one(contents: str, value: str) -> tuple[str | None, str | None]:
            try:
                text = " ".join((write(contents, value) or "").split())
                return (text, None) if text else (None, "empty")
            except Exception as wrong:  # noqa: BLE001  a rewriter is foreign code; what it raises is told
                return None, f"{type(wrong).__name__}: {wrong}"

        for b in batches:
            out = [one(c, v) for c, v in zip(b["contents"], b["value"], strict=True)]
            yield pd.DataFrame({"passage_id": b["passage_id"], "rewrite_type": b["rewrite_type"], "rewritten": [t for t, _ in out], "error": [e for _, e in out], "seq": b[order]})

    return rows.filter(F.col("rewrite_type").isin("REPLACE", "ADD")).select("passage_id", "rewrite_type", "contents", "value", order).mapInPandas(run, schema)


def routed(rows: DataFrame, group: list[str], order: str, fallback: str = "related") -> DataFrame:
    """Judged passages as (relevant, rewrite_type): YES-SAME is relevant, YES-DIFFERENT is relevant and REPLACEd; a group
    (an entity of a query) without either ADDs to its first NO-RELATED passage, or, with fallback 'any', to the first
    NO-RELATED one, else the first NO-UNRELATED one."""
    w = Window.partitionBy(*group)
    some = F.max(F.col("label").isin("YES-SAME", "YES-DIFFERENT").cast("int")).over(w)
    wanted = F.when(F.col("label") == "NO-RELATED", 0).when((F.col("label") == "NO-UNRELATED") & F.lit(fallback == "any"), 1)
    out = rows.withColumn("__some", some).withColumn("__want", wanted)
    out = out.withColumn("__first", F.row_number().over(w.orderBy(F.asc_nulls_last("__want"), order)))
    add = (F.col("__some") == 0) & (F.col("__first") == 1) & F.col("__want").isNotNull()
    kind = F.when(F.col("label") == "YES-DIFFERENT", "REPLACE").when(add, "ADD")
    return out.withColumn("rewrite_type", kind).withColumn("relevant", F.col("label").isin("YES-SAME", "YES-DIFFERENT") | add).filter("relevant").drop("__some", "__want", "__first")


def expected_calls(rows: DataFrame, key: list[str], n_passages: str) -> DataFrame:
    """How many passages a run would judge: each (class, property, entity) once."""
    return rows.dropDuplicates(key).agg(F.count("*").alias("n_entities"), F.sum(n_passages).alias("n_calls"))


def without_query(rows: DataFrame, query: str, column: str = "query_id") -> DataFrame:
    """Rows of other queries; rows whose query is unknown stay."""
    return rows.filter((F.col(column) != query) | F.col(column).isNull())


def query_order(rows: DataFrame, column: str = "query_id") -> DataFrame:
    """Queries in order of appearance with their row counts."""
    return rows.groupBy(column).agg(F.min("pos").alias("first"), F.count("*").alias("n")).orderBy("first")


# ---- rewrites and overlay


def latest(rewrites: DataFrame, key: str = "passage_id", order: str = "seq") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rewrites.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def overlay(corpus: DataFrame, rewrites: DataFrame, column: str = "contents") -> DataFrame:
    """The corpus with each passage's latest rewrite (passage_id, seq, rewritten) in its place; rows and their number stay,
    rewrites of unknown passages do nothing."""
    new = latest(rewrites).select(F.col("passage_id").alias("id"), F.col("rewritten").alias("__new"))
    return corpus.join(new, "id", "left").withColumn(column, F.coalesce("__new", column)).select(*corpus.columns)


def changed(before: DataFrame, after: DataFrame, column: str = "contents") -> DataFrame:
    """Ids whose text differs between two corpora."""
    return before.select("id", F.col(column).alias("before")).join(after.select("id", F.col(column).alias("after")), "id").filter(~F.col("before").eqNullSafe(F.col("after")))


def unified(rewrites: DataFrame) -> DataFrame:
    """One row for each passage from rewrites (dataset, passage_id, seq, rewritten), datasets in their order: of the first
    dataset only the last version counts, later ones follow in turn. (passage_id, rewritten, n_versions, history)."""
    w = Window.partitionBy("passage_id")
    first = F.min("dataset").over(w)
    rows = rewrites.withColumn("__first", first).withColumn("__last", F.max("seq").over(Window.partitionBy("passage_id", "dataset")))
    kept = rows.filter((F.col("dataset") > F.col("__first")) | (F.col("seq") == F.col("__last")))
    history = F.array_sort(F.collect_list(F.struct("dataset", "seq", "rewritten")))
    return kept.groupBy("passage_id").agg(history.alias("history")).select("passage_id", F.element_at("history", -1)["rewritten"].alias("rewritten"), F.size("history").alias("n_versions"), "history").orderBy("passage_id")


def shared_between(rewrites: DataFrame, file: str = "dataset") -> DataFrame:
    """Passages that two files or more rewrite."""
    return rewrites.groupBy("passage_id").agg(F.array_sort(F.collect_set(file)).alias("files")).filter(F.size("files") > 1)


def file_overlaps(rewrites: DataFrame, file: str = "dataset") -> DataFrame:
    """(a, b, n): how many passages two files share. Pairs are of files, a handful for each passage."""
    shared = shared_between(rewrites, file)
    a = shared.select("passage_id", F.posexplode("files").alias("i", "a"), "files")
    return a.select("a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


# ---- coverage and final sets


def coverage(entities: DataFrame, qrels: DataFrame, per_query: bool = True) -> DataFrame:
    """(query_id, n_entities, n_covered, valid). entities (query_id, entity_id, page_id); an entity is covered if its page
    has a relevant passage: of its own query, or, with per_query false, of any query, when the query also has to have a
    relevant passage itself. With per_query, a query without entities (entity_id null) is valid; an entity without a
    page is not covered."""
    pages = qrels.select("query_id", page_id(F.col("doc_id")).alias("page_id")).distinct()
    if per_query:
        hit = entities.join(pages.withColumn("__ok", F.lit(True)), ["query_id", "page_id"], "left")
    else:
        hit = entities.join(pages.select("page_id").distinct().withColumn("__ok", F.lit(True)), "page_id", "left")
    ok = F.coalesce("__ok", F.lit(False))
    out = hit.groupBy("query_id").agg(F.count("entity_id").alias("n_entities"), F.count_if(ok & F.col("entity_id").isNotNull()).alias("n_covered"))
    valid = F.col("n_covered") == F.col("n_entities")
    if not per_query:
        own = qrels.select("query_id").distinct().withColumn("__has", F.lit(True))
        out = out.join(own, "query_id", "left")
        return out.withColumn("valid", valid & F.coalesce("__has", F.lit(False))).drop("__has")
    return out.withColumn("valid", valid)


def uncovered(entities: DataFrame, passages: DataFrame, qrels: DataFrame) -> DataFrame:
    """Entities without a relevant passage, with the reason."""
    has_passages = passages.select(page_id(F.col("id")).alias("page_id")).distinct().withColumn("__p", F.lit(True))
    relevant = qrels.select("query_id", page_id(F.col("doc_id")).alias("page_id")).distinct().withColumn("__q", F.lit(True))
    rows = entities.join(has_passages, "page_id", "left").join(relevant, ["query_id", "page_id"], "left").filter("__q is null")
    reason = F.when(F.col("page_id").isNull(), "no page").when(F.col("__p").isNull(), "no passages").otherwise("not judged relevant")
    return rows.select("query_id", "entity_id", "page_id", reason.alias("reason"))


def entity_count_summary(entities: DataFrame) -> DataFrame:
    n = entities.groupBy("query_id").agg(F.count("entity_id").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.count("*").alias("n_queries"))


def final_queries(generations: DataFrame, queries: DataFrame, valid: DataFrame) -> DataFrame:
    """(id, question, answer, src) of valid queries: the question of the query set, else the generation's own."""
    q = queries.select(F.col("qid"), F.col("question").alias("__q"))
    out = generations.join(valid.filter("valid").select(F.col("query_id").alias("qid")), "qid", "left_semi").join(q, "qid", "left")
    return out.select(F.col("qid").alias("id"), F.coalesce("__q", "original_query").alias("question"), "answer", "src")


def final_qrels(qrels: DataFrame, final: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Relevance lines of the final queries; keys pairs a qrels column with a final one."""
    on = [qrels[a] == final[b] for a, b in keys]
    return qrels.join(final, on, "left_semi")


def finalised(entities: DataFrame, qrels: DataFrame, generations: DataFrame, queries: DataFrame, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """(queries, qrels) of the final sets: generations (qid, original_query, answer, src, split) whose entities are all covered,
    with the question of the query set, and the relevance lines of these queries; both say which split they are of."""
    valid = coverage(entities, qrels).select("query_id", "valid")
    which = generations.select(F.col("qid").alias("id"), split).distinct()
    final = final_queries(generations, queries, valid).join(which, "id")
    lines = qrels.join(final.select(F.col("id").alias("query_id"), split), "query_id")
    return final, lines


def versions_of(ids: DataFrame, before: DataFrame, after: DataFrame, column: str = "contents") -> DataFrame:
    """(id, before, after) of passages in two corpora; null where a corpus lacks it."""
    old, new = before.select("id", F.col(column).alias("before")), after.select("id", F.col(column).alias("after"))
    return ids.select("id").distinct().join(old, "id", "left").join(new, "id", "left")


def without_qrels(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels.select(F.col("query_id").alias("qid")).distinct(), "qid", "left_anti")


def missing_by_size(missing: DataFrame, generations: DataFrame) -> DataFrame:
    """Queries without relevance lines, by how many entities they have."""
    rows = missing.join(generations.select("qid", "n_entities"), "qid", "left")
    bucket = F.when(F.col("n_entities").isNull(), "unknown").when(F.col("n_entities") == 0, "none").when(F.col("n_entities") <= 5, "1-5").when(F.col("n_entities") <= 20, "6-20").otherwise("over 20")
    return rows.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("n"))


def candidate_qrels(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, doc_id): a candidate's filtered entities with what was judged relevant for its class and property."""
    rows = candidates.select("query_id", "class_id", "property_id", F.explode("filtered_entity_ids").alias("entity_id"))
    return rows.join(results, ["class_id", "property_id", "entity_id"]).select("query_id", F.explode("relevant_passages").alias("doc_id")).distinct()


def qrel_property(constraints: Column, aggregation: Column) -> Column:
    """Which property supplies relevance: the aggregated one, else the last real constraint's."""
    real = F.filter(constraints, lambda c: c["constraint"] != "LISTED")
    return F.coalesce(aggregation, F.try_element_at(real, F.lit(-1))["label"])


def distractors(gold: DataFrame, corpus: DataFrame, most: int) -> DataFrame:
    """Gold ids and, up to most, the first others of the corpus by pos."""
    ids = gold.select("id").distinct()
    room = max(0, most - ids.count())
    rest = corpus.join(ids, "id", "left_anti").orderBy("pos").limit(room).select("id")
    return corpus.join(ids.unionByName(rest), "id", "left_semi")


def result_summary(rows: DataFrame, counters: list[str]) -> DataFrame:
    return rows.agg(F.count("*").alias("n_queries"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counters])


def title_overlap(a: DataFrame, b: DataFrame, column: str = "title") -> DataFrame:
    """Counts of two title sets, with coverage, Jaccard and the difference of sizes."""
    x, y = a.select(F.col(column).alias("t")).distinct().withColumn("x", F.lit(1)), b.select(F.col(column).alias("t")).distinct().withColumn("y", F.lit(1))
    c = x.join(y, "t", "full").agg(F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"), F.count("*").alias("either"))
    return c.select("n_a", "n_b", "both", (F.col("n_a") - F.col("both")).alias("only_a"), (F.col("n_b") - F.col("both")).alias("only_b"), F.try_divide("both", "n_b").alias("coverage"), F.try_divide("both", "either").alias("jaccard"), F.abs(F.col("n_a") - F.col("n_b")).alias("size_gap"))


def redirected(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """Titles (title) through an alias table (alias, target); an unknown title stays."""
    return titles.join(aliases, titles["title"] == aliases["alias"], "left").withColumn("title", F.coalesce("target", "title")).drop("alias", "target")


def mapped_ids(links: DataFrame, pages: DataFrame, items: DataFrame) -> DataFrame:
    """Entries (entry, title) to item ids by title and then page: an entry with any title unmapped is left out."""
    rows = links.join(pages, "title", "left").join(items, "page_id", "left")
    return rows.groupBy("entry").agg(F.bool_and(F.col("qid").isNotNull()).alias("ok"), F.array_sort(F.collect_list("qid")).alias("qids")).filter("ok").select("entry", "qids")
