"""Readers: JSON and JSONL, plain documents, XML dumps, relevance files and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

QRELS, RUN = "query_id string, iteration string, doc_id string, relevance int", "qid string, q0 string, pid string, rank int, score double, run_id string"
DOCUMENTS = T.StructType([T.StructField(n, T.StringType()) for n in ("doc_id", "title", "text")])


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line, by an explicit schema; compressed files are read by their suffix."""
    return spark.read.schema(schema).json(path)


def json_file(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def text_file(spark: SparkSession, path: str) -> DataFrame:
    """A whole file a row."""
    return spark.read.text(path, wholetext=True)


def file_order() -> Column:
    """Where a line stands: its file, the split of it, and the place in the split. Splits are dealt to tasks by size, so a
    row's number alone is not in the order of the files."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))


def tagged_time(value: Column) -> Column:
    """A time that is an ISO text, or an object with __type__ datetime that holds one."""
    inner = F.when(F.get_json_object(value, "$.__type__") == "datetime", F.get_json_object(value, "$.value"))
    return F.try_to_timestamp(F.coalesce(inner, value)).cast("timestamp_ntz")


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


# ---- documents


def doc_blocks(spark: SparkSession, path: str) -> DataFrame:
    """<doc id= title=> ... </doc> blocks as (doc_id, title, text). What stands after the last </doc> is a block too, if
    it opens one."""
    raw = spark.read.option("lineSep", "</doc>").option("recursiveFileLookup", True).text(path)
    head = r"(?s)<doc\b([^>]*)>\n?(.*)$"
    attr = lambda n: F.regexp_extract(F.regexp_extract("value", head, 1), f'{n}="([^"]*)"', 1)
    return raw.filter(F.col("value").rlike(r"<doc\b[^>]*>")).select(attr("id").alias("doc_id"), attr("title").alias("title"), F.regexp_replace(F.regexp_extract("value", head, 2), r"^\s+|\s+$", "").alias("text"))


def tolerant_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Documents a line, also with a comma after the object; text or contents, id or _id. Lines without title and text go."""
    schema = "id string, _id string, title string, text string, contents string"
    line = F.regexp_replace(F.trim("value"), r",\s*$", "")
    read = spark.read.option("recursiveFileLookup", True).text(path).select(F.from_json(line, schema).alias("d"))
    out = read.select(F.coalesce("d.id", "d._id", F.lit("")).alias("doc_id"), "d.title", F.coalesce("d.text", "d.contents").alias("text"))
    return out.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))


def document_format(spark: SparkSession, path: str) -> str:
    """By the first line that is not blank: jsonl or doc; doc if there is none."""
    first = spark.read.option("recursiveFileLookup", True).text(path).filter(F.trim("value") != "").limit(1).collect()
    return "jsonl" if first and first[0].value.lstrip().startswith("{") else "doc"


def documents(spark: SparkSession, path: str) -> DataFrame:
    return (tolerant_jsonl if document_format(spark, path) == "jsonl" else doc_blocks)(spark, path)


def document_tree(spark: SparkSession, root: str) -> DataFrame:
    """All documents under a folder: wiki_* files as blocks, *.json and *.jsonl as lines."""
    lines = spark.read.option("recursiveFileLookup", True)
    schema = "id string, _id string, title string, text string, contents string"
    j = lines.option("pathGlobFilter", "*.json*").text(root).select(F.from_json(F.regexp_replace(F.trim("value"), r",\s*$", ""), schema).alias("d"))
    j = j.select(F.coalesce("d.id", "d._id", F.lit("")).alias("doc_id"), "d.title", F.coalesce("d.text", "d.contents").alias("text")).filter("title <> '' and text <> ''")
    blocks = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "wiki_*").option("lineSep", "</doc>").text(root)
    head = r"(?s)<doc\b([^>]*)>\n?(.*)$"
    attr = lambda n: F.regexp_extract(F.regexp_extract("value", head, 1), f'{n}="([^"]*)"', 1)
    b = blocks.filter(F.col("value").rlike(r"<doc\b")).select(attr("id").alias("doc_id"), attr("title").alias("title"), F.regexp_replace(F.regexp_extract("value", head, 2), r"^\s+|\s+$", "").alias("text"))
    return j.unionByName(b)


# ---- XML dumps

PAGE = "title string, ns int, id long, redirect struct<_title:string>, revision struct<id:long, text:struct<_VALUE:string>>"


def dump_rows(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a dump: page_id, rev_id, title, ns, redirect, wikitext; rows are split, not the file's reading of them."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    return raw.select(F.col("id").alias("page_id"), F.col("revision.id").alias("rev_id"), "title", "ns", F.col("redirect._title").alias("redirect"), F.col("revision.text._VALUE").alias("wikitext"))


def articles(rows: DataFrame) -> DataFrame:
    """Pages of the main namespace that are no redirects, one for each id."""
    return rows.filter("ns = 0 and redirect is null").dropDuplicates(["page_id"])


def site_info(spark: SparkSession, path: str) -> DataFrame:
    """Language, base and namespaces of a dump."""
    schema = "sitename string, base string, namespaces struct<namespace:array<struct<_key:int,_VALUE:string>>>"
    raw = spark.read.format("xml").option("rowTag", "siteinfo").schema(schema).load(path)
    return raw.select("sitename", "base", F.regexp_extract("base", r"//([a-z-]+)\.", 1).alias("language"), F.map_from_entries(F.transform("namespaces.namespace", lambda n: F.struct(n["_key"], F.coalesce(n["_VALUE"], F.lit(""))))).alias("namespaces"))


def template_rows(rows: DataFrame) -> DataFrame:
    """(name, redirect, body) of templates: what <onlyinclude> marks, else all but <noinclude> parts, without comments."""
    t = rows.filter("ns = 10").select(F.regexp_replace("title", "^[^:]+:", "").alias("name"), F.regexp_replace("redirect", "^[^:]+:", "").alias("redirect"), F.coalesce("wikitext", F.lit("")).alias("w"))
    bare = F.regexp_replace("w", r"(?s)<!--.*?-->", "")
    only = F.regexp_extract_all(bare, F.lit(r"(?s)<onlyinclude>(.*?)</onlyinclude>"), F.lit(1))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"(?s)<noinclude>.*?</noinclude>", ""), r"(?s)<noinclude\s*/?>.*$", ""), r"</?includeonly>", "")
    return t.select("name", "redirect", F.when(F.size(only) > 0, F.array_join(only, "")).otherwise(rest).alias("body"))


# ---- relevance and runs


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Relevant lines in order; lines under four fields and irrelevant ones go, repeated ones stay. pos keeps the order."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(file_order().alias("pos"), parts.alias("p")).filter(F.size("p") >= 4)
    return rows.select(F.col("p")[0].alias("query_id"), F.col("p")[1].alias("iteration"), F.col("p")[2].alias("doc_id"), F.col("p")[3].try_cast("int").alias("relevance"), "pos").filter("relevance > 0")


def run(spark: SparkSession, path: str) -> DataFrame:
    """A run's lines in file order; lines under five fields go, a bad score counts as 0."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(file_order().alias("pos"), parts.alias("p")).filter(F.size("p") >= 5)
    return rows.select(F.col("p")[0].alias("qid"), F.col("p")[2].alias("pid"), F.col("p")[3].try_cast("int").alias("rank"), F.coalesce(F.col("p")[4].try_cast("double"), F.lit(0.0)).alias("score"), F.get(F.col("p"), F.lit(5)).alias("run_id"), "pos")


def query_set(spark: SparkSession, path: str, questions: tuple[str, ...] = ("query", "question"), golds: tuple[str, ...] = ()) -> DataFrame:
    """Questions by id, the last of each: id, question and gold answer. questions and golds name the fields that may hold
    the question and, as a plain number, the gold answer, the first of them first; the field answer comes last."""
    own = [f"{n} string" for n in dict.fromkeys(("qid", "id", *questions, *golds, "answer", "src"))]
    raw = spark.read.schema(", ".join(own)).json(path).withColumn("pos", file_order())
    gold = F.coalesce(*[F.col(g).try_cast("double") for g in golds], F.get_json_object("answer", "$.value").try_cast("double"), F.col("answer").try_cast("double"))
    rows = raw.select(F.coalesce("qid", "id").alias("qid"), F.coalesce(*questions).alias("question"), gold.alias("answer"), F.get_json_object("answer", "$.type").alias("answer_type"), "src", "pos")
    return last_of(rows, "qid", "pos").drop("pos")


def passages(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of passages; an id may be under several names; rows without one go, the last of each stays."""
    schema = "id string, doc_id string, passage_id string, docid string, title string, section array<string>, contents string, text string"
    raw = spark.read.schema(schema).json(path).withColumn("pos", file_order())
    rows = raw.select(F.coalesce("id", "doc_id", "passage_id", "docid", "title").alias("id"), "title", "section", F.coalesce("contents", "text").alias("contents"), "pos").filter("id is not null")
    return last_of(rows, "id", "pos").drop("pos")


def rewrites(spark: SparkSession, path: str) -> DataFrame:
    """Rewrite records with seq, their place in the file."""
    schema = "query_id string, passage_id string, entity_label string, entity_qid string, shared_time string, rewrite_type string, passage struct<id:string,title:string,contents:string>, rewritten_passage struct<id:string,title:string,contents:string>"
    return spark.read.schema(schema).json(path).withColumn("seq", file_order())


def query_metrics(spark: SparkSession, path: str, metrics: tuple[str, ...]) -> DataFrame:
    """Metrics by query from JSON lines, the last line of a query counting; a value that is no number is null."""
    schema = ", ".join(f"`{n}` string" for n in ("qid", "id", *metrics))
    raw = spark.read.schema(schema).json(path).withColumn("pos", file_order())
    rows = raw.select(F.coalesce("qid", "id").alias("qid"), *[F.col(f"`{m}`").try_cast("double").alias(m) for m in metrics], "pos").filter("qid is not null")
    return last_of(rows, "qid", "pos").drop("pos")


def qrel_results(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, property_id, entity_id, relevant_passages) from JSON lines {class: {property: {entity: [passages]}}}, the last line
    counting for each entity."""
    kind = "map<string,map<string,map<string,array<string>>>>"
    raw = spark.read.text(path).select(F.from_json("value", kind).alias("m"), file_order().alias("pos"))
    rows = raw.select("pos", F.explode("m").alias("class_id", "m")).select("pos", "class_id", F.explode("m").alias("property_id", "m"))
    rows = rows.select("pos", "class_id", "property_id", F.explode("m").alias("entity_id", "relevant_passages"))
    w = Window.partitionBy("class_id", "property_id", "entity_id").orderBy(F.desc("pos"))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "pos")


def line_count(spark: SparkSession, path: str) -> int:
    """How many lines are not blank."""
    return spark.read.text(path).filter(F.trim("value") != "").count()


def vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Raw files of 32-bit floats, little-endian, as (vec_id, embedding), numbered over all files in the order of their names.
    Files are read as records of fixed length, by splits, so no file has to fit a row."""
    import numpy as np

    records = spark.sparkContext.binaryRecords(path, 4 * dim).zipWithIndex()  # no DataFrame source reads records of fixed length
    return records.map(lambda x: (x[1], np.frombuffer(x[0], "<f4").tolist())).toDF("vec_id long, embedding array<float>")


def index_tables(spark: SparkSession, path: str, names: tuple[str, ...] = ("postings", "doc_stats", "term_stats")) -> dict[str, DataFrame]:
    """The tables of a stored index by name."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


# ---- products


def products(tables: DataFrame, metadata: DataFrame, key: str = "category") -> DataFrame:
    """Long rows (category, id, feature, value) of products, each feature declared by its category's metadata; others fail."""
    declared = metadata.select(key, F.explode("features").alias("feature")).withColumn("__known", F.lit(True))
    long = tables.select(key, "id", F.explode("values").alias("feature", "value"))
    out = long.join(declared, [key, "feature"], "left")
    return out.filter(F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("undeclared feature: "), F.col("feature"))).cast("boolean")).otherwise(F.lit(True))).drop("__known")


# ---- remote knowledge bases, read from files


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a knowledge base or web interface that answers from JSON files, an object a file: what a remote endpoint,
    which needs a network, would answer to each key. Values that are no texts stay JSON."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
