"""Identifiers, tags, titles and rendering, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Judgement labels in the order in which they are looked for.
LABELS = ("YES-SAME", "YES-DIFFERENT", "NO-RELATED", "NO-UNRELATED")


# ---- three rules for the page of a passage id; they differ on purpose


def entity_id(passage_id: Column) -> Column:
    """What stands before the last dash; the whole id without one."""
    return F.regexp_replace(passage_id, "-[^-]*$", "")


def page_id(passage_id: Column) -> Column:
    """What stands before the last dash; null without one."""
    return F.when(F.contains(passage_id, F.lit("-")), entity_id(passage_id))


def first_part(passage_id: Column) -> Column:
    """What stands before the first dash; the whole id without one."""
    return F.substring_index(passage_id, "-", 1)


def strict_parts(passage_id: Column) -> Column:
    """(page, chunk) of an id with exactly one dash; any other fails."""
    parts = F.split(passage_id, "-")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("page"), parts[1].alias("chunk"))).otherwise(F.raise_error(F.concat(F.lit("not a passage id: "), passage_id)))


def passage_id(doc: Column, index: Column) -> Column:
    return F.concat(doc, F.lit("-"), F.lpad(index.cast("string"), 4, "0"))


def fallback_id(ident: Column, title: Column) -> Column:
    """The id, or twelve hex digits of the title's MD5 where it is empty."""
    return F.when(F.coalesce(F.trim(ident), F.lit("")) == "", F.substring(F.md5(title.cast("binary")), 1, 12)).otherwise(ident)


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def knowledge_id(url: Column) -> Column:
    """The item or property id at the end of a URL."""
    return F.nullif(F.regexp_extract(url, r"([QP]\d+)/?$", 1), F.lit(""))


def last_part(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


# ---- tags


def tagged(text: Column, tag: str) -> Column:
    """What stands between the first <tag> and </tag>, over lines; null without them."""
    return F.when(text.rlike(f"(?s)<{tag}>.*?</{tag}>"), F.trim(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)))


def boxed(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)\\boxed\{.*?\}"), F.regexp_extract(text, r"(?s)\\boxed\{(.*?)\}", 1))


def between(text: Column, low: str, high: str) -> Column:
    """What stands between two marks, first match, trimmed."""
    quote = lambda s: "\\Q" + s + "\\E"
    pattern = f"(?s){quote(low)}(.*?){quote(high)}"
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))


def generation(text: Column) -> Column:
    """(query, aggregation, answer, number) of a text with the three bracketed heads in order; null if one is missing."""
    pattern = r"(?s)\[Query\]:?\s*(.*?)\s*\[Aggregation\]:?\s*(.*?)\s*\[Answer\]:?\s*(.*?)\s*$"
    part = lambda i: F.trim(F.regexp_extract(text, pattern, i))
    answer = part(3)
    number = F.regexp_replace(answer, ",", "").try_cast("double")
    return F.when(text.rlike(pattern), F.struct(part(1).alias("query"), part(2).alias("aggregation"), answer.alias("answer"), number.alias("number")))


def query_field(text: Column) -> Column:
    """The field `query` of a text that is JSON, holds it in a fence, or holds an object somewhere."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    inline = F.regexp_extract(text, r"(?s)(\{[^{}]*\"query\"[^{}]*\})", 1)
    read = lambda t: F.get_json_object(t, "$.query")
    return F.coalesce(F.when(F.trim(text).startswith("{"), read(text)), F.when(fenced != "", read(fenced)), F.when(inline != "", read(inline)))


def pattern_ids(text: Column) -> Column:
    """(items, properties) named in a graph pattern, distinct and sorted."""
    every = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1))))
    return F.struct(every(r"wd:(Q\d+)").alias("items"), every(r"\b(P\d+)\b").alias("properties"))


def judgement(text: Column) -> Column:
    """One of LABELS: the text itself, else the first that it contains, else the last."""
    upper = F.upper(F.trim(text))
    out = F.when(upper.isin(*LABELS), upper)
    for label in LABELS:
        out = out.when(F.contains(upper, F.lit(label)), F.lit(label))
    return out.otherwise(F.lit(LABELS[-1]))


def soft_key(percent: Column) -> Column:
    return F.format_string("%.1f", percent.cast("double"))


# ---- titles and plain text


def title_from_url(url: Column) -> Column:
    """A page's title: the last part, decoded, spaces as underscores, first letter upper."""
    return normal_title(F.url_decode(F.substring_index(url, "/", -1)))


def normal_title(title: Column) -> Column:
    t = F.regexp_replace(F.trim(F.regexp_replace(title, "_", " ")), r"\s+", "_")
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def collapsed(text: Column, unicode: bool = True) -> Column:
    """White space as one space, heading lines (== x ==) dropped."""
    flag = "(?U)" if unicode else ""
    bare = F.regexp_replace(text, r"(?m)^[ \t]*={2,}[^=\n]+={2,}[ \t]*$", "\n")
    return F.trim(F.regexp_replace(bare, flag + r"\s+", " "))


def title_and_text(contents: Column) -> Column:
    """(title, text): the first line without quotes, and the rest."""
    return F.struct(F.trim(F.regexp_replace(F.substring_index(contents, "\n", 1), '"', "")).alias("title"), F.regexp_replace(contents, r"^[^\n]*\n?", "").alias("text"))


def passages_as_text(passages: Column) -> Column:
    """Numbered passages (title, text) as one text."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), p["title"], F.lit(") "), p["text"])), "\n")


# ---- rendering of values


def rendered_time(when: Column, precision: Column) -> Column:
    """2021, 2021/3 (March 2021) or 2021/3/5 (5 March 2021)."""
    y, m, d = (F.date_format(when, p) for p in ("y", "M", "d"))
    long = F.date_format(when, "MMMM y")
    return F.when(precision == "year", y).when(precision == "month", F.concat(y, F.lit("/"), m, F.lit(" ("), long, F.lit(")"))).when(precision == "day", F.concat(y, F.lit("/"), m, F.lit("/"), d, F.lit(" ("), d, F.lit(" "), long, F.lit(")")))


def rendered_value(kind: Column, number: Column, unit: Column, when: Column, precision: Column, lat: Column, lon: Column, items: Column) -> Column:
    """A typed value for people to read."""
    from .numbers import plain

    return (
        F.when(kind == "Quantity", F.concat_ws(" ", plain(number), unit))
        .when(kind == "Time", rendered_time(when, precision))
        .when(kind == "GlobeCoordinate", F.concat(F.lit("("), lat.cast("string"), F.lit(", "), lon.cast("string"), F.lit(")")))
        .otherwise(F.array_join(items, ", "))
    )


def rendered_reference(values: Column, unit: Column) -> Column:
    """A reference: one value, or several in brackets; then its unit."""
    body = F.when(F.size(values) == 1, values[0]).otherwise(F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]")))
    return F.concat_ws(" ", body, unit)


def bullets(labels: Column, passed: Column) -> Column:
    """A line for each entity, marked by whether it passes."""
    return F.array_join(F.zip_with(labels, passed, lambda a, b: F.concat(F.lit("- "), a, F.when(b, " [YES]").otherwise(" [NO]"))), "\n")


def filled(template: str, **fields: Column) -> Column:
    """A template with {name} fields filled; a null field fills as the empty text."""
    out = F.lit(template)
    for name, column in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column.cast("string"), F.lit("")))
    return out


# ---- what agents write


def actions(text: Column) -> Column:
    """Every name[argument] of a text, as (name, argument)."""
    found = F.regexp_extract_all(text, F.lit(r"(\w+\[[^\]]*?\])"), F.lit(1))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"^(\w+)\[", 1).alias("name"), F.regexp_extract(a, r"\[(.*)\]$", 1).alias("argument")))


def sentences(page: Column) -> Column:
    return F.filter(F.transform(F.split(page, r"\. "), lambda s: F.trim(s)), lambda s: s != "")


def first_sentences(page: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(sentences(page), 1, n), ". ")


def lookup(page: Column, keyword: Column) -> Column:
    """The sentences that hold a keyword, whatever its case, in order: a cursor walks over them."""
    return F.filter(sentences(page), lambda s: F.contains(F.lower(s), F.lower(keyword)))


def follow_up(text: Column) -> Column:
    """The question after the last `Follow up:` line, and the answer after `So the final answer is:`."""
    last = F.element_at(F.regexp_extract_all(text, F.lit(r"(?i)Follow up:\s*([^\n]+)"), F.lit(1)), -1)
    return F.struct(F.when(text.rlike(r"(?i)Follow up:\s*[^\n]+"), F.trim(last)).alias("question"), F.nullif(F.trim(F.regexp_extract(text, r"(?i)So the final answer is:\s*([^\n]+)", 1)), F.lit("")).alias("answer"))


def any_of(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out
