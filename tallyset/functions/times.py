"""Time points with precision, intervals and their intersections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numeric precisions of the knowledge base.
PRECISIONS = {9: "year", 10: "month", 11: "day"}
BEGINNING, END = "0001-01-01", "9999-12-31"


def parsed(text: Column, precision: Column | None = None) -> Column:
    """(at, precision): from the numeric precision, else inferred from the date; null if the text or precision is bad."""
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "Z$", ""), r"^\+", "")).cast("timestamp_ntz")
    day = at.cast("date")
    inferred = F.when((F.month(day) == 1) & (F.day(day) == 1), "year").when(F.day(day) == 1, "month").otherwise("day")
    named = inferred
    if precision is not None:
        known = F.lit(None).cast("string")
        for k, v in PRECISIONS.items():
            known = F.when(precision == k, v).otherwise(known)
        named = F.when(precision.isNull(), inferred).otherwise(known)
    return F.when(at.isNotNull() & named.isNotNull(), F.struct(at.alias("at"), named.alias("precision")))


def rank(precision: Column) -> Column:
    """1 for year, 2 for month, 3 for day."""
    return F.when(precision == "year", 1).when(precision == "month", 2).when(precision == "day", 3)


def coarsest(rows: DataFrame, group: list[str], at: str = "at", precision: str = "precision") -> DataFrame:
    """Every time of a group cut to the group's coarsest precision. A group with a null time is left out."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*group)
    least = F.min(rank(F.col(precision))).over(w)
    out = rows.withColumn("__ok", F.min(F.col(at).isNotNull() & F.col(precision).isNotNull()).over(w)).withColumn("__rank", least).filter("__ok")
    named = F.element_at(F.array(F.lit("year"), F.lit("month"), F.lit("day")), F.col("__rank"))
    cut = F.when(F.col("__rank") == 1, F.date_trunc("year", F.col(at))).when(F.col("__rank") == 2, F.date_trunc("month", F.col(at))).otherwise(F.col(at))
    return out.withColumn(at, cut.cast("timestamp_ntz")).withColumn(precision, named).drop("__ok", "__rank")


def expanded(at: Column, precision: Column, side: str) -> Column:
    """The first or last day that a time point may mean."""
    day = at.cast("date")
    if side == "start":
        return F.when(precision == "year", F.trunc(day, "year")).when(precision == "month", F.trunc(day, "month")).otherwise(day)
    return F.when(precision == "year", F.make_date(F.year(day), F.lit(12), F.lit(31))).when(precision == "month", F.last_day(day)).otherwise(day)


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The common part of two closed intervals, or null."""
    s, e = F.greatest(s1, s2), F.least(e1, e2)
    return F.when(s <= e, F.struct(s.alias("start"), e.alias("end")))


def interval_precision(start: Column, end: Column) -> Column:
    """year for whole years, month for whole months, else day."""
    years = (F.month(start) == 1) & (F.day(start) == 1) & (F.month(end) == 12) & (F.day(end) == 31)
    months = (F.day(start) == 1) & (end == F.last_day(end))
    return F.when(start == end, "day").when(years, "year").when(months, "month").otherwise("day")


def between_first_and_last(first: Column, last: Column, precision: str) -> Column:
    """Years, months or whole days from first to last, by their fields."""
    years = F.year(last) - F.year(first)
    if precision == "year":
        return years
    if precision == "month":
        return years * 12 + F.month(last) - F.month(first)
    return F.datediff(last, first)


def shared_time(statements: DataFrame, group: list[str]) -> DataFrame:
    """The latest interval in which every entity of a group has a statement: group, start, end, precision, statements.

    statements: group columns, entity_id, stmt_id, start, end (dates; both null: no time). The shared interval has the
    latest end that lies in an interval of every entity, and the latest start that goes with it. Without any time in
    the group start, end and precision are null and all statements support it; a group with and without times is
    rejected (left out), and so is one without a shared end.
    """
    timed = F.col("start").isNotNull() | F.col("end").isNotNull()
    rows = statements.withColumn("__timed", timed).withColumn("start", F.when(timed, F.coalesce("start", F.lit(BEGINNING).cast("date")))).withColumn("end", F.when(timed, F.coalesce("end", F.lit(END).cast("date"))))
    entity = rows.groupBy(*group, "entity_id").agg(F.max("__timed").alias("any"))
    facts = entity.groupBy(*group).agg(F.count("*").alias("entities"), F.max("any").alias("some"), F.min("any").alias("every"))
    free = rows.join(facts.filter("not some").select(*group), group).groupBy(*group).agg(F.array_sort(F.collect_set("stmt_id")).alias("statements"))
    free = free.select(*group, F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), F.lit(None).cast("string").alias("precision"), "statements")
    held = rows.filter("__timed").join(facts.filter("every").select(*group, "entities"), group)
    best = last_full(held, group)
    latest = held.join(best, group).filter("start <= be and end >= be").groupBy(*group, "be").agg(F.max("start").alias("bs"))
    best = latest.select(*group, "bs", "be")
    support = held.join(best, group).filter("start <= bs and end >= be").groupBy(*group, "bs", "be").agg(F.array_sort(F.collect_set("stmt_id")).alias("statements"))
    found = support.select(*group, F.col("bs").alias("start"), F.col("be").alias("end"), interval_precision(F.col("bs"), F.col("be")).alias("precision"), "statements")
    return free.unionByName(found)


def last_full(held: DataFrame, group: list[str]) -> DataFrame:
    """(group, be): the last day on which each of a group's `entities` has an interval, by a sweep over starts and ends."""
    day = lambda c, n: held.select(*group, "entity_id", "entities", c.alias("d"), F.lit(n).alias("n"))
    ends = day(F.col("start"), 1).unionByName(day(F.date_add("end", 1), -1)).groupBy(*group, "entity_id", "entities", "d").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*group, "entity_id").orderBy("d")
    open_ = ends.withColumn("now", (F.sum("n").over(own) > 0).cast("int"))
    turns = open_.withColumn("turn", F.col("now") - F.coalesce(F.lag("now").over(own), F.lit(0))).filter("turn <> 0")
    days = turns.groupBy(*group, "entities", "d").agg(F.sum("turn").alias("turn"))
    all_ = Window.partitionBy(*group).orderBy("d")
    live = days.withColumn("live", F.sum("turn").over(all_)).withColumn("next", F.lead("d").over(all_))
    return live.filter("live = entities").groupBy(*group).agg(F.date_sub(F.max("next"), 1).alias("be"))
