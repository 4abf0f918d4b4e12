"""Constraints on entity values, as predicates and as gates over groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import toward

COMPARE = {"GT": lambda v, r: v > r, "GTE": lambda v, r: v >= r, "LT": lambda v, r: v < r, "LTE": lambda v, r: v <= r, "BEFORE": lambda v, r: v < r, "AFTER": lambda v, r: v > r, "IS": lambda v, r: v == r, "IS_NOT": lambda v, r: v != r}
BY_KIND = {
    "Quantity": ("GT", "GTE", "LT", "LTE"),
    "GlobeCoordinate": ("N", "S", "E", "W", "NE", "NW", "SE", "SW"),
    "Time": ("BEFORE", "AFTER"),
    "Date": ("BEFORE", "AFTER"),
    "WikibaseItem": ("HAS", "NOT_HAS", "HAS_ANY", "NOT_HAS_ANY", "HAS_ALL", "NOT_HAS_ALL"),
    "String": ("IS", "IS_NOT", "IS_ANY", "IS_NOT_ANY"),
    "OrderedString": ("MORE_THAN", "LESS_THAN"),
}


def compare(name: str, value: Column, reference) -> Column:
    """Numbers, times and strings against one reference."""
    return COMPARE[name](value, reference if isinstance(reference, Column) else F.lit(reference))


def items(name: str, held: Column, wanted: Sequence[str]) -> Column:
    """A list of items against one or more wanted ones."""
    want = F.array(*[F.lit(w) for w in wanted])
    base = {"HAS": F.array_contains(held, wanted[0]) if wanted else F.lit(False), "HAS_ANY": F.arrays_overlap(held, want), "HAS_ALL": F.size(F.array_except(want, held)) == 0}
    plain = name.removeprefix("NOT_")
    return ~base[plain] if name.startswith("NOT_") else base[plain]


def among(name: str, value: Column, wanted: Sequence[str]) -> Column:
    return ~value.isin(*wanted) if name == "IS_NOT_ANY" else value.isin(*wanted)


def ordered(name: str, value: Column, reference: str, order: Column) -> Column:
    """Texts by an order map."""
    a, b = F.try_element_at(order, value), F.try_element_at(order, F.lit(reference))
    return a > b if name == "MORE_THAN" else a < b


def direction(name: str, lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    return toward(name, lat, lon, F.lit(lat0), F.lit(lon0))


def listed(value: Column) -> Column:
    """The value is there at all."""
    return value.isNotNull()


def predicate(kind: str, name: str, value: Column | tuple[Column, Column], reference, order: Column | None = None) -> Column:
    """The predicate for a kind of value; a name that the kind does not have fails."""
    if name == "LISTED":
        return listed(value)
    if name not in BY_KIND.get(kind, ()):
        raise ValueError(f"{kind} has no constraint {name}")
    if kind == "GlobeCoordinate":
        return direction(name, *value, *reference)
    if kind == "WikibaseItem":
        return items(name, value, reference if isinstance(reference, (list, tuple)) else [reference])
    if kind == "OrderedString":
        return ordered(name, value, reference, order)
    if name in ("IS_ANY", "IS_NOT_ANY"):
        return among(name, value, reference)
    return compare(name, value, reference)


def chain(rows: DataFrame, group: list[str], predicates: Sequence[Column], least: int, most: int) -> DataFrame:
    """Constraints one after another, each on the last one's survivors; a group stops at its first prefix that leaves least
    to most entities. (group, n_constraints, n_entities); groups without such a prefix are left out. One pass."""
    prefixes = [reduce(lambda a, b: a & b, predicates[: i + 1]) for i in range(len(predicates))]
    counts = rows.groupBy(*group).agg(*[F.count_if(p).alias(f"__c{i}") for i, p in enumerate(prefixes)])
    fits = F.filter(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.col(f"__c{i}").alias("n")) for i in range(len(prefixes))]), lambda s: (s["n"] >= least) & (s["n"] <= most))
    return counts.withColumn("__f", F.get(fits, F.lit(0))).filter("__f is not null").select(*group, F.col("__f.k").alias("n_constraints"), F.col("__f.n").alias("n_entities"))


def coverage_gate(rows: DataFrame, group: list[str], value: str, share: float, least: int) -> DataFrame:
    """Groups in which enough entities have the value: at least share of them, and at least `least`."""
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), F.count(value).alias("n_with"))
    return out.filter(F.col("n_with") >= F.greatest(F.col("n") * share, F.lit(least)))


def pass_rate_gate(rows: DataFrame, group: list[str], passes: Column, low: float = 0.5, high: float = 0.9) -> DataFrame:
    """Groups in which a constraint leaves some and drops some: the passing share is from max(low, m / n) to high, where m
    is 2 for three entities and 3 for any other number."""
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(passes).alias("n_pass"))
    floor = F.greatest(F.lit(low), F.when(F.col("n") == 3, 2).otherwise(3) / F.col("n"))
    return out.filter((F.col("n_pass") / F.col("n") >= floor) & (F.col("n_pass") / F.col("n") <= high))


def single_valued(rows: DataFrame, group: list[str], entity: str) -> DataFrame:
    """Groups in which each entity has one statement."""
    return rows.groupBy(*group, entity).count().groupBy(*group).agg(F.max("count").alias("most")).filter("most = 1").select(*group)


def varied(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Groups with two distinct values or more."""
    return rows.groupBy(*group).agg(F.countDistinct(value).alias("n_values")).filter("n_values >= 2")


def all_labelled(rows: DataFrame, group: list[str], label: str) -> DataFrame:
    """Groups in which no label is a bare item id."""
    return rows.groupBy(*group).agg(F.bool_and(~F.col(label).rlike("^Q[0-9]+$")).alias("ok")).filter("ok").select(*group)


def item_eligible(rows: DataFrame, group: list[str], entity: str, item: str) -> DataFrame:
    """Groups (entity, item rows) fit for counting by item: over two entities, under 20 items each, not all items shared by
    all, and some item in two entities or more but not in all."""
    distinct = rows.select(*group, entity, item).distinct()
    per_entity = distinct.groupBy(*group, entity).agg(F.count("*").alias("k")).groupBy(*group).agg(F.count("*").alias("n"), F.max("k").alias("most"))
    per_item = distinct.groupBy(*group, item).agg(F.count("*").alias("in_"))
    joined = per_item.join(per_entity, group).groupBy(*group, "n", "most").agg(F.max(F.when((F.col("in_") >= 2) & (F.col("in_") < F.col("n")), 1).otherwise(0)).alias("some"), F.min("in_").alias("least"))
    return joined.filter("n > 2 and most < 20 and some = 1 and least < n").select(*group, "n")


def hop_eligible(rows: DataFrame, group: list[str], entity: str, item: str, share: float = 0.25, most: int = 50) -> DataFrame:
    """Groups whose items can be hopped to: not all are shared, there are more than share of the entities', at most `most`."""
    distinct = rows.select(*group, entity, item).distinct()
    n = distinct.groupBy(*group).agg(F.countDistinct(entity).alias("n"), F.countDistinct(item).alias("n_items"))
    shared = distinct.groupBy(*group, item).agg(F.count("*").alias("in_")).join(n, group).groupBy(*group, "n", "n_items").agg(F.count_if(F.col("in_") == F.col("n")).alias("n_shared"))
    return shared.filter((F.col("n_shared") < F.col("n_items")) & (F.col("n_items") / F.col("n") > share) & (F.col("n_items") <= most))


def valid_value_list(rows: DataFrame, group: list[str], value: str, rule: int = 2) -> DataFrame:
    """Groups whose values make a counting question. Rule 1: over one distinct value, not two rows, some value twice or
    more but not in all. Rule 2: two rows never; three need a value in all; four or more need one over three times."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("c")).groupBy(*group).agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.max("c").alias("top"), F.collect_set("c").alias("cs"))
    if rule == 1:
        ok = (F.col("kinds") > 1) & (F.col("n") != 2) & F.exists("cs", lambda c: (c >= 2) & (c < F.col("n")))
    else:
        ok = F.when(F.col("n") == 2, False).when(F.col("n") == 3, F.col("top") == 3).otherwise((F.col("n") >= 4) & (F.col("top") > 3))
    return counts.filter(ok).select(*group, "n")


def without_listed(rows: DataFrame, column: str, banned: DataFrame) -> DataFrame:
    """Rows whose key is not in a list."""
    return rows.join(banned.select(F.col(banned.columns[0]).alias(column)).distinct(), column, "left_anti")


def unfinished(queries: DataFrame, done: DataFrame, key: str, least: int | None = None) -> DataFrame:
    """Queries still to do: those not done, and, with least, the last done one if it has fewer rows than that."""
    finished = done.groupBy(key).agg(F.count("*").alias("n"), F.max("pos").alias("last")) if least is not None else done.select(key).distinct()
    if least is not None:
        top = finished.agg(F.max("last").alias("top"))
        finished = finished.join(top, F.lit(True)).filter(~((F.col("last") == F.col("top")) & (F.col("n") < least))).select(key)
    return queries.join(finished, key, "left_anti")


def lexical_match(contents: Column, value: Column) -> Column:
    """The value stands in a passage, whatever its case; yes and no prove nothing."""
    v = F.lower(value)
    return ~v.isin("yes", "no") & F.contains(F.lower(contents), v)
