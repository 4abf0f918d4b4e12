"""Aggregations by name: how to compute each over a group, and when it is valid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import EARTH_KM, haversine, toward


@dataclass(frozen=True)
class Operation:
    """expr makes the aggregate of a value column; valid tells, as an aggregate, whether it makes a question."""

    expr: Callable[..., Column]
    valid: Callable[[Column], Column]


def at_least(n: int, more: Callable[[Column], Column] = lambda v: F.lit(True)) -> Callable[[Column], Column]:
    return lambda v: (F.count(v) >= n) & more(v)


def top(v: Column, k: int, largest: bool) -> Column:
    return F.slice(F.sort_array(F.collect_list(v), asc=not largest), 1, k)


def total(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y))


differ = at_least(2, lambda v: F.max(v) != F.min(v))
NUMERIC: dict[str, Operation] = {
    "SUM": Operation(lambda v: F.sum(v), at_least(2)),
    "SUM_TOP_K": Operation(lambda v, k: total(top(v, k, True)), at_least(3)),
    "SUM_BOTTOM_K": Operation(lambda v, k: total(top(v, k, False)), at_least(3)),
    "AVG": Operation(lambda v: F.avg(v), at_least(2)),
    "AVG_TOP_K": Operation(lambda v, k: total(top(v, k, True)) / F.least(F.lit(k), F.count(v)), at_least(3)),
    "AVG_BOTTOM_K": Operation(lambda v, k: total(top(v, k, False)) / F.least(F.lit(k), F.count(v)), at_least(3)),
    "MAX": Operation(lambda v: F.max(v), at_least(2)),
    "MIN": Operation(lambda v: F.min(v), at_least(2, lambda v: F.min(v) != 0)),
    "MEDIAN": Operation(lambda v: F.median(v), at_least(3)),
    "DIFFERENCE(MAX-MIN)": Operation(lambda v: F.max(v) - F.min(v), differ),
    "RATIO(MAX/MIN)": Operation(lambda v: F.try_divide(F.max(v), F.min(v)), at_least(2, lambda v: (F.min(v) != 0) & (F.max(v) != 0))),
    "COUNT_LT_X": Operation(lambda v, x: F.count_if(v < x), at_least(3)),
    "COUNT_GT_X": Operation(lambda v, x: F.count_if(v > x), at_least(3)),
    "VARIANCE": Operation(lambda v: F.var_pop(v), at_least(1)),
    "STDDEV": Operation(lambda v: F.stddev_pop(v), at_least(1)),
    "MAX_DIFF": Operation(lambda v: F.max(v) - F.min(v), at_least(1)),
    "COUNT": Operation(lambda v: F.count(v), at_least(0)),
}
TIMES: dict[str, Operation] = {
    "EARLIEST": Operation(lambda y: F.min(y), at_least(2)),
    "LATEST": Operation(lambda y: F.max(y), at_least(2)),
    "NTH_EARLIEST": Operation(lambda y, n: F.get(F.sort_array(F.collect_list(y)), F.lit(n - 1)), at_least(3)),
    "NTH_LATEST": Operation(lambda y, n: F.get(F.sort_array(F.collect_list(y), asc=False), F.lit(n - 1)), at_least(3)),
    "COUNT_BEFORE": Operation(lambda t, x: F.count_if(t < x), at_least(3)),
    "COUNT_AFTER": Operation(lambda t, x: F.count_if(t > x), at_least(3)),
    "TIME_BETWEEN_FIRST_LAST": Operation(lambda y: F.max(y) - F.min(y), at_least(2)),
}
#: What each kind of value allows in the annotated-query flow.
ALLOWED = {"Time": ("EARLIEST", "LATEST", "AVG"), "Quantity": ("SUM", "AVG", "MAX", "MIN", "COUNT")}


def canonical(name: str) -> str:
    """Names with the sign U+2212 are those with an ASCII hyphen."""
    return name.replace("−", "-")


def allowed(kind: str) -> tuple[str, ...]:
    return ALLOWED.get(kind, ("COUNT",))


def operation(name: str) -> Operation:
    name = canonical(name)
    if name not in NUMERIC and name not in TIMES:
        raise ValueError(f"no operation: {name}")
    return NUMERIC.get(name) or TIMES[name]


def aggregate(rows: DataFrame, group: list[str], value: str, names: dict[str, tuple]) -> DataFrame:
    """Several operations in one pass: names has the arguments of each; columns are named by lower-cased operation. Where
    an operation is not valid for a group its column is null."""
    v = F.col(value)
    column = lambda n: canonical(n).lower().replace("(", "_").replace(")", "").replace("-", "_").replace("/", "_")
    return rows.groupBy(*group).agg(*[F.when(operation(n).valid(v), operation(n).expr(v, *args)).alias(column(n)) for n, args in names.items()])


# ---- top-k without collecting a group


def top_k(rows: DataFrame, group: list[str], value: str, k: int, largest: bool = True) -> DataFrame:
    """(group, sum_k, avg_k): a ranked limit in each group, for groups too large for a list."""
    order = F.desc(value) if largest else F.asc(value)
    ranked = rows.filter(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(order))).filter(F.col("__r") <= k)
    return ranked.groupBy(*group).agg(F.sum(value).alias("sum_k"), F.avg(value).alias("avg_k"))


# ---- places


def pairwise_distance(rows: DataFrame, group: list[str], entity: str, lat: str = "lat", lon: str = "lon", block: int = 4096) -> DataFrame:
    """(group, max_km, min_km, n_pairs) over the pairs of a group's entities (rows of one entity are no pair, and a null place
    has no distance). A group is cut into blocks of about `block` rows; a task gets two blocks at a time and works on tiles of
    their distances, so no pair becomes a row and no task holds a group."""
    held = rows.select(*group, F.col(entity).alias("__e"), F.col(lat).cast("double").alias("__la"), F.col(lon).cast("double").alias("__lo")).filter("__e is not null")
    cuts = held.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("__cuts"))
    mine = F.pmod(F.xxhash64("__e"), "__cuts").cast("int")
    dealt = held.join(cuts, group).withColumn("__mine", mine).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__cuts") - 1)))
    dealt = dealt.withColumns({"__x": F.least("__mine", "__other"), "__y": F.greatest("__mine", "__other"), "__side": (F.col("__mine") > F.col("__other")).cast("int")})
    numbered = {e: i for i, e in enumerate(group)}

    def extremes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pd.factorize(pdf["__e"])[0]
        la, lo, side = np.radians(pdf["__la"].to_numpy()), np.radians(pdf["__lo"].to_numpy()), pdf["__side"].to_numpy()
        own, most, least, n = key[len(numbered)] == key[len(numbered) + 1], -np.inf, np.inf, 0
        for a in range(0, len(ids), 1024):
            for b in range(a if own else 0, len(ids), 1024):
                i, j = slice(a, a + 1024), slice(b, b + 1024)
                pair = ids[i, None] != ids[None, j]
                pair &= np.arange(a, a + pair.shape[0])[:, None] < np.arange(b, b + pair.shape[1])[None, :] if own else (side[i, None] == 0) & (side[None, j] == 1)
                h = np.sin((la[None, j] - la[i, None]) / 2) ** 2 + np.cos(la[i, None]) * np.cos(la[None, j]) * np.sin((lo[None, j] - lo[i, None]) / 2) ** 2
                km = (2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h))))[pair]
                n += len(km)
                km = km[~np.isnan(km)]
                if len(km):
                    most, least = max(most, km.max()), min(least, km.min())
        some = most > -np.inf
        return pd.DataFrame({**{g: [key[i]] for g, i in numbered.items()}, "max_km": [most if some else None], "min_km": [least if some else None], "n_pairs": [n]})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema)
    parts = dealt.groupBy(*group, "__x", "__y").applyInPandas(extremes, f"{kinds}, max_km double, min_km double, n_pairs long")
    return parts.groupBy(*group).agg(F.max("max_km").alias("max_km"), F.min("min_km").alias("min_km"), F.sum("n_pairs").alias("n_pairs")).filter("n_pairs > 0")


def within_radius(lat: Column, lon: Column, lat0: float, lon0: float, km: float) -> Column:
    return F.count_if(haversine(lat, lon, F.lit(lat0), F.lit(lon0)) <= km)


def in_direction(name: str, lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    return F.count_if(toward(name, lat, lon, F.lit(lat0), F.lit(lon0)))


def view_sums(rows: DataFrame, page: str, views: str) -> DataFrame:
    """(page, views) summed over a page's days; a missing number of views counts as 0."""
    return rows.groupBy(page).agg(F.sum(F.coalesce(F.col(views), F.lit(0))).alias(views))


# ---- items, modes and shares


def count_items(name: str, held: Column, wanted: list[str]) -> Column:
    """COUNT_HAS_X, COUNT_NOT_HAS_X, COUNT_HAS_ANY_X, COUNT_NOT_HAS_ANY_X over lists of items."""
    from .constraints import items

    return F.count_if(items(name.removeprefix("COUNT_").removesuffix("_X"), held, wanted))


def unique_mode(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n): the most common value, of groups of three rows or more where it is the only one."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group)
    ranked = counts.withColumn("__r", F.rank().over(w.orderBy(F.desc("n")))).withColumn("__all", F.sum("n").over(w)).filter("__r = 1")
    return ranked.withColumn("__ties", F.count("*").over(w)).filter("__ties = 1 and __all >= 3").select(*group, value, "n")


def percentage(value: Column, chosen) -> Column:
    return 100.0 * F.count_if(value == chosen) / F.count(F.lit(1))


def target_item(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n): what to count: the most frequent value that is there twice or more but not always, else the
    most frequent one. Ties go to the least value."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group)
    counts = counts.withColumn("__all", F.sum("n").over(w)).withColumn("__fit", ((F.col("n") >= 2) & (F.col("n") < F.col("__all"))).cast("int"))
    return counts.withColumn("__r", F.row_number().over(w.orderBy(F.desc("__fit"), F.desc("n"), value))).filter("__r = 1").select(*group, value, "n")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins from low to high, 0 below and bins + 1 from high on; empty bins are left out."""
    return rows.filter(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
