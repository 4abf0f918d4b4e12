"""Choosing candidates: all are enumerated in parallel, and seeded choices are made on small tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(seed: int, *columns: str) -> Column:
    """A number that depends on the seed and the row alone."""
    return F.xxhash64(F.lit(seed), *columns)


def sample(rows: DataFrame, key: str, n: int | None = None, share: float | None = None, seed: int = 42) -> DataFrame:
    """All rows, a share of them, or n, by a seeded hash of the key: the same rows at each run."""
    h = draw(seed, key)
    if share is not None:
        return rows.filter(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
    return rows if n is None else rows.orderBy(h, key).limit(n)


def round_robin(rows: DataFrame, order: str, workers: int) -> DataFrame:
    """rows (order: whole numbers from 0, without gaps) with the worker that each goes to, in turn."""
    return rows.withColumn("worker", F.pmod(F.col(order), F.lit(workers)).cast("int"))


def property_budget(n: Column, most: int | None = None) -> Column:
    """How many of n properties to use: the whole part of log2 n, plus one."""
    out = F.when(n > 0, F.floor(F.log2(n.cast("double"))) + 1).otherwise(0)
    return out if most is None else F.least(out, F.lit(most))


def quantile_pick(values: Column, q: float) -> Column:
    """The value at a quantile of a list, not interpolated."""
    s = F.sort_array(values)
    return F.get(s, F.least(F.size(s) - 1, F.floor(F.size(s) * q).cast("int")))


def nearest(rows: DataFrame, group: list[str], lat0: Column, lon0: Column) -> DataFrame:
    """Each group's row nearest to a point, by the sum of absolute differences; ties go to the least entity."""
    w = Window.partitionBy(*group).orderBy(F.abs(F.col("lat") - lat0) + F.abs(F.col("lon") - lon0), "entity_id")
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def references(rows: DataFrame, group: list[str], value: str, low: float = 0.3, high: float = 0.9) -> DataFrame:
    """Every member value as a reference for a strict 'less than' count, with the share below it, kept if it is from low to
    high; a share of 0 never is. Ranks over distinct values, so no pairs."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*group)
    below = F.coalesce(F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = counts.withColumn("n_below", below).withColumn("n", F.sum("c").over(w)).withColumn("share", F.col("n_below") / F.col("n"))
    return out.filter((F.col("share") >= low) & (F.col("share") <= high) & (F.col("share") > 0)).select(*group, value, "n_below", "share")


def widened(options: DataFrame, group: list[str], share: str, low: float, high: float, step: float = 0.01, seed: int = 42) -> DataFrame:
    """One option for each group: one whose share lies in the window, else in the least widened window that holds one."""
    miss = F.greatest(F.lit(0.0), F.lit(low) - F.col(share), F.col(share) - F.lit(high))
    w = Window.partitionBy(*group).orderBy(F.ceil(F.round(miss / step, 6)), draw(seed, *group, share), share)
    return options.filter(F.col(share) > 0).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def least_used(options: DataFrame, group: list[str], usage: list[str], key: str, seed: int = 42) -> DataFrame:
    """The option of each group that has been used least, by several counts in turn."""
    w = Window.partitionBy(*group).orderBy(*usage, draw(seed, key), key)
    return options.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def usage(direct: DataFrame, hops: DataFrame, key: str) -> DataFrame:
    """How often each key is used, directly and by a hop."""
    d = direct.groupBy(key).agg(F.count("*").alias("direct"))
    h = hops.groupBy(key).agg(F.count("*").alias("hop"))
    return d.join(h, key, "full").select(key, F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("hop", F.lit(0)).alias("hop"))


def property_stats(rows: DataFrame) -> DataFrame:
    """(prop_id, num_classes, class_ids) of (class_id, prop_id) rows."""
    return rows.groupBy("prop_id").agg(F.countDistinct("class_id").alias("num_classes"), F.array_sort(F.collect_set("class_id")).alias("class_ids"))


def scarce_first(stats: DataFrame) -> DataFrame:
    return stats.orderBy("num_classes", "prop_id")


def balanced(candidates: DataFrame, per_class: int = 1, seed: int = 42, most_rows: int = 1_000_000) -> DataFrame:
    """A greedy choice with running counters: classes with the fewest candidates first, each taking its least used
    properties. Counters are shared by all, so the (class, property) table, not the data, goes through one group; one of over
    most_rows rows is refused."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[str, int] = {}
        out = []
        sizes = pdf.groupby("class_id")["prop_id"].transform("size")
        for _, group in sorted(pdf.assign(__n=sizes).groupby("class_id"), key=lambda x: (int(x[1]["__n"].iloc[0]), x[0])):
            for _ in range(min(per_class, len(group))):
                left = group[~group["prop_id"].isin([p for c, p in out if c == group["class_id"].iloc[0]])]
                prop = min(left.itertuples(), key=lambda r: (used.get(r.prop_id, 0), r.h, r.prop_id)).prop_id
                used[prop] = used.get(prop, 0) + 1
                out.append((group["class_id"].iloc[0], prop))
        return pd.DataFrame(out, columns=["class_id", "prop_id"])

    keyed = candidates.select("class_id", "prop_id", draw(seed, "class_id", "prop_id").alias("h")).distinct().withColumn("all", F.lit(1))
    if (n := keyed.count()) > most_rows:
        raise ValueError(f"{n} pairs of class and property; a greedy choice takes {most_rows} at most")
    return keyed.groupBy("all").applyInPandas(run, "class_id string, prop_id string")


def candidate_id(n: Column, class_id: Column, aggregated: Column, constrained: Column, hop: tuple[Column, Column] | None = None) -> Column:
    """{n}_{class[-prop-hop]}_{aggregated[-constrained]}."""
    head = class_id if hop is None else F.concat_ws("-", class_id, *hop)
    return F.concat_ws("_", n.cast("string"), head, F.concat_ws("-", aggregated, constrained))
