"""Candidates of questions: which entities pass a constraint, what an operation makes of them, and how a quota is filled."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .aggregates import operation
from .selection import draw

#: The numeric constraints that a table of candidates may name.
COMPARISONS = {"GT": lambda v, r: v > r, "GTE": lambda v, r: v >= r, "LT": lambda v, r: v < r, "LTE": lambda v, r: v <= r}


def kept_entities(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the entities of a list, by one key or several; a null key is in no list."""
    return rows.join(ids.select(*keys).distinct(), keys, "left_semi")


def paired_values(aggregated: DataFrame, constrained: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, place, aggregated, constrained): the n-th value of one property with the n-th of another, values of an entity in
    order; what has no partner goes."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(value))
    a = aggregated.filter(F.col(value).isNotNull()).select(key, place.alias("place"), F.col(value).alias("aggregated"))
    c = constrained.filter(F.col(value).isNotNull()).select(key, place.alias("place"), F.col(value).alias("constrained"))
    return a.join(c, [key, "place"])


def materialised(candidates: DataFrame, members: DataFrame, values: DataFrame, names: dict[str, tuple], least: int = 2) -> DataFrame:
    """What each candidate asks, answered: (candidate_id, operation, n_entities, answer).

    candidates: candidate_id, class_id, constrained, comparison, reference, aggregated, operation; members: class_id,
    entity_id; values: entity_id, prop_id, value. The members of its class whose constrained property compares as it says
    pass; the operation is made of their aggregated property. Candidates with under `least` such entities, or for which the
    operation is not valid, go. names: the operations that may occur, with their arguments."""
    passes = F.lit(False)
    for name, holds in COMPARISONS.items():
        passes = F.when(F.col("comparison") == name, holds(F.col("value"), F.col("reference"))).otherwise(passes)
    rows = candidates.join(members.distinct(), "class_id")
    constrained = values.select("entity_id", F.col("prop_id").alias("constrained"), "value")
    passed = rows.join(constrained, ["entity_id", "constrained"]).filter(passes).drop("value").distinct()
    asked = passed.join(values.select("entity_id", F.col("prop_id").alias("aggregated"), F.col("value").alias("v")), ["entity_id", "aggregated"])
    v, answer = F.col("v"), F.lit(None).cast("double")
    for name, args in names.items():
        op = operation(name)
        answer = F.when(F.first("operation") == name, F.when(op.valid(v), op.expr(v, *args).cast("double"))).otherwise(answer)
    out = asked.groupBy("candidate_id").agg(F.first("operation").alias("operation"), F.countDistinct("entity_id").alias("n_entities"), answer.alias("answer"))
    return out.filter((F.col("n_entities") >= least) & F.col("answer").isNotNull())


def filled_quota(options: DataFrame, quota: int, seed: int = 42, most_tries: int = 5, most_rows: int = 1_000_000) -> DataFrame:
    """(category, constrained, aggregated): for each category up to `quota` pairs of properties out of options (category,
    constrained, aggregated, fits), the least used constraint first and then the least used aggregate. A pair that does not
    fit is a try lost, and a category has most_tries tries for each of its quota. Counters are a category's own, so categories
    are groups; a category of over most_rows options is refused."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_rows:
            raise ValueError(f"{len(pdf)} options in a category; {most_rows} at most")
        used: dict[tuple[str, str], int] = {}
        left = sorted(zip(pdf["constrained"], pdf["aggregated"], pdf["fits"], pdf["h"], strict=True), key=lambda o: o[3])
        out: list[tuple[str, str]] = []
        for _ in range(most_tries * quota):
            if not left or len(out) == quota:
                break
            best = min(left, key=lambda o: (used.get(("c", o[0]), 0), used.get(("a", o[1]), 0), o[3], o[:2]))
            left.remove(best)
            if best[2]:
                out.append(best[:2])
                used["c", best[0]] = used.get(("c", best[0]), 0) + 1
                used["a", best[1]] = used.get(("a", best[1]), 0) + 1
        return pd.DataFrame([(pdf["category"].iloc[0], *o) for o in out], columns=["category", "constrained", "aggregated"])

    keyed = options.select("category", "constrained", "aggregated", "fits", draw(seed, "category", "constrained", "aggregated").alias("h"))
    return keyed.groupBy("category").applyInPandas(run, "category string, constrained string, aggregated string")
