"""Significance of a difference between two systems over shared queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def paired(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """(qid, a, b, diff) over queries that both have; a missing value counts as 0."""
    value = lambda d, n: d.select("qid", F.coalesce(F.col(metric).cast("double"), F.lit(0.0)).alias(n))
    return value(a, "a").join(value(b, "b"), "qid").withColumn("diff", F.col("a") - F.col("b"))


def wilcoxon(pairs: DataFrame) -> dict[str, float]:
    """Two-sided signed-rank test with tied ranks averaged and zero differences left out: by the exact distribution for
    EXACT_MOST differences or fewer without ties, else by the normal approximation with tie correction. The ranks of distinct
    sizes are windowed over one row for each size, not for each query."""
    sizes = pairs.filter("diff <> 0").groupBy(F.round(F.abs("diff"), 12).alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("diff") > 0).alias("pos"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", before + (F.col("n") + 1) / 2.0)
    r = ranked.agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("pos")).alias("plus"), F.sum(F.col("rank") * (F.col("n") - F.col("pos"))).alias("minus"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties")).first()
    if not r.n:
        return {"n": 0, "statistic": 0.0, "p_value": 1.0}
    n, stat = r.n, min(r.plus, r.minus)
    if n <= EXACT_MOST and not r.ties:
        return {"n": n, "statistic": stat, "p_value": exact_p(n, int(stat))}
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - r.ties / 48)
    z = (stat - n * (n + 1) / 4) / spread if spread else 0.0
    return {"n": n, "statistic": stat, "p_value": math.erfc(abs(z) / math.sqrt(2))}


#: Differences for which the exact distribution is taken, at most.
EXACT_MOST = 50


def exact_p(n: int, stat: int) -> float:
    """The two-sided chance of a rank sum as low as stat: of all 2^n choices of signs, how many have one."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for s in range(len(ways) - 1, rank - 1, -1):
            ways[s] += ways[s - rank]
    return min(1.0, 2 * sum(ways[: stat + 1]) / 2**n)


def bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(mean_diff, low, high): the interval of the mean difference over resamples drawn with replacement. Each pair of
    resample and draw picks a query by a hash, so any cluster draws alike."""
    rows = pairs.select("diff", (F.row_number().over(Window.orderBy("qid")) - 1).alias("i"))
    n = rows.count()
    spark = pairs.sparkSession
    draws = spark.range(resamples).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("d")).withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "b", "d"), F.lit(max(n, 1))).cast("int"))
    means = draws.join(rows, "i").groupBy("b").agg(F.avg("diff").alias("m"))
    tail = (1 - level) / 2
    ends = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return pairs.agg(F.avg("diff").alias("mean_diff")).join(ends)


def compare(a: DataFrame, b: DataFrame, metric: str, resamples: int = 10_000) -> DataFrame:
    """One row: queries, means, interval and p value."""
    p = paired(a, b, metric)
    w = wilcoxon(p)
    head = p.agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    return head.join(bootstrap(p, resamples)).withColumn("p_value", F.lit(w["p_value"]))
