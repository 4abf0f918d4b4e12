"""Queries of constraints, aggregations, units, times, the knowledge base and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, strings, times, units
from ..operators import aggregates as A
from ..operators import constraints as C
from ..operators import kb, selection
from .registry import query

NATIONS = "SELECT s_nationkey, s_acctbal AS v FROM supplier"


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("""
WITH t AS (SELECT s_nationkey, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS hi, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS lo FROM supplier)
SELECT s_nationkey, CASE WHEN count(*) >= 2 THEN round(sum(v), 6) END AS "sum", CASE WHEN count(*) >= 3 THEN round(sum(CASE WHEN hi <= 2 THEN v END), 6) END AS sum_top_k, CASE WHEN count(*) >= 3 THEN round(sum(CASE WHEN lo <= 2 THEN v END), 6) END AS sum_bottom_k,
  CASE WHEN count(*) >= 2 THEN round(avg(v), 6) END AS "avg", CASE WHEN count(*) >= 3 THEN round(sum(CASE WHEN hi <= 2 THEN v END) / 2, 6) END AS avg_top_k, CASE WHEN count(*) >= 3 THEN round(sum(CASE WHEN lo <= 2 THEN v END) / 2, 6) END AS avg_bottom_k,
  CASE WHEN count(*) >= 2 THEN max(v) END AS "max", CASE WHEN count(*) >= 2 AND min(v) <> 0 THEN min(v) END AS "min", CASE WHEN count(*) >= 3 THEN round(median(v), 6) END AS median,
  CASE WHEN count(*) >= 2 AND max(v) <> min(v) THEN round(max(v) - min(v), 6) END AS difference_max_min, CASE WHEN count(*) >= 2 AND min(v) <> 0 AND max(v) <> 0 THEN round(max(v) / min(v), 6) END AS ratio_max_min,
  CASE WHEN count(*) >= 3 THEN count(CASE WHEN v < 5000 THEN 1 END) END AS count_lt_x, CASE WHEN count(*) >= 3 THEN count(CASE WHEN v > 5000 THEN 1 END) END AS count_gt_x
FROM t GROUP BY s_nationkey""")
def agg_numeric(t):
    names = {"SUM": (), "SUM_TOP_K": (2,), "SUM_BOTTOM_K": (2,), "AVG": (), "AVG_TOP_K": (2,), "AVG_BOTTOM_K": (2,), "MAX": (), "MIN": (), "MEDIAN": (), "DIFFERENCE(MAX−MIN)": (), "RATIO(MAX/MIN)": (), "COUNT_LT_X": (5000.0,), "COUNT_GT_X": (5000.0,)}
    out = A.aggregate(t.supplier, ["s_nationkey"], "s_acctbal", names)
    return r6(out, "sum", "sum_top_k", "sum_bottom_k", "avg", "avg_top_k", "avg_bottom_k", "median", "difference_max_min", "ratio_max_min")


@query("""SELECT p_brand, round(var_pop(p_retailprice), 4) AS variance, round(stddev_pop(p_retailprice), 6) AS stddev, round(max(p_retailprice) - min(p_retailprice), 6) AS max_diff, count(p_retailprice) AS "count" FROM part GROUP BY p_brand""")
def agg_population(t):
    out = A.aggregate(t.part, ["p_brand"], "p_retailprice", {"VARIANCE": (), "STDDEV": (), "MAX_DIFF": (), "COUNT": ()})
    return out.withColumns({"variance": F.round("variance", 4), "stddev": F.round("stddev", 6), "max_diff": F.round("max_diff", 6)})


@query("""SELECT l_suppkey, round(sum(l_quantity), 6) AS sum_k, round(avg(l_quantity), 6) AS avg_k FROM (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r <= 5 GROUP BY l_suppkey""")
def agg_top_k_ranked(t):
    return r6(A.top_k(t.lineitem, ["l_suppkey"], "l_quantity", 5), "sum_k", "avg_k")


@query("""
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y FROM orders), l AS (SELECT o_custkey, list(y ORDER BY y) AS a, count(*) AS n FROM y GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n >= 2 THEN a[1] END AS earliest, CASE WHEN n >= 2 THEN a[-1] END AS latest, CASE WHEN n >= 3 THEN a[2] END AS nth_earliest, CASE WHEN n >= 3 THEN a[-2] END AS nth_latest, CASE WHEN n >= 2 THEN a[-1] - a[1] END AS time_between_first_last FROM l""")
def agg_temporal(t):
    rows = t.orders.select("o_custkey", F.year("o_orderdate").cast("long").alias("y"))
    return A.aggregate(rows, ["o_custkey"], "y", {"EARLIEST": (), "LATEST": (), "NTH_EARLIEST": (2,), "NTH_LATEST": (2,), "TIME_BETWEEN_FIRST_LAST": ()})


@query("""SELECT o_custkey, CASE WHEN count(*) >= 3 THEN count(CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 1 END) END AS count_before, CASE WHEN count(*) >= 3 THEN count(CASE WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 1 END) END AS count_after FROM orders GROUP BY o_custkey""")
def agg_before_after(t):
    at = F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))
    return A.aggregate(t.orders, ["o_custkey"], "o_orderdate", {"COUNT_BEFORE": (at,), "COUNT_AFTER": (at,)})


@query("""SELECT o_custkey, year(max(o_orderdate)) - year(min(o_orderdate)) AS years, 12 * (year(max(o_orderdate)) - year(min(o_orderdate))) + month(max(o_orderdate)) - month(min(o_orderdate)) AS months, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS days FROM orders GROUP BY o_custkey""")
def time_between(t):
    g = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    diff = lambda p: times.between_first_and_last(F.col("a"), F.col("b"), p).cast("long")
    return g.select("o_custkey", diff("year").alias("years"), diff("month").alias("months"), diff("day").alias("days"))


POINTS = "(SELECT vec_id, label, 90 * CAST(embedding[1] AS DOUBLE) AS lat, 180 * CAST(embedding[2] AS DOUBLE) AS lon FROM embeddings)"
KM = "2 * 6371.0 * asin(sqrt(least(1.0, power(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * power(sin((radians({b}lon) - radians({a}lon)) / 2), 2))))"


def points(t):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return t.embeddings.select("vec_id", "label", (90 * at(0)).alias("lat"), (180 * at(1)).alias("lon"))


@query(f"""WITH p AS (SELECT *, vec_id // 100 AS grp FROM {POINTS}) SELECT a.grp, round(max({KM.format(a='a.', b='b.')}), 4) AS max_km, round(min({KM.format(a='a.', b='b.')}), 4) AS min_km, count(*) AS n_pairs FROM p a JOIN p b ON a.grp = b.grp AND a.vec_id < b.vec_id GROUP BY a.grp""")
def spatial_pairwise(t):
    """Entity sets of a hundred points each, over the whole table."""
    out = A.pairwise_distance(points(t).withColumn("grp", F.floor(F.col("vec_id") / 100)), ["grp"], "vec_id")
    return out.select("grp", F.round("max_km", 4).alias("max_km"), F.round("min_km", 4).alias("min_km"), "n_pairs")


@query(f"""SELECT label, count(CASE WHEN {KM.format(a='p.', b='q.')} <= 2000 THEN 1 END) AS near, count(CASE WHEN lat > 1 THEN 1 END) AS n, count(CASE WHEN lat < 1 AND lon < 2 THEN 1 END) AS sw, count(CASE WHEN lat > 1 AND lon > 2 THEN 1 END) AS ne FROM {POINTS} p, (SELECT 1.0 AS lat, 2.0 AS lon) q GROUP BY label""".replace("lat > 1", "p.lat > 1").replace("lat < 1", "p.lat < 1").replace("lon < 2", "p.lon < 2").replace("lon > 2", "p.lon > 2"))
def spatial_counts(t):
    lat, lon = F.col("lat"), F.col("lon")
    return points(t).groupBy("label").agg(A.within_radius(lat, lon, 1.0, 2.0, 2000.0).alias("near"), A.in_direction("N", lat, lon, 1.0, 2.0).alias("n"), A.in_direction("SW", lat, lon, 1.0, 2.0).alias("sw"), A.in_direction("NE", lat, lon, 1.0, 2.0).alias("ne"))


@query(f"""SELECT vec_id, lat > 5 AS n, lat < 5 AS s, lon > -3 AS e, lon < -3 AS w, lat > 5 AND lon > -3 AS ne, lat > 5 AND lon < -3 AS nw, lat < 5 AND lon > -3 AS se, lat < 5 AND lon < -3 AS sw FROM {POINTS}""")
def constraint_directions(t):
    return points(t).select("vec_id", *[C.predicate("GlobeCoordinate", d, (F.col("lat"), F.col("lon")), (5.0, -3.0)).alias(d.lower()) for d in geo.DIRECTIONS])


@query("""SELECT s_suppkey, s_acctbal > 5000 AS gt, s_acctbal >= 5000 AS gte, s_acctbal < 5000 AS lt, s_acctbal <= 5000 AS lte FROM supplier""")
def constraint_quantity(t):
    return t.supplier.select("s_suppkey", *[C.predicate("Quantity", n, F.col("s_acctbal"), 5000.0).alias(n.lower()) for n in ("GT", "GTE", "LT", "LTE")])


@query("""SELECT o_orderkey, o_orderdate < TIMESTAMP '1997-06-01' AS before, o_orderdate > TIMESTAMP '1997-06-01' AS after FROM orders""")
def constraint_time(t):
    at = F.to_timestamp_ntz(F.lit("1997-06-01 00:00:00"))
    return t.orders.select("o_orderkey", C.predicate("Time", "BEFORE", F.col("o_orderdate"), at).alias("before"), C.predicate("Time", "AFTER", F.col("o_orderdate"), at).alias("after"))


ITEMS = "(SELECT user_id, list(DISTINCT event_type) AS items FROM events GROUP BY user_id)"


def user_items(t):
    return t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("items"))


@query(f"""SELECT user_id, list_contains(items, 'error') AS "has", NOT list_contains(items, 'error') AS not_has, list_has_any(items, ['error', 'view']) AS has_any, NOT list_has_any(items, ['error', 'view']) AS not_has_any, list_has_all(items, ['error', 'view']) AS has_all, NOT list_has_all(items, ['error', 'view']) AS not_has_all FROM {ITEMS}""")
def constraint_items(t):
    two = ["error", "view"]
    return user_items(t).select("user_id", *[C.predicate("WikibaseItem", n, F.col("items"), two).alias(n.lower()) for n in ("HAS", "NOT_HAS", "HAS_ANY", "NOT_HAS_ANY", "HAS_ALL", "NOT_HAS_ALL")])


@query(f"""SELECT user_id % 10 AS grp, count(CASE WHEN list_contains(items, 'error') THEN 1 END) AS has, count(CASE WHEN NOT list_contains(items, 'error') THEN 1 END) AS not_has, count(CASE WHEN list_has_any(items, ['error', 'view']) THEN 1 END) AS has_any, count(CASE WHEN NOT list_has_any(items, ['error', 'view']) THEN 1 END) AS not_has_any FROM {ITEMS} GROUP BY 1""")
def agg_item_counts(t):
    two = ["error", "view"]
    return user_items(t).groupBy((F.col("user_id") % 10).alias("grp")).agg(*[A.count_items(f"COUNT_{n.upper()}_X", F.col("items"), two).alias(n) for n in ("has", "not_has", "has_any", "not_has_any")])


@query("""SELECT c_custkey, c_mktsegment = 'BUILDING' AS "is", c_mktsegment <> 'BUILDING' AS is_not, c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_any, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS is_not_any FROM customer""")
def constraint_strings(t):
    two = ["BUILDING", "MACHINERY"]
    p = lambda n, r: C.predicate("String", n, F.col("c_mktsegment"), r).alias(n.lower())
    return t.customer.select("c_custkey", p("IS", two[0]), p("IS_NOT", two[0]), p("IS_ANY", two), p("IS_NOT_ANY", two))


@query("""SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INTEGER) > 3 AS more_than, CAST(left(o_orderpriority, 1) AS INTEGER) < 3 AS less_than FROM orders""")
def constraint_ordered_strings(t):
    domain = F.array(*[F.lit(v) for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    p = lambda n: C.predicate("OrderedString", n, F.col("o_orderpriority"), "3-MEDIUM", units.order_keys(domain)).alias(n.lower())
    return t.orders.select("o_orderkey", p("MORE_THAN"), p("LESS_THAN"))


@query("""SELECT source, count(*) AS n, count(quality) AS n_with FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING count(quality) >= greatest(count(*) * 0.3, 5)""")
def gate_coverage(t):
    return C.coverage_gate(t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left"), ["source"], "quality", 0.3, 5)


@query("""SELECT d.doc_id, l.quality IS NOT NULL AS listed FROM documents d LEFT JOIN labels l USING (doc_id)""")
def constraint_listed(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", C.predicate("Quantity", "LISTED", F.col("quality"), None).alias("listed"))


@query("""
WITH c AS (SELECT p_brand, count(CASE WHEN p_size > 10 THEN 1 END) AS a, count(CASE WHEN p_size > 10 AND p_retailprice > 1000 THEN 1 END) AS b, count(CASE WHEN p_size > 10 AND p_retailprice > 1000 AND p_type <> 'ECONOMY' THEN 1 END) AS c FROM part GROUP BY p_brand)
SELECT p_brand, CASE WHEN a BETWEEN 3 AND 30 THEN 1 WHEN b BETWEEN 3 AND 30 THEN 2 ELSE 3 END AS n_constraints, CASE WHEN a BETWEEN 3 AND 30 THEN a WHEN b BETWEEN 3 AND 30 THEN b ELSE c END AS n_entities FROM c WHERE a BETWEEN 3 AND 30 OR b BETWEEN 3 AND 30 OR c BETWEEN 3 AND 30""")
def constraint_chain(t):
    return C.chain(t.part, ["p_brand"], [F.col("p_size") > 10, F.col("p_retailprice") > 1000, F.col("p_type") != "ECONOMY"], 3, 30)


@query("""SELECT s_nationkey, count(*) AS n, count(CASE WHEN s_acctbal > 3000 THEN 1 END) AS n_pass FROM supplier GROUP BY 1 HAVING count(CASE WHEN s_acctbal > 3000 THEN 1 END) / count(*) BETWEEN greatest(0.5, (CASE WHEN count(*) = 3 THEN 2 ELSE 3 END) / count(*)) AND 0.9""")
def gate_pass_rate(t):
    return C.pass_rate_gate(t.supplier, ["s_nationkey"], F.col("s_acctbal") > 3000)


@query("""SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 1""")
def gate_single_valued(t):
    return C.single_valued(t.orders.withColumn("g", F.col("o_custkey")), ["g"], "o_custkey").select(F.col("g").alias("o_custkey"))


@query("""SELECT p_brand, count(DISTINCT p_type) AS n_values FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) >= 2""")
def gate_varied(t):
    return C.varied(t.part, ["p_brand"], "p_type")


@query("""SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING bool_and(NOT regexp_matches(n_name, '^Q[0-9]+$'))""")
def gate_all_labelled(t):
    return C.all_labelled(t.nation, ["n_regionkey"], "n_name")


@query("""
WITH d AS (SELECT DISTINCT user_id % 20 AS g, user_id, event_type FROM events), e AS (SELECT g, count(*) AS n, max(k) AS most FROM (SELECT g, user_id, count(*) AS k FROM d GROUP BY 1, 2) GROUP BY g), i AS (SELECT g, event_type, count(*) AS c FROM d GROUP BY 1, 2)
SELECT g, n FROM i JOIN e USING (g) GROUP BY g, n, most HAVING n > 2 AND most < 20 AND max(CASE WHEN c >= 2 AND c < n THEN 1 ELSE 0 END) = 1 AND min(c) < n""")
def gate_items(t):
    return C.item_eligible(t.events.withColumn("g", F.col("user_id") % 20), ["g"], "user_id", "event_type")


@query("""
WITH d AS (SELECT DISTINCT l_suppkey % 50 AS g, l_suppkey AS e, l_partkey AS i FROM lineitem), n AS (SELECT g, count(DISTINCT e) AS n, count(DISTINCT i) AS n_items FROM d GROUP BY g), s AS (SELECT g, i, count(*) AS c FROM d GROUP BY 1, 2)
SELECT g, n, n_items, count(CASE WHEN c = n THEN 1 END) AS n_shared FROM s JOIN n USING (g) GROUP BY g, n, n_items HAVING count(CASE WHEN c = n THEN 1 END) < n_items AND n_items / n > 0.25 AND n_items <= 5000""")
def gate_hops(t):
    rows = t.lineitem.select((F.col("l_suppkey") % 50).alias("g"), F.col("l_suppkey").alias("e"), F.col("l_partkey").alias("i"))
    return C.hop_eligible(rows, ["g"], "e", "i", most=5000)


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS c FROM part GROUP BY 1, 2) SELECT p_brand, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY p_brand HAVING (sum(c) = 3 AND max(c) = 3) OR (sum(c) >= 4 AND max(c) > 3)""")
def gate_value_list(t):
    return C.valid_value_list(t.part, ["p_brand"], "p_size", 2)


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS c FROM part GROUP BY 1, 2) SELECT p_brand, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY p_brand HAVING count(*) > 1 AND sum(c) <> 2 AND max(CASE WHEN c >= 2 THEN 1 ELSE 0 END) = 1""")
def gate_value_list_first_rule(t):
    return C.valid_value_list(t.part, ["p_brand"], "p_size", 1)


@query("""SELECT * FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def filter_blacklist(t):
    return C.without_listed(t.supplier, "s_nationkey", t.nation.filter("n_regionkey = 1").select("n_nationkey")).select(*t.supplier.columns)


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def filter_resume(t):
    return C.unfinished(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id")


@query("""WITH c AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY p_type ORDER BY n DESC) AS r, sum(n) OVER (PARTITION BY p_type) AS a FROM c), k AS (SELECT *, count(*) OVER (PARTITION BY p_type) AS ties FROM r WHERE r = 1) SELECT p_type, p_size, n FROM k WHERE ties = 1 AND a >= 3""")
def agg_unique_mode(t):
    return A.unique_mode(t.part, ["p_type"], "p_size")


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), a AS (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS a FROM c) SELECT p_brand, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN n >= 2 AND n < a THEN 1 ELSE 0 END DESC, n DESC, p_type) AS r FROM a) WHERE r = 1""")
def agg_target_item(t):
    return A.target_item(t.part, ["p_brand"], "p_type")


@query("""SELECT c_nationkey, round(100.0 * count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) / count(*), 6) AS pct, count(*) AS n FROM customer GROUP BY c_nationkey""")
def agg_percentage(t):
    return t.customer.groupBy("c_nationkey").agg(F.round(A.percentage(F.col("c_mktsegment"), "BUILDING"), 6).alias("pct"), F.count("*").alias("n"))


# ---- units and times


def factor_values(factors):
    """The pairs of a table of factors as SQL rows (i, f)."""
    return ", ".join(f"({i}, CAST({f!r} AS DOUBLE))" for i, f in enumerate(factors.values()))


def pair_of(t, factors):
    """Parts with the units of one pair each, in turn."""
    pairs = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in factors])
    return t.part.select("p_partkey", F.col("p_retailprice").alias("v"), F.get(pairs, (F.col("p_partkey") % len(factors)).cast("int")).alias("p")).select("p_partkey", "v", "p.src", "p.dst")


@query(f"""SELECT p_partkey, p_retailprice * f AS v FROM part JOIN (VALUES {factor_values(units.ITEM_FACTORS)}) x(i, f) ON p_partkey % {len(units.ITEM_FACTORS)} = i""")
def unit_conversion(t):
    return units.converted(pair_of(t, units.ITEM_FACTORS), units.factor_table(t.spark, units.ITEM_FACTORS), "v", "src", "dst").select("p_partkey", "v")


@query(f"""SELECT p_partkey, p_retailprice * f AS v FROM part JOIN (VALUES {factor_values(units.RETAIL_FACTORS)}) x(i, f) ON p_partkey % {len(units.RETAIL_FACTORS)} = i""")
def unit_conversion_retail(t):
    return units.converted(pair_of(t, units.RETAIL_FACTORS), units.factor_table(t.spark, units.RETAIL_FACTORS), "v", "src", "dst", one=None).select("p_partkey", "v")


@query("""WITH u AS (SELECT p_brand, p_type AS u, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, u) AS r FROM u) SELECT p_brand, u AS common FROM r WHERE r = 1""")
def unit_common(t):
    return units.common_unit(t.part, ["p_brand"], "p_type")


_SAID = ", ".join(f"({i}, '{a}', '{n}')" for i, (a, n) in enumerate(units.RETAIL_NAMES.items()))


@query(f"""SELECT p_partkey, CAST(p_size AS DOUBLE) AS "value", n AS unit FROM part LEFT JOIN (VALUES {_SAID}) x(i, a, n) ON p_partkey % {len(units.RETAIL_NAMES) + 1} = i""")
def unit_quantity(t):
    """Sizes with each name of a retail unit in turn, and one that is unknown."""
    names = F.array(*[F.lit(n) for n in [*units.RETAIL_NAMES, "blorps"]])
    name = F.get(names, (F.col("p_partkey") % (len(units.RETAIL_NAMES) + 1)).cast("int"))
    q = units.quantity(F.concat("p_size", F.when(F.col("p_partkey") % 2 == 0, F.lit(" -")).otherwise(F.lit("  ")), name))
    return t.part.select("p_partkey", q.alias("q")).select("p_partkey", "q.value", "q.unit")


@query("""SELECT o_custkey % 7 AS g, o_orderkey, date_trunc('month', o_orderdate) AS at, 'month' AS "precision" FROM orders""")
def time_coarsest(t):
    rows = t.orders.select((F.col("o_custkey") % 7).alias("g"), "o_orderkey", F.col("o_orderdate").alias("at"), F.when(F.col("o_orderkey") % 2 == 0, "month").otherwise("day").alias("precision"))
    return times.coarsest(rows, ["g"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN date_trunc('day', o_orderdate) END AS at, CASE o_orderkey % 4 WHEN 1 THEN 'day' WHEN 2 THEN 'year' WHEN 0 THEN CASE WHEN day(o_orderdate) = 1 AND month(o_orderdate) = 1 THEN 'year' WHEN day(o_orderdate) = 1 THEN 'month' ELSE 'day' END END AS "precision" FROM orders""")
def time_parsing(t):
    """Dates as texts, with a numeric precision, none, or one that is unknown."""
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    kind = F.col("o_orderkey") % 4
    x = times.parsed(text, F.when(kind == 1, 11).when(kind == 2, 9).when(kind == 3, 7))
    return t.orders.select("o_orderkey", x.alias("x")).select("o_orderkey", "x.at", "x.precision")


@query("""SELECT o_orderkey, CAST(date_trunc('year', o_orderdate) AS DATE) AS y0, make_date(year(o_orderdate), 12, 31) AS y1, CAST(date_trunc('month', o_orderdate) AS DATE) AS m0, last_day(o_orderdate) AS m1 FROM orders""")
def time_expansion(t):
    e = lambda p, s: times.expanded(F.col("o_orderdate"), F.lit(p), s)
    return t.orders.select("o_orderkey", e("year", "start").alias("y0"), e("year", "end").alias("y1"), e("month", "start").alias("m0"), e("month", "end").alias("m1"))


SPANS = "(SELECT o_custkey % 500 AS g, o_custkey AS entity_id, o_orderkey AS stmt_id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(400 + o_orderkey % 900 AS INTEGER) AS e FROM orders)"


@query(f"""
WITH x AS (SELECT * FROM {SPANS}), n AS (SELECT g, count(DISTINCT entity_id) AS n FROM x GROUP BY g), ends AS (SELECT DISTINCT g, e FROM x),
live AS (SELECT g, ends.e AS e, entity_id, max(s) AS s FROM ends JOIN x USING (g) WHERE x.s <= ends.e AND ends.e <= x.e GROUP BY 1, 2, 3), ok AS (SELECT g, e, max(s) AS s FROM live JOIN n USING (g) GROUP BY g, e, n HAVING count(*) = n),
b AS (SELECT g, max(e) AS be FROM ok GROUP BY g), best AS (SELECT ok.g, ok.s AS bs, ok.e AS be FROM ok JOIN b ON ok.g = b.g AND ok.e = b.be)
SELECT g, bs AS "start", be AS "end", count(DISTINCT stmt_id) AS n_statements FROM best JOIN x USING (g) WHERE x.s <= bs AND x.e >= be GROUP BY 1, 2, 3""")
def time_shared(t):
    d = F.col("o_orderdate").cast("date")
    rows = t.orders.select((F.col("o_custkey") % 500).alias("g"), F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("stmt_id"), d.alias("start"), F.date_add(d, (400 + F.col("o_orderkey") % 900).cast("int")).alias("end"))
    return times.shared_time(rows, ["g"]).select("g", "start", "end", F.size("statements").cast("long").alias("n_statements"))


@query("""SELECT o_orderkey, year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) || ' (' || day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) || ')' AS s FROM orders""")
def time_rendering(t):
    return t.orders.select("o_orderkey", strings.rendered_time(F.col("o_orderdate"), F.lit("day")).alias("s"))


# ---- a knowledge base of regions, nations and suppliers


def kb_edges(t):
    region = F.concat(F.lit("R"), "r_regionkey")
    return t.region.select(region.alias("child"), F.lit("WORLD").alias("parent")).unionByName(t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent")))


def kb_members(t):
    return t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.concat(F.lit("N"), "s_nationkey").alias("class_id"))


def kb_statements(t):
    ps = t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 45, "preferred").when(F.col("l_quantity") < 5, "deprecated").otherwise("normal").alias("rank"))
    return ps.select(F.concat(F.lit("S"), "l_suppkey").alias("entity_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("stmt_id"), F.concat(F.lit("P"), "l_returnflag", "l_linestatus").alias("prop_id"), "rank")


EDGES = "SELECT 'R' || r_regionkey AS child, 'WORLD' AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation"
UP = f"edges AS ({EDGES}), up(node, ancestor) AS (SELECT n, n FROM (SELECT child AS n FROM edges UNION SELECT parent FROM edges) UNION SELECT up.node, e.parent FROM up JOIN edges e ON e.child = up.ancestor)"
MEMBERS = "members AS (SELECT 'S' || s_suppkey AS entity_id, 'N' || s_nationkey AS class_id FROM supplier), am AS (SELECT DISTINCT entity_id, ancestor AS class_id FROM members JOIN up ON class_id = node)"
STATEMENTS = "statements AS (SELECT 'S' || l_suppkey AS entity_id, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS stmt_id, 'P' || l_returnflag || l_linestatus AS prop_id, CASE WHEN l_quantity > 45 THEN 'preferred' WHEN l_quantity < 5 THEN 'deprecated' ELSE 'normal' END AS rank FROM lineitem)"


@query(f"WITH RECURSIVE {UP} SELECT DISTINCT node, ancestor FROM up")
def kb_closure(t):
    return kb.closure(kb_edges(t))


@query(f"WITH RECURSIVE {UP}, {MEMBERS} SELECT c.class_id, count(DISTINCT entity_id) AS n FROM (SELECT DISTINCT node AS class_id FROM up) c LEFT JOIN am USING (class_id) GROUP BY 1")
def kb_member_counts(t):
    up = kb.closure(kb_edges(t))
    return kb.member_counts(up.select(F.col("node").alias("class_id")).distinct(), kb.class_members(kb_members(t), up))


@query(f"WITH RECURSIVE {UP}, {MEMBERS} SELECT DISTINCT entity_id FROM am WHERE class_id = 'R1' ORDER BY entity_id LIMIT 25")
def kb_instances(t):
    return kb.members_of(kb.class_members(kb_members(t), kb.closure(kb_edges(t))), "R1", 25)


@query(f"WITH {STATEMENTS} SELECT prop_id, count(DISTINCT entity_id) AS entity_count, count(*) AS \"count\" FROM statements WHERE entity_id IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_nationkey < 5) GROUP BY 1")
def kb_property_usage(t):
    return kb.property_usage(kb_statements(t), kb_members(t).filter("class_id in ('N0', 'N1', 'N2', 'N3', 'N4')"))


@query(f"WITH {STATEMENTS}, e AS (SELECT 'S' || s_suppkey AS entity_id FROM supplier WHERE s_nationkey < 5) SELECT prop_id FROM statements JOIN e USING (entity_id) GROUP BY prop_id HAVING count(DISTINCT entity_id) = (SELECT count(*) FROM e)")
def kb_full_properties(t):
    return kb.full_properties(kb_statements(t), kb_members(t).filter("class_id in ('N0', 'N1', 'N2', 'N3', 'N4')"))


@query(f"WITH {STATEMENTS}, b AS (SELECT *, max(CASE rank WHEN 'preferred' THEN 2 WHEN 'normal' THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id, prop_id) AS b FROM statements) SELECT entity_id, prop_id, count(*) AS n FROM b WHERE (b = 2 AND rank = 'preferred') OR (b = 1 AND rank = 'normal') GROUP BY 1, 2")
def kb_truthy(t):
    return kb.truthy(kb_statements(t)).groupBy("entity_id", "prop_id").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {UP}, {MEMBERS}, e AS (SELECT 'S' || s_suppkey AS entity_id FROM supplier WHERE s_nationkey = 3), s AS (SELECT class_id FROM am JOIN e USING (entity_id) GROUP BY class_id HAVING count(DISTINCT entity_id) = (SELECT count(*) FROM e)) SELECT class_id FROM s WHERE class_id NOT IN (SELECT ancestor FROM up JOIN s ON node = class_id WHERE node <> ancestor)")
def kb_most_specific(t):
    up = kb.closure(kb_edges(t))
    ents = kb_members(t).filter("class_id = 'N3'")
    return kb.most_specific(kb.shared_classes(kb_members(t), up, ents), up)


@query(f"WITH RECURSIVE {UP}, {MEMBERS}, {STATEMENTS}, n AS (SELECT class_id, count(DISTINCT entity_id) AS n FROM am GROUP BY 1 HAVING count(DISTINCT entity_id) BETWEEN 2 AND 60) SELECT class_id, n, string_agg(prop_id, ',' ORDER BY prop_id) AS props FROM (SELECT class_id, prop_id, n FROM am JOIN n USING (class_id) JOIN (SELECT DISTINCT entity_id, prop_id FROM statements) USING (entity_id) GROUP BY 1, 2, 3 HAVING count(DISTINCT entity_id) = n) GROUP BY 1, 2")
def kb_class_funnel(t):
    am = kb.class_members(kb_members(t), kb.closure(kb_edges(t)))
    classes = am.groupBy("class_id").agg(F.countDistinct("entity_id").alias("quantity"))
    return kb.class_funnel(classes, am, kb_statements(t), 60).select("class_id", "n", F.array_join("props", ",").alias("props"))


@query("""SELECT p_brand FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY p_brand HAVING count(DISTINCT n) = 1""")
def kb_one_quantity(t):
    return kb.one_quantity(t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")), "p_brand", "n").select("p_brand")


@query("""SELECT event_type AS type, count(DISTINCT user_id) AS n, event_type AS label FROM events GROUP BY 1 ORDER BY n DESC, type LIMIT 1""")
def kb_frequent_type(t):
    return kb.frequent_type(t.events.select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("type"), F.col("event_type").alias("label")))


@query("""SELECT event_type AS qualifier, CAST(user_id % 3 AS VARCHAR) AS "value", count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2""")
def kb_by_qualifier(t):
    e = t.events
    st = e.select(F.col("event_id").alias("stmt_id"), F.col("user_id").alias("entity_id"))
    q = e.select(F.col("event_id").alias("stmt_id"), F.col("event_type").alias("qualifier"), (F.col("user_id") % 3).cast("string").alias("value"))
    return kb.by_qualifier(st, q).select("qualifier", "value", F.size("entities").cast("long").alias("n"))


# ---- selection


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS c FROM part GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(c) OVER (PARTITION BY p_brand) AS n FROM c) SELECT p_brand, p_size, CAST(b AS BIGINT) AS n_below, round(b / n, 9) AS share FROM w WHERE b / n BETWEEN 0.3 AND 0.9 AND b > 0""")
def select_references(t):
    return selection.references(t.part, ["p_brand"], "p_size").withColumn("share", F.round("share", 9))


@query("""SELECT s_nationkey, list(s_acctbal ORDER BY s_acctbal)[CAST(least(count(*) - 1, floor(count(*) * 0.6)) AS BIGINT) + 1] AS v FROM supplier GROUP BY 1""")
def select_quantile(t):
    return t.supplier.groupBy("s_nationkey").agg(F.collect_list("s_acctbal").alias("a")).select("s_nationkey", selection.quantile_pick(F.col("a"), 0.6).alias("v"))


@query("""SELECT p_brand, CAST(floor(log2(count(*))) + 1 AS BIGINT) AS k FROM part GROUP BY 1""")
def select_budget(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", selection.property_budget(F.col("n")).cast("long").alias("k"))


@query("""SELECT p_type AS prop_id, count(DISTINCT p_brand) AS num_classes, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS class_ids FROM part GROUP BY 1""")
def select_property_stats(t):
    return selection.property_stats(t.part.select(F.col("p_type").alias("prop_id"), F.col("p_brand").alias("class_id"))).select("prop_id", "num_classes", F.array_join("class_ids", ",").alias("class_ids"))


@query()
def select_balanced(t):
    return selection.balanced(t.part.select(F.col("p_brand").alias("class_id"), F.col("p_type").alias("prop_id")), per_class=2)


@query()
def select_sample(t):
    return selection.sample(t.orders.select("o_orderkey"), "o_orderkey", n=100)


@query(f"""SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY abs(lat - 3) + abs(lon - 4), vec_id) AS r FROM {POINTS}) WHERE r = 1""")
def select_nearest(t):
    return selection.nearest(points(t).withColumn("entity_id", F.col("vec_id")), ["label"], F.lit(3.0), F.lit(4.0)).select("label", "vec_id")
