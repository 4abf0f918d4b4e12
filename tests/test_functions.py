"""Edge semantics of the scalar functions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyset.functions import geo, numbers, strings, times, units


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_first_number(spark):
    got = column(spark, ["8269 km", "1,234.5 units", "COVID-19", ".5", "", None, "none", "+7"], "string", numbers.first_number)
    assert got == [8269.0, 1234.5, -19.0, 0.5, None, None, None, 7.0]


def test_locale_numbers(spark):
    got = column(spark, ["1.234,56", "1,234.56", "1,234", "1,234,567", "-3 %", "", None, "x", "1.5"], "string", numbers.locale_number)
    assert got == [1234.56, 1234.56, 1.234, None, -3.0, None, None, None, 1.5]


@pytest.mark.parametrize(("gold", "prediction", "exact", "soft"), [(0.0, 0.0, True, True), (0.0, 0.1, False, False), (-100.0, -105.0, False, True), (100.0, 105.0, False, True), (100.0, 105.1, False, False), (None, 1.0, False, False), (1.0, None, False, False), (1.00049, 1.0, True, True)])
def test_tolerance(spark, gold, prediction, exact, soft):
    rows = spark.createDataFrame([(gold, prediction)], "g double, p double")
    r = rows.select(numbers.exact_match(F.col("g"), F.col("p")).alias("e"), numbers.soft_match(F.col("g"), F.col("p"), 5.0).alias("s"), numbers.soft_matches(F.col("g"), F.col("p")).alias("m")).first()
    assert (r.e, r.s, r.m[5.0]) == (exact, soft, soft)


def test_rounding_on_the_binary_value(spark):
    assert column(spark, [1.0005, 2.0], "double", numbers.rounded_binary) == [round(1.0005, 3), 2.0]


def test_soft_keys(spark):
    rows = spark.createDataFrame([({"5.0": True},), ({"5": False},), ({},)], "m map<string,boolean>")
    assert [r[0] for r in rows.select(numbers.soft_at(F.col("m"), 5.0)).collect()] == [True, False, None]


def test_page_rules(spark):
    ids = ["a-0001", "a-b-0001", "a", "-0001", None]
    assert column(spark, ids, "string", strings.entity_id) == ["a", "a-b", "a", "", None]
    assert column(spark, ids, "string", strings.page_id) == ["a", "a-b", None, "", None]
    assert column(spark, ids, "string", strings.first_part) == ["a", "a", "a", "", None]


def test_tags_and_boxes(spark):
    texts = ["<answer>a\nb</answer><answer>c</answer>", "none", None, r"x \boxed{7} \boxed{8}"]
    assert column(spark, texts, "string", lambda c: strings.tagged(c, "answer")) == ["a\nb", None, None, None]
    assert column(spark, texts, "string", strings.boxed) == [None, None, None, "7"]


def test_generation_parts(spark):
    got = column(spark, ["[Query] how many? [Aggregation] SUM [Answer] 1,200", "[Query] q [Answer] 3"], "string", strings.generation)
    assert (got[0].query, got[0].aggregation, got[0].number, got[1]) == ("how many?", "SUM", 1200.0, None)


def test_query_field(spark):
    got = column(spark, ['{"query": "a"}', 'so:\n```json\n{"query": "b"}\n```', 'say {"query": "c"} now', "no"], "string", strings.query_field)
    assert got == ["a", "b", "c", None]


def test_judgements(spark):
    assert column(spark, ["yes-same", "I say NO-RELATED.", "?", None], "string", strings.judgement) == ["YES-SAME", "NO-RELATED", "NO-UNRELATED", "NO-UNRELATED"]


def test_titles(spark):
    assert column(spark, ["https://x.org/wiki/new%20york"], "string", strings.title_from_url) == ["New_york"]
    assert column(spark, ["a b\n== Head ==\nc"], "string", strings.collapsed) == ["a b c"]


def test_actions_and_lookup(spark):
    got = column(spark, ["Search[a b] then Finish[12]"], "string", strings.actions)[0]
    assert [(a.name, a.argument) for a in got] == [("Search", "a b"), ("Finish", "12")]
    assert column(spark, ["One two. Two three. Four."], "string", lambda c: strings.lookup(c, F.lit("TWO"))) == [["One two", "Two three"]]
    assert column(spark, ["Follow up: who?\nFollow up: when?\nSo the final answer is: 3"], "string", strings.follow_up)[0].question == "when?"


def test_places(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 180.0), (90.0, 0.0, -90.0, 0.0), (10.0, 179.0, 10.0, -179.0)], "a double, b double, c double, d double")
    km = [r[0] for r in rows.select(geo.haversine(*map(F.col, "abcd"))).collect()]
    assert km[0] == 0 and km[1] == pytest.approx(math.pi * 6371) and km[2] == pytest.approx(math.pi * 6371) and km[3] < 250
    with pytest.raises(ValueError):
        geo.toward("UP", *[F.lit(0.0)] * 4)


def test_time_points(spark):
    rows = spark.createDataFrame([("2021-01-01T00:00:00Z", None), ("2021-03-01", None), ("2021-03-05", 9), ("bad", None), ("2021-03-05", 7), (None, None)], "s string, p int")
    got = [r[0] and (r[0].at, r[0].precision) for r in rows.select(times.parsed(F.col("s"), F.col("p"))).collect()]
    assert got == [(dt.datetime(2021, 1, 1), "year"), (dt.datetime(2021, 3, 1), "month"), (dt.datetime(2021, 3, 5), "year"), None, None, None]


def test_interval_precision(spark):
    rows = spark.createDataFrame([("2020-01-01", "2021-12-31"), ("2020-02-01", "2020-02-29"), ("2020-02-01", "2020-02-01"), ("2020-02-02", "2020-03-01")], "a string, b string").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    assert [r[0] for r in rows.select(times.interval_precision(F.col("a"), F.col("b"))).collect()] == ["year", "month", "day", "day"]


def test_shared_time(spark):
    d = lambda s: dt.date.fromisoformat(s) if s else None
    rows = [
        ("touch", "e1", "s1", d("2000-01-01"), d("2005-06-01")), ("touch", "e2", "s2", d("2005-06-01"), d("2010-01-01")),
        ("free", "e1", "s1", None, None), ("free", "e2", "s2", None, None),
        ("some", "e1", "s1", d("2000-01-01"), None), ("some", "e2", "s2", None, None),
        ("open", "e1", "s1", None, d("2010-12-31")), ("open", "e2", "s2", d("2003-01-01"), None), ("open", "e2", "s3", d("1990-01-01"), d("1991-01-01")),
        ("apart", "e1", "s1", d("2000-01-01"), d("2001-01-01")), ("apart", "e2", "s2", d("2002-01-01"), d("2003-01-01")),
    ]
    got = {r.g: r for r in times.shared_time(spark.createDataFrame(rows, "g string, entity_id string, stmt_id string, start date, end date"), ["g"]).collect()}
    assert set(got) == {"touch", "free", "open"}
    assert (got["touch"].start, got["touch"].end, got["touch"].precision) == (d("2005-06-01"), d("2005-06-01"), "day")
    assert got["free"].start is None and got["free"].statements == ["s1", "s2"]
    assert (got["open"].start, got["open"].end, got["open"].precision, got["open"].statements) == (d("2003-01-01"), d("2010-12-31"), "year", ["s1", "s2"])


def test_units(spark):
    rows = spark.createDataFrame([(1.0, "Q3710", "Q11573"), (2.0, "Q1", "Q1"), (3.0, None, "Q11573"), (4.0, "Q199", "Q11573")], "v double, s string, d string")
    table = units.factor_table(spark, units.ITEM_FACTORS)
    assert sorted(r.v for r in units.converted(rows, table, "v", "s", "d").collect()) == [0.3048, 2.0, 3.0, 4.0]
    with pytest.raises(Exception, match="no factor"):
        units.converted(spark.createDataFrame([(1.0, "Q1", "Q2")], "v double, s string, d string"), table, "v", "s", "d").collect()
    mixed = spark.createDataFrame([("a", "Q4917"), ("a", "Q4916"), ("b", "Q199"), ("b", "Q199"), ("b", "Q5"), ("c", "Q7")], "g string, unit_id string")
    assert {r.g: r.common for r in units.common_unit(mixed, ["g"]).collect()} == {"a": None, "b": "Q5", "c": "Q7"}


def test_quantities_and_order_keys(spark):
    got = column(spark, ["1.5 Liters", "12 -oz", "60 frames per second", "9 blorps", "none"], "string", units.quantity)
    assert [q and (q.value, q.unit) for q in got] == [(1.5, "Liter"), (12.0, "Ounce"), (60.0, "Frames per Second"), (9.0, None), None]
    assert column(spark, [["small 9", "large 1"], ["none", "7 up"]], "array<string>", units.order_keys) == [{"small 9": 0.0, "large 1": 1.0}, {"none": 0.0, "7 up": 7.0}]
