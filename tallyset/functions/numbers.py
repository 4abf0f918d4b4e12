"""Numbers in text, rounding and tolerance, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a signed number with optional thousands commas and decimals, anywhere in a text.
NUMBER = r"[-+]?(?:\d+(?:,\d{3})*(?:\.\d+)?|\d*\.\d+)"
#: Fixed value: the tolerances, in per cent, that answers are scored at.
TOLERANCES = (1.0, 5.0, 10.0, 20.0, 50.0, 90.0)


def first_number(text: Column) -> Column:
    """The first number of a text, a leading hyphen taken as a sign; null without one."""
    found = F.regexp_extract(text, f"({NUMBER})", 1)
    return F.when(found != "", F.regexp_replace(found, ",", "").try_cast("double"))


def tidy(value: Column) -> Column:
    """A whole number without decimals, any other rounded to two."""
    return F.when(value == F.floor(value), value.cast("double")).otherwise(F.round(value, 2))


def plain(value: Column) -> Column:
    """A number as text: without decimals if whole."""
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))


def clean_prediction(text: Column) -> Column:
    """The first number of a prediction as text, else the prediction without outer white space."""
    n = first_number(text)
    return F.when(n.isNotNull(), plain(n)).otherwise(F.trim(text))


def clean_gold(value: Column) -> Column:
    """A gold answer with two decimals; null stays null."""
    return F.when(value.isNotNull(), F.format_string("%.2f", value.cast("double")))


def coerce(text: Column) -> Column:
    """A number, or null for the empty or any other text."""
    return F.trim(text.cast("string")).try_cast("double")


def locale_number(text: Column) -> Column:
    """A number in European (1.234,56) or American (1,234.56) style. One comma and no dot is a decimal comma; several
    commas without a dot mean nothing. Signs, per cent signs and spaces around it are allowed."""
    t = F.regexp_replace(text, r"[%\s]", "")
    commas, dots = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))), F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    european = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    american = F.replace(t, F.lit(","), F.lit(""))
    both = F.when(F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), "."), european).otherwise(american)
    chosen = F.when((commas > 0) & (dots > 0), both).when(commas == 1, F.replace(t, F.lit(","), F.lit("."))).when(commas > 1, F.lit(None).cast("string")).otherwise(t)
    return F.when(chosen.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), chosen.try_cast("double"))


def rounded(value: Column, digits: int = 3) -> Column:
    """Rounded half up on the decimal rendering; NaN becomes null."""
    return F.when(~F.isnan(value), F.round(value, digits))


@F.pandas_udf(T.DoubleType())
def rounded_binary(value: pd.Series) -> pd.Series:
    """Rounded on the binary value, to three decimals, for answers that have to agree with such a source."""
    return value.map(lambda x: None if pd.isna(x) else round(float(x), 3))


def exact_match(gold: Column, prediction: Column, digits: int = 3) -> Column:
    """Whether both are numbers and equal once rounded; false if either is missing."""
    return F.coalesce(rounded(gold, digits) == rounded(prediction, digits), F.lit(False))


def soft_match(gold: Column, prediction: Column, percent: float, digits: int = 3) -> Column:
    """Whether the rounded error is at most percent of the rounded gold; a gold of 0 has to be met."""
    g, p = rounded(gold, digits), rounded(prediction, digits)
    return F.coalesce(F.when(g == 0, F.abs(p - g) == 0).otherwise(F.abs(p - g) <= F.abs(g) * (percent / 100.0)), F.lit(False))


def soft_matches(gold: Column, prediction: Column, percents: Sequence[float] = TOLERANCES) -> Column:
    """A map from tolerance to match."""
    return F.create_map(*[x for p in percents for x in (F.lit(float(p)), soft_match(gold, prediction, p))])


def soft_at(matches: Column, percent: float) -> Column:
    """The match at a tolerance of a map whose keys are texts: 5.0, 5 and 5.00 are one key."""
    keys = [f"{percent:.1f}", f"{percent:g}", f"{percent:.2f}"]
    return F.coalesce(*[F.try_element_at(matches, F.lit(k)) for k in keys])
