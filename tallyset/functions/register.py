"""Names for SQL: functions of numbers and places as SQL functions, which the optimizer sees through, and word windows as a
table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .geo import EARTH_KM
from .numbers import NUMBER

SQL = {
    "first_number(s STRING) RETURNS DOUBLE": f"TRY_CAST(replace(nullif(regexp_extract(s, r'({NUMBER})', 1), ''), ',', '') AS DOUBLE)",
    "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": (
        f"2 * {EARTH_KM}D * asin(sqrt(least(1.0D, pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))))"
    ),
    "plain_number(s STRING) RETURNS DOUBLE": (
        "TRY_CAST(CASE WHEN instr(s, ',') > 0 AND instr(s, '.') > 0 THEN CASE WHEN instr(reverse(s), ',') < instr(reverse(s), '.') THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END "
        "WHEN length(s) - length(replace(s, ',', '')) = 1 THEN replace(s, ',', '.') WHEN instr(s, ',') > 0 THEN NULL ELSE s END AS DOUBLE)"
    ),
}


@udtf(returnType="chunk_idx int, contents string")
class WordWindows:
    """word_windows(text, width, least): windows of `width` words of a text; those of under `least` words take no number."""

    def eval(self, text: str, width: int, least: int) -> Iterator[tuple[int, str]]:
        words, n = (text or "").split(), 0
        for at in range(0, len(words), width):
            part = words[at : at + width]
            if len(part) >= least:
                yield n, " ".join(part)
                n += 1


def register(spark: SparkSession) -> None:
    """first_number, plain_number, haversine_km and word_windows for this session's SQL."""
    for head, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("word_windows", WordWindows)
