"""Units: tables of factors, conversion and the common unit of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Factors between units of the knowledge base (a value in the second unit is the factor times one in the first).
ITEM_FACTORS = {
    ("Q232291", "Q712226"): 2.58999, ("Q712226", "Q232291"): 0.38610,
    ("Q35852", "Q712226"): 0.01, ("Q712226", "Q35852"): 100.0,
    ("Q25343", "Q712226"): 1e-6, ("Q712226", "Q25343"): 1e6,
    ("Q712226", "Q81292"): 247.105381, ("Q81292", "Q712226"): 0.00404685642,
    ("Q3710", "Q11573"): 0.3048, ("Q11573", "Q3710"): 3.28084,
    ("Q2655272", "Q11570"): 1e18, ("Q11570", "Q2655272"): 1e-18,
    ("Q48013", "Q41803"): 28.349523125, ("Q41803", "Q48013"): 0.03527396195,
    ("Q199", "Q577"): 1.0, ("Q577", "Q199"): 1.0,
}
#: The unit "1", and units of currency.
ONE, CURRENCIES = "Q199", ("Q4917", "Q4916")
# Factors between retail units.
RETAIL_FACTORS = {
    ("Milliliter", "Liter"): 0.001, ("Liter", "Milliliter"): 1000.0, ("Liter", "Quart"): 1.05668821, ("Quart", "Liter"): 0.946352946,
    ("Liter", "Cup"): 4.22675284, ("Cup", "Liter"): 0.2365882365, ("Milliliter", "Quart"): 0.00105668821, ("Quart", "Milliliter"): 946.352946,
    ("Milliliter", "Cup"): 0.00422675284, ("Cup", "Milliliter"): 236.5882365, ("Quart", "Cup"): 4.0, ("Cup", "Quart"): 0.25,
    ("Gram", "Kilogram"): 0.001, ("Kilogram", "Gram"): 1000.0, ("Gram", "Ounce"): 0.0352739619, ("Ounce", "Gram"): 28.349523125,
    ("Gram", "Pound"): 0.00220462262, ("Pound", "Gram"): 453.59237, ("Kilogram", "Ounce"): 35.2739619, ("Ounce", "Kilogram"): 0.028349523125,
    ("Kilogram", "Pound"): 2.20462262, ("Pound", "Kilogram"): 0.45359237, ("Ounce", "Pound"): 0.0625, ("Pound", "Ounce"): 16.0,
    ("Megabyte", "Gigabyte"): 1 / 1024, ("Gigabyte", "Megabyte"): 1024.0, ("Gigabyte", "Terabyte"): 1 / 1024, ("Terabyte", "Gigabyte"): 1024.0,
    ("Megabyte", "Terabyte"): 1 / 1024**2, ("Terabyte", "Megabyte"): 1024.0**2, ("Hour", "Day"): 1 / 24, ("Day", "Hour"): 24.0,
    ("Pod", "Pod"): 1.0, ("K-Cup", "K-Cup"): 1.0, ("Pod", "K-Cup"): 1.0, ("K-Cup", "Pod"): 1.0,
}
# The canonical name of each name of a retail unit.
RETAIL_NAMES = {
    "ml": "Milliliter", "l": "Liter", "liter": "Liter", "liters": "Liter", "litr": "Liter", "cup": "Cup", "cups": "Cup", "qt": "Quart",
    "quart": "Quart", "gallons/cycle": "Gallon per Cycle", "kg": "Kilogram", "g": "Gram", "lb": "Pound", "lbs": "Pound", "oz": "Ounce",
    "inch": "Inch", "mm": "Millimeter", "m": "Meter", "degrees": "Degree", "hour": "Hour", "hours": "Hour", "days": "Day", "months": "Month",
    "year": "Year", "years": "Year", "min": "Minute", "ms": "Millisecond", "hz": "Hertz", "fps": "Frames per Second",
    "frames per second": "Frames per Second", "rpm": "Revolutions per Minute", "ghz": "Gigahertz", "mb": "Megabyte", "gb": "Gigabyte",
    "tb": "Terabyte", "w": "Watt", "v": "Volt", "nits": "Nit", "db": "Decibel", "dba": "Decibel A-weighted", "mp": "Megapixel", "p": "Pixel",
    "x": "Optical Zoom Factor", "x optical zoom": "Optical Zoom Factor", "piece": "Piece", "pods": "Pod", "k-cups": "K-Cup", "seeds": "Seed",
    "star": "Star", "th gen": "Generation", "$": "US Dollar",
}


def factor_table(spark: SparkSession, factors: dict[tuple[str, str], float]) -> DataFrame:
    """(src, dst, factor), a few dozen rows."""
    return spark.createDataFrame([(a, b, float(f)) for (a, b), f in factors.items()], "src string, dst string, factor double")


def canonical(unit: Column) -> Column:
    """The canonical name of a retail unit; null if unknown."""
    return F.create_map(*[F.lit(x) for pair in RETAIL_NAMES.items() for x in pair])[unit]


def quantity(text: Column) -> Column:
    """(value, unit) of a retail quantity: the first unsigned number, and the rest as a canonical unit."""
    number = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1)
    rest = F.regexp_replace(F.lower(text), r"\d+(?:\.\d+)?", "")
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, ",", ""), r"^[\s-]+", ""), r"\s+", " "))
    return F.when(number != "", F.struct(number.cast("double").alias("value"), canonical(rest).alias("unit")))


def order_keys(values: Column) -> Column:
    """The order of a list of texts, as a map: list position if each holds a digit, else the first number or 0."""
    every = F.forall(values, lambda v: v.rlike("[0-9]"))
    number = lambda v: F.coalesce(F.regexp_extract(v, r"(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
    return F.map_from_entries(F.transform(values, lambda v, i: F.struct(v.alias("key"), F.when(every, i.cast("double")).otherwise(number(v)).alias("value"))))


def converted(rows: DataFrame, factors: DataFrame, value: str, src: str, dst: str, one: str | None = ONE) -> DataFrame:
    """rows with value in the unit dst. Equal, missing or unit-less sides keep the value; a pair without a factor fails."""
    f = F.broadcast(factors.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("factor").alias("__f")))  # a fixed table
    same = F.col(src).eqNullSafe(F.col(dst)) | F.col(src).isNull() | F.col(dst).isNull()
    if one is not None:
        same = same | (F.col(src) == one) | (F.col(dst) == one)
    out = rows.join(f, (F.col(src) == F.col("__s")) & (F.col(dst) == F.col("__d")), "left")
    fail = F.raise_error(F.concat(F.lit("no factor from "), F.col(src), F.lit(" to "), F.col(dst)))
    return out.withColumn(value, F.when(same, F.col(value)).otherwise(F.coalesce(F.col(value) * F.col("__f"), F.when(F.col("__f").isNull(), fail).cast("double")))).drop("__s", "__d", "__f")


def common_unit(rows: DataFrame, group: list[str], unit: str = "unit_id", one: str = ONE, currencies: tuple[str, ...] = CURRENCIES) -> DataFrame:
    """(group, common): the unit that most rows of a group have, another than `one` if there is any; null if currencies
    are mixed. Ties go to the least unit."""
    counts = rows.groupBy(*group, F.col(unit).alias("__u")).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*group).orderBy(F.desc("__n"), "__u")
    ranked = counts.withColumn("__r", F.row_number().over(order)).withColumn("__kinds", F.count("*").over(Window.partitionBy(*group)))
    two = ranked.filter("__r <= 2").groupBy(*group).agg(F.max(F.when(F.col("__r") == 1, F.col("__u"))).alias("a"), F.max(F.when(F.col("__r") == 2, F.col("__u"))).alias("b"), F.max("__kinds").alias("kinds"))
    chosen = F.when((F.col("a") == one) & (F.col("kinds") > 1), F.col("b")).otherwise(F.col("a"))
    return two.select(*group, F.when(~(chosen.isin(*currencies) & (F.col("kinds") > 1)), chosen).alias("common"))
