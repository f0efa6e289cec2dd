"""Nested JSON dictionaries as flat tables.

A dictionary is one JSON text a file or, with ``lines``, one a line: its members may
then be spread over any number of lines and files, which Spark reads in splits.
"""

from pyspark.sql import DataFrame, functions as F

from mandigrid.schema import CENSUS, LOCATION_TREE, MARKET_LOCATION, SELECTION


def _trees(spark, path, schema, lines):
    text = spark.read.text(path, wholetext=not lines)
    return text.select(F.from_json("value", schema).alias("tree"))


def read_locations(spark, path, lines=False) -> DataFrame:
    """{state: {district: [taluk]}} as (state, district, taluk); taluk may be NULL."""
    states = _trees(spark, path, LOCATION_TREE, lines).select(
        F.explode("tree").alias("state", "districts"))
    districts = states.select("state", F.explode("districts").alias("district", "taluks"))
    return districts.select("state", "district", F.explode_outer("taluks").alias("taluk"))


def read_market_locations(spark, path, lines=False) -> DataFrame:
    """{"State_Market": {...}} as one row per market."""
    entry = "map<string, struct<Market_Cleaned:string, Market:string, State:string," \
            " District:string, Taluk:string>>"
    rows = _trees(spark, path, entry, lines).select(
        F.explode("tree").alias("location_key", "at"))
    out = rows.select(
        "location_key", F.col("at.Market_Cleaned").alias("market_cleaned"),
        F.col("at.Market").alias("market"), F.col("at.State").alias("state"),
        F.col("at.District").alias("district"), F.col("at.Taluk").alias("taluk"))
    return out.select(*MARKET_LOCATION.fieldNames())


def read_selection(spark, path, lines=False) -> DataFrame:
    """{category: [commodity]} as (category, commodity)."""
    return _trees(spark, path, SELECTION, lines).select(
        F.explode("tree").alias("category", "commodities")
    ).select("category", F.explode("commodities").alias("commodity"))


def read_corrections(spark, path, lines=False) -> DataFrame:
    """{scope: {wrong: right}} as (scope, wrong, right)."""
    return _trees(spark, path, "map<string, map<string, string>>", lines).select(
        F.explode("tree").alias("scope", "table")
    ).select("scope", F.explode("table").alias("wrong", "right"))


def read_census(spark, path, level="Districts", lines=False) -> DataFrame:
    """{level: {unit: {rural|urban|total: {...}, state}}} as one row per unit and kind."""
    measures = CENSUS.fieldNames()[5:]
    kind = "struct<area:double, population:struct<{}>>".format(
        ", ".join(f"{m}:double" for m in measures))
    unit = f"struct<rural:{kind}, urban:{kind}, total:{kind}, state:string>"
    tree = _trees(spark, path, f"struct<{level}:map<string, {unit}>>", lines)
    units = tree.select(F.explode(f"tree.{level}").alias("name", "u"))
    kinds = units.select(
        F.lit(level).alias("level"), "name", F.col("u.state").alias("state"),
        F.explode(F.create_map(F.lit("Rural"), F.col("u.rural"), F.lit("Urban"), F.col("u.urban"),
                               F.lit("Total"), F.col("u.total"))).alias("tru", "k"))
    return kinds.filter(F.col("k").isNotNull()).select(
        "level", "name", "state", "tru", F.col("k.area").alias("area"),
        *[F.col(f"k.population.{m}").alias(m) for m in measures])
