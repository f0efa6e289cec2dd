"""What each unit trades: record counts, varieties and nested catalogues."""

from pyspark.sql import DataFrame, functions as F

from mandigrid.functions.text import strip
from mandigrid.operators.rollup import LEVEL_KEYS, rollup_level
from mandigrid.session import materialise

_COMMODITY = ["category", "commodity"]


def unit_records(rollup_rows: DataFrame, level) -> DataFrame:
    """Per unit and commodity: rows of its own series, and rows below them."""
    return rollup_rows.groupBy(*LEVEL_KEYS[level], *_COMMODITY).agg(
        F.count(F.lit(1)).alias("records_coverage"),
        F.sum("contrib").alias("records_total"),
    )


def market_records(obs: DataFrame) -> DataFrame:
    """Varieties and row count per market and commodity, from bulletin rows."""
    counts = obs.groupBy(*LEVEL_KEYS["market"], *_COMMODITY, "variety").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*LEVEL_KEYS["market"], *_COMMODITY).agg(
        F.sort_array(F.collect_set("variety")).alias("varieties"),
        F.sum("n").alias("records"),
    )


def market_commodities(market_rows: DataFrame) -> DataFrame:
    """Varieties and row count per market and commodity, from market roll-ups."""
    keys = [*LEVEL_KEYS["market"], *_COMMODITY]
    counts = market_rows.groupBy(*keys, "varieties").agg(F.count(F.lit(1)).alias("n"))
    exploded = counts.select(*keys, "n", F.posexplode_outer("varieties").alias("at", "variety"))
    return exploded.groupBy(*keys).agg(
        F.sort_array(F.collect_set("variety")).alias("varieties"),
        F.sum(F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, F.col("n"))).alias("records"),
    )


def unit_varieties(market_rows: DataFrame, level) -> DataFrame:
    """Union of the variety arrays per unit and commodity.

    Arrays are taken apart before grouping: names already seen are dropped
    map-side, so a unit's rows are never collected into one list.
    """
    keys = [*LEVEL_KEYS[level], *_COMMODITY]
    names = market_rows.select(*keys, F.explode("varieties").alias("variety")).distinct()
    return names.groupBy(*keys).agg(
        F.sort_array(F.collect_list("variety")).alias("varieties"))


def attach_varieties(records: DataFrame, varieties: DataFrame, level) -> DataFrame:
    return records.join(varieties, [*LEVEL_KEYS[level], *_COMMODITY], "left")


def distinct_units(df: DataFrame, level="district") -> DataFrame:
    return df.select(*LEVEL_KEYS[level]).distinct()


def catalogue(level, market_rows: DataFrame, rollup_rows: DataFrame = None) -> DataFrame:
    """One row per unit with the array ``commodities`` of what it trades."""
    if level == "market":
        entries = market_commodities(market_rows)
        fields = ["category", "commodity", "records", "varieties"]
    else:
        entries = attach_varieties(unit_records(rollup_rows, level),
                                   unit_varieties(market_rows, level), level)
        fields = ["category", "commodity", "records_coverage", "records_total", "varieties"]
    return entries.groupBy(*LEVEL_KEYS[level]).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("commodities"))


def unit_catalogue(level, market_rows: DataFrame, stored=False) -> DataFrame:
    """``catalogue`` of a level from market rows alone.

    They are made and written once; the level's series and the units' varieties both come
    from what is stored. With ``stored`` they are read from a table already.
    """
    if level == "market":
        return catalogue(level, market_rows)
    rows = market_rows if stored else materialise(market_rows, "market-rows")
    return catalogue(level, rows, rollup_level(rows, level))


_FIELDS = ["grade", "variety", "state", "market", "category"]


def dictionary_entries(obs: DataFrame) -> DataFrame:
    """Every spelling that occurs with a commodity: (commodity, field, value) rows."""
    fields = [c for c in _FIELDS if c in obs.columns]
    seen = obs.select(strip("commodity").alias("commodity"),
                      *[F.nullif(strip(c), F.lit("")).alias(c) for c in fields]).distinct()
    return seen.unpivot(["commodity"], fields, "field", "value").filter(
        F.col("value").isNotNull()).distinct()


_PLURAL = {"category": "categories", "variety": "varieties"}


def commodity_dictionary(obs: DataFrame, fields=("grade", "variety", "state", "category")
                         ) -> DataFrame:
    """One row per commodity with a sorted array per field.

    Markets are not among the default fields: there can be very many of them, and
    ``dictionary_entries`` lists them as rows.
    """
    entries = dictionary_entries(obs)
    fields = [f for f in fields if f in obs.columns]
    return entries.filter(F.col("field").isin(*fields)).groupBy("commodity").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("field") == f, F.col("value"))))
        .alias(_PLURAL.get(f, f + "s")) for f in fields])


def commodities_by(obs: DataFrame, key) -> DataFrame:
    """key (category or market) -> its commodities, sorted."""
    pairs = obs.select(key, F.nullif(strip("commodity"), F.lit("")).alias("commodity")).distinct()
    return pairs.groupBy(key).agg(
        F.sort_array(F.collect_list("commodity")).alias("commodities"))


def without_other(dictionary: DataFrame, word="Other") -> DataFrame:
    return dictionary.filter(~F.array_contains("categories", word))


def country_catalogue(obs: DataFrame, selection: DataFrame = None) -> DataFrame:
    """Categories in order, each with its (selected) commodities."""
    if selection is not None:
        obs = obs.join(selection, _COMMODITY, "left_semi")
    return commodities_by(obs, "category").orderBy("category")


def value_counts(df: DataFrame, *columns) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
