"""Read queries of a dashboard, over a roll-up table with a ``level`` column."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from mandigrid.fixed_values import COUNTRY, DEFAULT_THRESHOLDS
from mandigrid.functions.keys import series_id
from mandigrid.operators import quality
from mandigrid.operators.relational import any_of

_FIELDS = ["date", "price", "tonnage", "contrib"]


def series(rollups: DataFrame, level, unit, commodity, state=None) -> DataFrame:
    """One unit's series by date. The filters prune the (level, commodity) partitions."""
    rows = rollups.filter((F.col("level") == level) & (F.col("commodity") == commodity)
                          & (F.col(level) == unit))
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    return rows.select(*_FIELDS, level).orderBy("date")


def series_bundle(rollups: DataFrame, states, districts=(), market=None, commodity=None
                  ) -> DataFrame:
    """The series of a comparison: states, districts of the first state, a market.

    A single scan: the units' conditions are joined by OR.
    """
    rows = rollups if commodity is None else rollups.filter(F.col("commodity") == commodity)
    level = F.col("level")
    wanted = (level == "state") & F.col("state").isin(*states)
    if districts:
        wanted = wanted | ((level == "district") & (F.col("state") == states[0])
                           & F.col("district").isin(*districts))
    if market is not None:
        wanted = wanted | ((level == "market") & (F.col("state") == states[0])
                           & (F.col("market") == market))
    unit = (F.when(level == "state", F.col("state")).when(level == "district", F.col("district"))
            .otherwise(F.col("market")))
    return rows.filter(wanted).select(
        series_id(level, unit, F.col("commodity")).alias("series_id"), "level",
        unit.alias("unit"), "commodity", *_FIELDS).orderBy("series_id", "date")


def compare(rollups, level, names, commodity, state=None) -> DataFrame:
    """Rows of several units of one level, by date."""
    rows = rollups.filter((F.col("level") == level) & (F.col("commodity") == commodity))
    equals = {} if state is None else {"state": state}
    return any_of(rows, level, names, **equals).orderBy("date")


def units_for_commodity(catalogue: DataFrame, commodity, state=None) -> DataFrame:
    """Units that trade a commodity, with that entry's figures."""
    rows = catalogue if state in (None, COUNTRY) else catalogue.filter(F.col("state") == state)
    entry = F.get(F.filter("commodities", lambda x: x["commodity"] == commodity), 0)
    units = [c for c in catalogue.columns if c != "commodities"]
    found = rows.withColumn("_e", entry).filter(F.col("_e").isNotNull())
    return found.select(*units, "_e.*")


def hierarchy_options(state_catalogue, district_catalogue, market_catalogue, level, state=None,
                      district=None, displayed: DataFrame = None) -> DataFrame:
    """What can be chosen at a level: the unit's parents, siblings and their commodities.

    ``displayed`` (level, unit, commodity) lists what is on screen already.
    """
    def options(catalogue, name, label, **equals):
        rows = catalogue.filter(F.col("commodities").isNotNull())
        for key, value in equals.items():
            rows = rows.filter(F.col(key) == value)
        return rows.select(
            F.lit(label).alias("level"), F.col(name).alias("unit"),
            F.explode(F.transform("commodities", lambda e: e["commodity"])).alias("commodity"))

    if level == "state":
        parts = [options(state_catalogue, "state", "state")]
    else:
        parts = [options(state_catalogue, "state", "state", state=state)]
        narrowed = {"state": state} if level == "district" else {
            "state": state, "district": district}
        parts.append(options(district_catalogue, "district", "district", **narrowed))
        if level == "market":
            parts.append(options(market_catalogue, "market", "market", **narrowed))
    out = reduce(DataFrame.unionByName, parts)
    if displayed is not None:
        out = out.join(displayed, ["level", "unit", "commodity"], "left_anti")
    return out


def variety_options(catalogue: DataFrame, unit_column, unit, commodity, displayed=()) -> DataFrame:
    """Varieties of one commodity of one unit that are not on screen yet."""
    entry = F.get(F.filter("commodities", lambda x: x["commodity"] == commodity), 0)
    names = catalogue.filter(F.col(unit_column) == unit).select(
        F.explode(entry["varieties"]).alias("variety"))
    return names.filter(~F.col("variety").isin(*displayed)) if displayed else names


def trade_map(rollups: DataFrame, level, commodity, start, end, state=None, centres=None
              ) -> DataFrame:
    """Traded tonnage per unit, largest first; units without a centre are left out."""
    rows = rollups.filter(F.col("level") == level)
    out = quality.tonnage_aggregate(rows, level, commodity, start, end, state)
    if centres is not None:
        out = out.join(centres, "name")
    return out.orderBy(F.desc("aggr_tonnage"), "name")


def quality_map(rollups: DataFrame, catalogue: DataFrame, level, commodity, start, end,
                thresholds=None, state=None) -> DataFrame:
    """Units to show: all that trade the commodity, or those within the thresholds."""
    thresholds = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
    if thresholds == DEFAULT_THRESHOLDS:
        return units_for_commodity(catalogue, commodity, state)
    return quality.unit_statistics(rollups.filter(F.col("level") == level), level, start, end,
                                   commodity, state, thresholds)


def states_without_country(states: DataFrame) -> DataFrame:
    return states.filter(F.col("name") != COUNTRY)
