"""Hierarchies, census tables, crop production, city prices and boundaries."""

from pyspark.sql import DataFrame, functions as F

from mandigrid.fixed_values import CENSUS_MEASURES
from mandigrid.functions.missing import number
from mandigrid.functions.text import city_name, is_summary_row, product_heading, title
from mandigrid.operators.timeseries import forward_fill
from mandigrid.session import materialise

MEASURES = list(CENSUS_MEASURES.values())


# --- hierarchy -------------------------------------------------------------

def places_by_pin(postal: DataFrame) -> DataFrame:
    """pin -> set of (state, district, taluk)"""
    return postal.groupBy("pin").agg(
        F.sort_array(F.collect_set(F.struct("state", "district", "taluk"))).alias("places"))


def taluks_of_districts(postal: DataFrame) -> DataFrame:
    """(state, district) -> set of taluks; districts without any have an empty set."""
    return postal.groupBy("state", "district").agg(
        F.sort_array(F.collect_set("taluk")).alias("taluks"))


def districts_of_taluks(postal: DataFrame) -> DataFrame:
    """(state, taluk) -> set of districts"""
    return postal.filter(F.col("taluk").isNotNull()).groupBy("state", "taluk").agg(
        F.sort_array(F.collect_set("district")).alias("districts"))


# --- census ----------------------------------------------------------------

def split_census(census: DataFrame, parent, new_unit, members) -> DataFrame:
    """A census table in which ``members`` form a unit of their own.

    The new unit is the sum of its districts, the parent loses that sum (entries
    that do not stay positive are dropped), states' total area becomes rural plus
    urban, and the districts change their state.
    """
    is_state, is_member = F.col("level") == "STATE", (
        (F.col("level") == "DISTRICT") & F.col("name").isin(*members))
    summed = census.filter(is_member).groupBy("tru").agg(
        *[F.sum(c).alias(c) for c in ("area", *MEASURES)])
    unit = summed.select(F.lit("STATE").alias("level"), F.lit(new_unit).alias("name"),
                         F.lit(new_unit).alias("state"), "tru", "area", *MEASURES)

    states = census.filter(is_state)
    parts = F.sum(F.when(F.col("tru").isin("Rural", "Urban"), F.col("area")))
    areas = states.groupBy("name").agg(parts.alias("_area"))
    states = states.join(areas, "name").withColumn(
        "area", F.when(F.col("tru") == "Total", F.col("_area")).otherwise(F.col("area")))
    lost = summed.select("tru", *[F.col(c).alias(f"_less_{c}") for c in ("area", *MEASURES)])
    states = states.join(lost, "tru", "left")
    is_parent = F.col("name") == parent

    def reduced(c):
        rest = F.col(c) - F.coalesce(F.col(f"_less_{c}"), F.lit(0.0))
        return F.when(is_parent, rest if c == "area" else F.when(rest > 0, rest)
                      ).otherwise(F.col(c)).alias(c)

    states = states.select("level", "name", "state", "tru", reduced("area"),
                           *[reduced(m) for m in MEASURES])
    others = census.filter(~is_state).withColumn(
        "state", F.when(is_member, F.lit(new_unit)).otherwise(F.col("state")))
    columns = ["level", "name", "state", "tru", "area", *MEASURES]
    return (states.select(columns).unionByName(unit.select(columns))
            .unionByName(others.select(columns)))


def census_by_unit(census: DataFrame, level) -> DataFrame:
    """One row per unit with area and measures of rural, urban and total."""
    keys = ["name", "state"] if level == "DISTRICT" else ["name"]
    rows = census.filter(F.col("level") == level)
    values = ["area", *MEASURES]
    wide = rows.groupBy(*keys).pivot("tru", ["Rural", "Urban", "Total"]).agg(
        *[F.first(v, ignorenulls=True).alias(v) for v in values])
    return wide.select(*keys, *[
        F.struct(F.col(f"{kind}_area").alias("area"),
                 F.struct(*[F.col(f"{kind}_{m}").alias(m) for m in MEASURES]).alias("population")
                 ).alias(kind.lower())
        for kind in ("Rural", "Urban", "Total")])


# --- crop production -------------------------------------------------------

def reshape_production(cells: DataFrame) -> DataFrame:
    """Extracted sheet rows to one row per state, crop, district, year and season.

    Keys are written once and stand for the rows below; rows with fewer than four
    values only name things; figures sit in one of two columns. The last row of
    all is a signature.
    """
    keys = ["state", "crop", "district", "year", "season", "area_ha"]
    figures = ["production_t", "production_split", "yield_t_ha", "yield_split"]
    titled = cells.withColumns({
        **{c: title(c) for c in ("state", "crop", "district")}, "season": F.trim("season")})
    named = titled.dropna(how="all", subset=[*keys, *figures])
    # filled once and written, as the last row is looked for before the rows are used
    filled = forward_fill(materialise(named, "sheets"), "sheet", "row_no", keys)
    kept = materialise(filled.dropna(thresh=4, subset=[*keys, *figures]), "production")
    last = kept.agg(F.max(F.struct("sheet", "row_no")).alias("_last"))  # one row
    kept = kept.join(last.select("_last.*"), ["sheet", "row_no"], "left_anti")

    def zero(c):
        return F.coalesce(F.col(c), F.lit(0.0))

    return kept.select(
        "sheet", "row_no", *keys[:-1], zero("area_ha").alias("area_ha"),
        (zero("production_split") + zero("production_t")).alias("production_t"),
        (zero("yield_split") + zero("yield_t_ha")).alias("yield_t_ha"))


# --- city prices -----------------------------------------------------------

def city_prices(wide: DataFrame, products, ids=("date", "zone", "city")) -> DataFrame:
    """Wide city tables to (date, zone, city, product, price); no summary rows."""
    rows = wide.filter(~is_summary_row("city")).select(
        *ids, *[F.col(f"`{p}`").cast("string").alias(p) for p in products])
    long = rows.unpivot(list(ids), [f"`{p}`" for p in products], "product", "price")
    return long.select(
        "date", F.initcap(F.lower("zone")).alias("zone"), city_name("city").alias("city"),
        product_heading("product").alias("product"), number("price").alias("price"))


# --- boundaries ------------------------------------------------------------

def bounding_centres(points: DataFrame, unit="name", point="p") -> DataFrame:
    """Centre of the bounding box of each unit's boundary points (lat, lng).

    Takes one row per point; ``boundary_points`` makes them from arrays.
    """
    return points.groupBy(unit).agg(*[
        ((F.min(f"{point}.{axis}") + F.max(f"{point}.{axis}")) / 2).alias(axis)
        for axis in ("lat", "lng")])


def boundary_points(boundaries: DataFrame, unit="name", points="points") -> DataFrame:
    return boundaries.select(unit, F.explode(points).alias("p"))
