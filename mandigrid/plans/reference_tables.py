"""Dimension tables: postal directory, markets, states, districts, census, boundaries."""

from pyspark.sql import DataFrame, functions as F

from mandigrid.fixed_values import (
    BOUNDARY_DISTRICT_PATTERNS, BOUNDARY_SKIPPED, BOUNDARY_SPLIT, BOUNDARY_STATE_ALIASES,
    BOUNDARY_WEST_BENGAL_PATTERNS, CENSUS_MEASURES, CENSUS_NAME_PATTERNS, POSTAL_DISTRICT_PATTERNS,
    POSTAL_STATE_PATTERNS, POSTAL_TALUK_PATTERNS, PROFILE_MARKET_PATTERNS, STATE_CORRECTIONS,
)
from mandigrid.functions.dates import established
from mandigrid.functions.keys import location_key
from mandigrid.functions.missing import marker_as_null, number
from mandigrid.functions.text import (
    find_pin, market_without_district, normalize_address, replace_patterns, replace_whole, squeeze,
    tidy_punctuation, title,
)
from mandigrid.operators import addresses, locate
from mandigrid.operators.matching import (
    alternate_candidates, assign_once, candidates,
)
from mandigrid.operators.relational import exclude_row, keep_last
from mandigrid.session import materialise


def clean_postal_directory(raw: DataFrame) -> DataFrame:
    """(pin, taluk, district, state), cleaned and distinct."""
    rows = raw.select("pin", "taluk", "district", "state").dropna(thresh=3).distinct()
    state = replace_patterns(title(F.trim("state")), POSTAL_STATE_PATTERNS)
    district = title(F.trim(replace_patterns("district", POSTAL_DISTRICT_PATTERNS)))
    taluk = F.trim(F.regexp_replace("taluk", r"^\*+|\*+$", ""))
    taluk = title(F.trim(replace_patterns(taluk, POSTAL_TALUK_PATTERNS)))
    return rows.select("pin", taluk.alias("taluk"), district.alias("district"),
                       state.alias("state")).distinct()


def locate_markets(markets: DataFrame, postal: DataFrame, key="market_id") -> DataFrame:
    """Market records with pin, district, taluk and cleaned name.

    The address decides; if its pin is in the postal directory, the entry that
    fits best overrides it; a taluk of one district only settles what is left.
    """
    raw = markets.withColumn("pin", find_pin("apmc_address"))
    columns = ["apmc_address", "secretary_address"]
    read = raw.withColumns({a: normalize_address(a, "state") for a in columns})
    placed = addresses.assign_districts(read, postal.select("state", "district"), columns)
    # what an address says of the taluk counts before what the secretary's does
    for i, market in ((0, F.col("market")), (1, F.lit(None).cast("string"))):
        said = placed.select(key, "state", "district", F.col(columns[i]).alias("address"),
                             F.col(f"told_{i}").alias("told"), market.alias("market"))
        found = addresses.find_taluks(said, postal).select(key, F.col("taluk").alias(f"taluk_{i}"))
        placed = placed.join(found, key, "left")
    placed = placed.withColumn("taluk", F.coalesce("taluk_0", "taluk_1")).drop(
        *[f"{c}_{i}" for c in ("told", "rule", "taluk") for i in (0, 1)])
    # the rules are costly, and their result is used three times below
    placed = materialise(placed, "addresses")
    by_pin = locate.best_by_pin(placed, postal, key)
    merged = placed.join(by_pin, key, "left").withColumns({
        "district": F.coalesce("pin_district", "district"),
        "taluk": F.coalesce("pin_taluk", "taluk"),
    }).drop("pin_district", "pin_taluk", "score")
    settled = locate.district_from_taluk(merged, postal)
    cleaned = F.trim(tidy_punctuation(market_without_district("market", "district")))
    return settled.withColumns({
        "market_cleaned": cleaned, "market": F.trim(tidy_punctuation("market"))})


def clean_market_records(raw: DataFrame, duplicate=None) -> DataFrame:
    rows = raw if duplicate is None else exclude_row(raw, duplicate)
    return rows.withColumns({
        "state": replace_whole("state", STATE_CORRECTIONS),
        "market": F.trim(replace_patterns("market", PROFILE_MARKET_PATTERNS)),
    })


def build_market_locations(raw: DataFrame, postal: DataFrame, key="market_id",
                           duplicate=None) -> DataFrame:
    """The lookup table ``State_Market`` -> place; the last record of a key counts."""
    placed = locate_markets(clean_market_records(raw, duplicate), postal, key)
    rows = placed.select(location_key("state", "market_cleaned").alias("location_key"),
                         "market_cleaned", "market", "state", "district", "taluk", key)
    return keep_last(rows, "location_key", key).drop(key)


def build_market_profiles(placed: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Nested market documents."""
    text = [f.name for f in placed.schema if f.dataType.simpleString() == "string"]
    rows = placed.withColumns({c: marker_as_null(c) for c in text})
    rows = locate.add_coordinates(rows, coordinates)

    def part(*names, **renamed):
        both = {**{n: n for n in names}, **renamed}
        return F.struct(*[F.col(source).alias(name) for name, source in both.items()])

    income, expenditure = number("income"), number("expenditure")
    return rows.select(
        F.col("market").alias("name"), "market", "state", "district", "taluk", "regulated",
        established("established").alias("established"),
        F.col("regulated_commodities").alias("num_commodities_regulated"),
        "cleaning_or_grading", F.col("cold_storage").alias("num_coldstorage"),
        part("pin", "apmc_address", apmc_secretary_address="secretary_address").alias("address"),
        part("incoming", "outgoing", "railway_dist").alias("transport"),
        part("market_fee", "commission", "sale_process", "payment_process").alias("business"),
        F.struct(income.alias("market_income"), expenditure.alias("market_expenditure"),
                 (income - expenditure).alias("profit"),
                 number("reserves").alias("apmc_reserves"),
                 number("liabilities").alias("apmc_liabilities")).alias("accounting"),
        "coordinates")


def staff_total(supervisory, admin):
    """Missing if either part is."""
    return number(marker_as_null(supervisory)) + number(marker_as_null(admin))


# --- census ----------------------------------------------------------------

def clean_census(raw: DataFrame) -> DataFrame:
    """Census rows of all states with clean names and our column names."""
    name = F.regexp_replace("name", "&", "and")
    name = title(F.regexp_replace(name, "PUDUCHERRY$", "Pondicherry"))
    for written, plain in (("And ", "and "), ("Of ", "of "), ("Nct ", "NCT ")):
        name = F.replace(name, F.lit(written), F.lit(plain))
    name = squeeze(replace_patterns(name, CENSUS_NAME_PATTERNS))
    state = title(F.regexp_replace("state", "&", "and"))
    for written, plain in (("And ", "and "), ("Of ", "of "), ("Nct ", "NCT ")):
        state = F.replace(state, F.lit(written), F.lit(plain))
    measures = [number(f"`{head}`" if head in raw.columns else c).alias(c)
                for head, c in CENSUS_MEASURES.items()]
    return raw.select("level", name.alias("name"), state.alias("state"), "tru",
                      number("area").alias("area"), *measures)


# --- administrative units --------------------------------------------------

def build_states(locations: DataFrame, census_states: DataFrame) -> DataFrame:
    """One row per state with its districts and census record (within two edits)."""
    states = locations.groupBy("state").agg(
        F.sort_array(F.collect_set("district")).alias("districts"))
    pairs = candidates(states, census_states, "state", "name", 2)
    chosen = assign_once(pairs).select(F.col("left_name").alias("state"),
                                       F.col("right_name").alias("census_name"))
    census = census_states.select(F.col("name").alias("census_name"),
                                  F.struct("rural", "urban", "total").alias("census"))
    return (states.join(chosen, "state", "left").join(census, "census_name", "left")
            .select(F.col("state").alias("name"), "state", "districts", "census"))


def build_districts(locations: DataFrame, census_districts: DataFrame) -> DataFrame:
    """One row per district with its census record: equal, containing or within 3 edits."""
    districts = locations.select("state", "district").distinct()
    pairs = candidates(districts, census_districts, "district", "name", 3, ["state"],
                       contains=True, fold=False)
    chosen = assign_once(pairs, ["state"]).select(
        "state", F.col("left_name").alias("district"), F.col("right_name").alias("census_name"))
    census = census_districts.select("state", F.col("name").alias("census_name"),
                                     F.struct("rural", "urban", "total").alias("census"))
    return (districts.join(chosen, ["state", "district"], "left")
            .join(census, ["state", "census_name"], "left")
            .select(F.col("district").alias("name"), "district", "state", "census"))


def match_state_boundaries(shapes: DataFrame, states: DataFrame) -> DataFrame:
    """Boundary name -> state name: within three edits, else by alternate spelling."""
    left = shapes.select(F.col("name_1").alias("name"), F.col("varname_1").alias("alternates"))
    pairs = alternate_candidates(left, states, "name", "alternates", "state", 3, 3)
    matched = assign_once(pairs).select(F.col("left_name").alias("name_1"),
                                        F.col("right_name").alias("state"))
    fixed = left.select(F.col("name").alias("name_1")).join(
        matched, "name_1", "left_anti").select(
        "name_1", replace_whole("name_1", BOUNDARY_STATE_ALIASES).alias("state")).filter(
        F.col("name_1").isin(*BOUNDARY_STATE_ALIASES))
    return matched.unionByName(fixed)


def boundary_district_name(name, state):
    plain = replace_patterns(name, BOUNDARY_DISTRICT_PATTERNS)
    return F.when(F.col(state) == "West Bengal",
                  replace_patterns(plain, BOUNDARY_WEST_BENGAL_PATTERNS)).otherwise(plain)


def match_district_boundaries(shapes: DataFrame, districts: DataFrame) -> DataFrame:
    """(state, name_2) -> district: equal, containing or two edits, else alternates (5)."""
    left = shapes.filter(~F.col("name_2").isin(*BOUNDARY_SKIPPED, *BOUNDARY_SPLIT)).select(
        "state", "name_2", boundary_district_name("name_2", "state").alias("name"),
        F.col("varname_2").alias("alternates"))
    pairs = alternate_candidates(left, districts, "name", "alternates", "district", 2, 5,
                                 ["state"], contains=True)
    matched = assign_once(pairs, ["state"]).select(
        "state", F.col("left_name").alias("name"), F.col("right_name").alias("district"))
    split = shapes.filter(F.col("name_2").isin(*BOUNDARY_SPLIT)).select(
        "state", "name_2", F.explode(F.array(*[
            F.lit(d) for ds in BOUNDARY_SPLIT.values() for d in ds])).alias("district"))
    return left.join(matched, ["state", "name"]).select("state", "name_2", "district").unionByName(
        split)


def boundary_features(shapes: DataFrame, names: DataFrame, level, on) -> DataFrame:
    """Shapes with rewritten properties; the geometry is passed through untouched."""
    joined = shapes.join(names, on, "inner")
    name = "state" if level == "State" else "district"
    fields = [F.lit(level).alias("level"), F.col(name).alias("name")]
    if level != "State":
        fields.append(F.col("state"))
    return joined.select("state", F.col(name).alias("id"), F.struct(*fields).alias("properties"),
                         "geometry")


def boundary_of(features: DataFrame, state) -> DataFrame:
    return features.filter(F.col("state") == state)
