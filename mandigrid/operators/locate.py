"""Placing markets: location lookup, pin codes, coordinates."""

from pyspark.sql import DataFrame, functions as F

from mandigrid.fixed_values import MARKET_KEY_ALIASES
from mandigrid.functions.keys import location_key
from mandigrid.functions.missing import col
from mandigrid.functions.similarity import ngram_similarity


def add_location(obs: DataFrame, locations: DataFrame) -> DataFrame:
    """District and taluk of each row's market; rows without a match are kept.

    The key ``State_Market`` is looked up as it is, then without what stands in
    brackets, then by alias. All spellings of a key are resolved once per distinct
    market, so the bulletin rows themselves are joined a single time.
    """
    known = locations.select(F.col("location_key").alias("_k"), F.col("district").alias("_d"),
                             F.col("taluk").alias("_t"))
    key, bare = _lookup_keys()
    markets = obs.select("state", "market").distinct()
    tries = markets.select("state", "market", F.posexplode(F.array(key, bare)).alias("_p", "_k"))
    placed = tries.join(known, "_k").groupBy("state", "market").agg(
        F.min(F.struct("_p", "_d", "_t")).alias("_r")
    ).select("state", "market", F.col("_r._d").alias("district"), F.col("_r._t").alias("taluk"))
    return obs.drop("district", "taluk").join(placed, ["state", "market"], "left")


def _lookup_keys():
    """The key as written, and the one to try when that is unknown."""
    key = location_key("state", "market")
    bare = F.regexp_replace(key, r"(\(.*\))", "")
    for part, alias in MARKET_KEY_ALIASES.items():
        bare = F.when(F.contains(key, F.lit(part)), F.lit(alias)).otherwise(bare)
    return key, bare


def add_location_rowwise(obs: DataFrame, locations: DataFrame) -> DataFrame:
    """``add_location`` for streams, which cannot be reduced to distinct markets first."""
    out = obs.drop("district", "taluk").withColumns(dict(zip(("_k0", "_k1"), _lookup_keys())))
    one = locations.groupBy("location_key").agg(F.min(F.struct("district", "taluk")).alias("_r"))
    for i in (0, 1):
        known = one.select(*[F.col(f"_r.{c}").alias(f"_{c[0]}{i}") for c in ("district", "taluk")],
                           F.col("location_key").alias(f"_k{i}"))
        out = out.join(known, f"_k{i}", "left")
    known = F.col("_d0").isNotNull() | F.col("_t0").isNotNull()
    return out.withColumns({
        c: F.when(known, F.col(f"_{c[0]}0")).otherwise(F.col(f"_{c[0]}1")) for c in ("district", "taluk")
    }).drop("_k0", "_k1", "_d0", "_d1", "_t0", "_t1")


def location_score(district, taluk, pin_district, pin_taluk):
    """How well a postal entry fits what an address says.

    Similarity of districts plus that of taluks; two absent taluks count as equal.
    """
    taluk, pin_taluk = col(taluk), col(pin_taluk)
    of_taluk = (F.when(F.length(taluk) > 0,
                       ngram_similarity(taluk, F.coalesce(pin_taluk, F.lit(""))))
                .when(F.length(F.coalesce(pin_taluk, F.lit(""))) == 0, 1.0).otherwise(0.0))
    of_district = F.when(F.length(col(district)) > 0,
                         ngram_similarity(district, pin_district)).otherwise(0.0)
    return of_district + of_taluk


def best_by_pin(markets: DataFrame, postal: DataFrame, key) -> DataFrame:
    """The postal entry of each market's pin that fits best, by key.

    Markets without a pin, or with an unknown one, are not in the result. Each
    distinct (pin, district, taluk) is scored once, so a pin that very many
    addresses share costs no more than the places it stands for.
    """
    said = ["pin", "district", "taluk"]
    entries = postal.select("pin", F.col("district").alias("pin_district"),
                            F.col("taluk").alias("pin_taluk")).distinct()
    wanted = markets.filter(F.col("pin").isNotNull()).select(
        key, "pin", *[F.coalesce(c, F.lit("")).alias(c) for c in said[1:]])
    scored = wanted.select(*said).distinct().join(entries, "pin").withColumn(
        "score", location_score("district", "taluk", "pin_district", "pin_taluk"))
    best = F.min(F.struct((-F.col("score")).alias("s"), "pin_district", "pin_taluk")).alias("_r")
    return wanted.join(scored.groupBy(*said).agg(best), said).select(
        key, F.col("_r.pin_district").alias("pin_district"),
        F.nullif(F.col("_r.pin_taluk"), F.lit("")).alias("pin_taluk"),
        (-F.col("_r.s")).alias("score"))


def unique_taluks(postal: DataFrame) -> DataFrame:
    """Taluks that lie in exactly one district."""
    return postal.filter((F.length("taluk") > 0) & (F.length("district") > 0)).groupBy(
        "taluk").agg(F.count_distinct("district").alias("n"),
                     F.min("district").alias("only_district")
                     ).filter("n = 1").drop("n")


def district_from_taluk(markets: DataFrame, postal: DataFrame) -> DataFrame:
    """Unknown districts filled in where the taluk has only one."""
    joined = markets.join(unique_taluks(postal), "taluk", "left")
    return joined.withColumn("district", F.coalesce("district", "only_district")).select(
        *markets.columns)


def add_coordinates(markets: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Latitude and longitude by state and cleaned name; the first entry counts."""
    first = coordinates.groupBy("state", F.col("market").alias("market_cleaned")).agg(
        F.min(F.struct("lat", "lng")).alias("coordinates"))
    return markets.join(first, ["state", "market_cleaned"], "left")


def assignment_rate(df: DataFrame, columns=("district", "taluk"), by=()) -> DataFrame:
    """Share of rows with a value, per column."""
    shares = [F.try_divide(F.count(c), F.count(F.lit(1))).alias(f"{c}_rate") for c in columns]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *shares)


def unassigned(df: DataFrame) -> DataFrame:
    return df.filter(F.col("district").isNull())
