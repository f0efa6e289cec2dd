"""Price and tonnage roll-ups: variety -> market -> district -> state -> country.

Prices of units are weighted by tonnage. Each level is computed from the partial
sums of the level below, so only market rows are ever shuffled at full size.

A commodity has one category and a market one taluk. Both are grouping keys here
and not text aggregates, so that these steps run as hash aggregates on numbers.
"""

from pyspark.sql import DataFrame, functions as F

from mandigrid.functions.missing import has_tonnage

LEVEL_KEYS = {
    "market": ["state", "district", "market"],
    "district": ["state", "district"],
    "state": ["state"],
    "india": [],
}
_MARKET = ["date", "state", "district", "market", "commodity", "taluk", "category"]
# the keys of a market's day that are never constant
_DEALT = ["date", "state", "district", "market", "commodity"]


def rollup_varieties(obs: DataFrame, mode="mean") -> DataFrame:
    """One row per date, market and commodity.

    ``mean``: price is the plain mean of the varieties' prices. ``weighted``: it is
    the sum of price times variety tonnage over the commodity's tonnage.

    The first step aggregates by variety on fixed-width buffers; only its result
    reaches the step that gathers the variety names. Rows are dealt by market first, so both
    steps share one shuffle: by variety there is little to add up before it.
    """
    obs = _with(obs, taluk=None).repartition(*_DEALT)
    by_variety = obs.groupBy(*_MARKET, "variety").agg(
        F.sum("modal_price").alias("p_sum"),
        F.count("modal_price").alias("p_n"),
        F.max("tonnage").alias("tonnage"),
        *([F.sum(F.col("modal_price") * F.col("variety_tonnage")).alias("pt_sum")]
          if mode == "weighted" else []),
    )
    price = (F.try_divide(F.sum("p_sum"), F.sum("p_n")) if mode == "mean"
             else F.try_divide(F.sum("pt_sum"), F.max("tonnage")))
    return by_variety.groupBy(*_MARKET).agg(
        price.alias("price"),
        F.max("tonnage").alias("tonnage"),
        F.sort_array(F.collect_set("variety")).alias("varieties"),
    )


def market_partials(obs: DataFrame) -> DataFrame:
    """Sums, counts and the tonnage of each market's day: parts that can be merged."""
    return _with(obs, taluk=None).groupBy(*_MARKET).agg(
        F.sum("modal_price").alias("p_sum"), F.count("modal_price").alias("p_n"),
        F.max("tonnage").alias("tonnage"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """The market rows that all partials together stand for (``mean`` prices)."""
    return partials.groupBy(*_MARKET).agg(
        F.try_divide(F.sum("p_sum"), F.sum("p_n")).alias("price"), F.max("tonnage").alias("tonnage"))


def add_partials(partials: DataFrame) -> DataFrame:
    """Partials of the same market's day put together into one."""
    return partials.groupBy(*_MARKET).agg(
        F.sum("p_sum").alias("p_sum"), F.sum("p_n").alias("p_n"), F.max("tonnage").alias("tonnage"))


def _with(df, **defaults):
    missing = {c: F.lit(v).cast("string") for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def district_partials(market_rows: DataFrame) -> DataFrame:
    """Sums that every higher level can be built from, at district grain."""
    priced = F.col("price").isNotNull()
    return market_rows.filter(has_tonnage("tonnage")).groupBy(
        "date", "state", "district", "commodity", "category"
    ).agg(
        F.sum(F.col("price") * F.col("tonnage")).alias("value"),
        F.sum(F.when(priced, F.col("tonnage"))).alias("priced_tonnage"),
        F.sum("tonnage").alias("tonnage"),
        F.count(F.lit(1)).alias("contrib"),
    )


def _price(missing_price):
    if missing_price == "exclude":
        return F.try_divide(F.sum("value"), F.sum("priced_tonnage"))
    if missing_price == "dilute":
        return F.try_divide(F.coalesce(F.sum("value"), F.lit(0.0)), F.sum("tonnage"))
    raise ValueError(f"missing_price must be 'exclude' or 'dilute', not {missing_price!r}")


def _measures(missing_price):
    return [
        _price(missing_price).alias("price"),
        F.sum("tonnage").alias("tonnage"),
        F.sum("contrib").alias("contrib"),
    ]


def rollup_level(market_rows: DataFrame, level, missing_price="exclude") -> DataFrame:
    """Tonnage-weighted roll-up of market rows to one level.

    Rows without tonnage do not count. With ``exclude`` a row without a price
    counts for tonnage only; with ``dilute`` its tonnage lowers the price. The
    states and districts behind a row come as arrays (there are a few hundred of
    them); the markets behind it come from ``contributors``, one row each.
    """
    names = []
    if level in ("state", "india"):
        names.append(F.sort_array(F.collect_set("district")).alias("districts"))
    if level == "india":
        names.append(F.sort_array(F.collect_set("state")).alias("states"))
    keys = ["date", *LEVEL_KEYS[level], "commodity", "category"]
    return district_partials(market_rows).groupBy(*keys).agg(*_measures(missing_price), *names)


def rollup_all_levels(market_rows: DataFrame, missing_price="exclude") -> DataFrame:
    """District, state and country rows in one table with a ``level`` column.

    Grouping sets are expanded over district rows, not over market rows.
    """
    fixed = ["date", "commodity", "category"]
    grouped = district_partials(market_rows).groupingSets(
        [[*fixed, "state", "district"], [*fixed, "state"], fixed], *fixed, "state", "district",
    ).agg(F.grouping_id().alias("_level"), *_measures(missing_price))
    level = (F.when(F.col("_level") == 0, "district")
             .when(F.col("_level") == 1, "state").otherwise("india"))
    return grouped.select(level.alias("level"), *[c for c in grouped.columns if c != "_level"])


def contributors(market_rows: DataFrame, level) -> DataFrame:
    """The markets behind each roll-up row, one row each."""
    return market_rows.filter(has_tonnage("tonnage")).select(
        "date", *LEVEL_KEYS[level], "commodity", *(["market"] if level != "market" else [])
    ).distinct()


def rollup_variety_level(obs: DataFrame, level) -> DataFrame:
    """Mean price and row count per date, unit, commodity and variety."""
    return obs.groupBy("date", *LEVEL_KEYS[level], "category", "commodity", "variety").agg(
        F.avg("modal_price").alias("price"),
        F.count(F.lit(1)).alias("contrib"),
    )
