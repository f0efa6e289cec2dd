"""From raw bulletin rows to located observations. All steps work on streams too,
except the variety rule, which looks at a whole commodity."""

from pyspark.sql import DataFrame, functions as F

from mandigrid.fixed_values import (
    BULLETIN_MARKET_PATTERNS, COMMODITY_CORRECTIONS, COMMODITY_TRANSLATIONS, STATE_CORRECTIONS,
)
from mandigrid.functions.dates import bulletin_date
from mandigrid.functions.missing import marker_as_null, normalise, number, zero_as_null
from mandigrid.functions.text import (
    per_kg, replace_patterns, replace_whole, split_origin, squeeze, strip,
)
from mandigrid.operators.locate import add_location, add_location_rowwise
from mandigrid.session import materialise
from mandigrid.operators.timeseries import carry_headers, forward_fill


def merge_other_variety(obs: DataFrame) -> DataFrame:
    """Where a commodity's only varieties are its own name and 'Other', both are it.

    Two flags per commodity decide, so no list of varieties is gathered.
    """
    v, c = F.col("variety"), F.col("commodity")
    rules = obs.groupBy("commodity").agg(
        (F.bool_or(F.coalesce(v == c, F.lit(False))) & F.bool_or(v == "Other")
         & F.bool_and(F.coalesce((v == c) | (v == "Other"), F.lit(True)))).alias("_merge"))
    return obs.join(rules.filter("_merge"), "commodity", "left").withColumn(
        "variety", F.when(F.col("_merge"), c).otherwise(v)).select(*obs.columns)


def clean_names(obs: DataFrame) -> DataFrame:
    """Trimmed, corrected and translated names."""
    text = [c for c in ("state", "market", "category", "commodity", "variety", "grade")
            if c in obs.columns]
    obs = obs.withColumns({c: strip(c) for c in text})
    obs = obs.withColumns({
        "commodity": replace_whole("commodity", COMMODITY_CORRECTIONS),
        "state": replace_whole("state", STATE_CORRECTIONS),
    })
    return obs.withColumn("commodity_translated",
                          replace_whole("commodity", COMMODITY_TRANSLATIONS))


def clean_bulletins(obs: DataFrame, variety_rule=True) -> DataFrame:
    """Parsed bulletin rows to clean ones."""
    if variety_rule:
        obs = merge_other_variety(obs.withColumns({c: strip(c) for c in ("commodity", "variety")}))
    return clean_names(normalise(obs))


def _market_name(c):
    return F.trim(replace_patterns(c, BULLETIN_MARKET_PATTERNS))


def _placed(clean: DataFrame, locations: DataFrame) -> DataFrame:
    """Rows with their market's name, district and taluk.

    The patterns go over each distinct name once; the rows are joined with the outcome.
    """
    written = clean.select(F.col("state").alias("_s"), F.col("market").alias("_m")).distinct()
    names = add_location(materialise(written, "market-names").select(
        "_m", F.col("_s").alias("state"), _market_name("_m").alias("market")), locations)
    names = names.select("_m", F.col("state").alias("_s"), F.col("market").alias("_n"), "district", "taluk")
    rows = clean.drop("district", "taluk")
    others = [c for c in rows.columns if c not in ("state", "market")]
    return rows.join(names, F.col("state").eqNullSafe(F.col("_s")) & F.col("market").eqNullSafe(F.col("_m")), "left").select(
        "state", F.col("_n").alias("market"), *others, "district", "taluk")


def integrate_bulletins(clean: DataFrame, locations: DataFrame) -> DataFrame:
    """Clean rows with district and taluk; a tonnage of zero is missing."""
    if clean.isStreaming:
        named = clean.withColumn("market", _market_name("market"))
        placed = add_location_rowwise(named, locations)
    else:
        placed = _placed(clean, locations)
    return placed.withColumns({
        "tonnage": zero_as_null("tonnage"),
        "variety_tonnage": F.lit(None).cast("double"),
    })


def normalise_raw_bulletin(cells: DataFrame, page="page", row="row_no") -> DataFrame:
    """Rows of raw table cells to bulletin rows.

    ``cells`` is an array of text: one cell names the state of the rows below, an
    empty market repeats the one above, other blanks take the value above them
    while 'not reported' stays missing. The page supplies date, category and
    commodity. Cells: market, tonnage, origin, variety, [grade,] min, max, modal.
    """
    # each filling step uses its input twice, so what goes in is written once
    cells = materialise(cells, "cells")
    n = F.size("cells")
    titled = carry_headers(cells, page, row, n == 1, {"state": F.get("cells", 0)})
    rows = titled.filter((n >= 7) & (F.get("cells", 0) != "Market"))

    def cell(i):
        return F.trim(F.replace(F.get("cells", i), F.lit(","), F.lit("_")))

    graded = n >= 8
    at = F.when(graded, 5).otherwise(4)
    origin_state, origin_market = split_origin(cell(F.lit(2)))

    def blank(c):
        return F.nullif(c, F.lit(""))

    flat = rows.select(
        page, row, "date", "category", "commodity", "state",
        blank(cell(F.lit(0))).alias("market"), blank(cell(F.lit(3))).alias("variety"),
        F.when(graded, blank(cell(F.lit(4)))).alias("grade"),
        blank(cell(F.lit(1))).alias("tonnage"),
        blank(cell(at)).alias("min_price"), blank(cell(at + 1)).alias("max_price"),
        blank(cell(at + 2)).alias("modal_price"),
        blank(origin_state).alias("origin_state"), blank(origin_market).alias("origin_market"))
    filled = forward_fill(materialise(flat, "cell-rows"), page, row, [
        "market", "variety", "grade", "tonnage", "min_price", "max_price", "modal_price",
        "origin_state", "origin_market"])
    return filled.withColumns({
        "date": bulletin_date("date"),
        "tonnage": number("tonnage"),
        **{p: per_kg(p) for p in ("min_price", "max_price", "modal_price")},
        **{c: marker_as_null(c) for c in ("variety", "grade", "origin_state", "origin_market")},
        "market": squeeze("market"),
    })
