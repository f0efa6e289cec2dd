"""Names built from names: storage keys and series identifiers."""

from pyspark.sql import Column, functions as F

from mandigrid.functions.missing import col
from mandigrid.functions.text import squeeze


def collection_key(commodity, prefix=None, suffix=None) -> Column:
    """``market.pearl.millet.varieties``"""
    parts = [F.lit(prefix)] if prefix else []
    parts.append(F.regexp_replace(squeeze(commodity), " ", "."))
    if suffix:
        parts.append(F.lit(suffix))
    return F.lower(F.concat_ws(".", *parts))


def file_key(name) -> Column:
    """``Pearl-Millet``"""
    bare = F.regexp_replace(col(name), r'^"+|"+$', "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, ",", " "), r"\s+", " "),
                            " ", "-")


def stack_key(name) -> Column:
    """File-name form of a commodity: brackets and blanks become _ and -."""
    c = F.replace(F.replace(col(name), F.lit("("), F.lit("_")), F.lit(")"), F.lit(""))
    c = F.replace(c, F.lit(" "), F.lit("-"))
    c = F.replace(F.replace(c, F.lit("_-"), F.lit("_")), F.lit("-_"), F.lit("_"))
    return F.regexp_replace(c, "-+", "-")


def series_id(level, unit, commodity, variety="avg") -> Column:
    """``state.Kerala.Rice.avg``"""
    variety = F.lit(variety) if isinstance(variety, str) else variety
    return F.concat_ws(".", col(level), col(unit), col(commodity), variety)


def location_key(state, market) -> Column:
    """``Kerala_Manjeri``"""
    return F.concat_ws("_", F.trim(col(state)), F.trim(col(market)))
