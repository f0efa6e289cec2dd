"""Column layouts and explicit schemas."""

from pyspark.sql import types as T

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()


def _struct(*pairs):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in pairs])


# Headerless bulletin files are told apart by their number of fields. The older
# collection used some of the same widths for other columns.
BULLETIN_LAYOUTS = {
    10: ["date", "state", "market", "category", "commodity", "variety", "tonnage",
         "min_price", "max_price", "modal_price"],
    11: ["date", "state", "market", "category", "commodity", "variety", "tonnage", "grade",
         "min_price", "max_price", "modal_price"],
    12: ["date", "state", "market", "category", "commodity", "variety", "tonnage",
         "min_price", "max_price", "modal_price", "origin_state", "origin_market"],
    13: ["date", "state", "market", "category", "commodity", "variety", "tonnage", "grade",
         "min_price", "max_price", "origin_state", "origin_market", "modal_price"],
}
OLDER_LAYOUTS = {
    9: ["date", "state", "market", "commodity", "variety", "tonnage",
        "min_price", "max_price", "modal_price"],
    10: ["date", "state", "market", "commodity", "variety", "tonnage", "grade",
         "min_price", "max_price", "modal_price"],
    # a commodity name broken up by its own commas fills fields 4 to 6
    11: ["date", "state", "market", "commodity", "commodity", "commodity", "variety", "tonnage",
         "min_price", "max_price", "modal_price"],
}
BULLETIN_TEXT = ["date", "state", "market", "category", "commodity", "variety", "grade",
                 "origin_state", "origin_market"]
BULLETIN_NUMBERS = ["tonnage", "min_price", "max_price", "modal_price"]

OBSERVATION = _struct(
    ("date", T.DateType()), ("state", _S), ("market", _S), ("category", _S), ("commodity", _S),
    ("variety", _S), ("grade", _S), ("tonnage", _D), ("min_price", _D), ("max_price", _D),
    ("modal_price", _D), ("origin_state", _S), ("origin_market", _S),
)

MARKET_LOCATION = _struct(
    ("location_key", _S), ("market_cleaned", _S), ("market", _S), ("state", _S),
    ("district", _S), ("taluk", _S),
)

POSTAL = _struct(("pin", _S), ("taluk", _S), ("district", _S), ("state", _S))

CENSUS = _struct(
    ("level", _S), ("name", _S), ("state", _S), ("tru", _S), ("area", _D), ("total", _D),
    ("work", _D), ("cultivator_main", _D), ("cultivator_marginal", _D),
    ("agrilabourers_main", _D), ("agrilabourers_marginal", _D), ("no_work", _D),
)

PRODUCTION = _struct(
    ("sheet", T.IntegerType()), ("row_no", _L), ("state", _S), ("crop", _S), ("district", _S),
    ("year", _S), ("season", _S), ("area_ha", _D), ("production_t", _D),
    ("production_split", _D), ("yield_t_ha", _D), ("yield_split", _D),
)

CITY_PRICE = _struct(("date", T.DateType()), ("zone", _S), ("city", _S), ("product", _S),
                     ("price", _D))

LOCATION_TREE = T.MapType(_S, T.MapType(_S, T.ArrayType(_S)))
SELECTION = T.MapType(_S, T.ArrayType(_S))
