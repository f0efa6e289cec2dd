"""Roll-ups by variety and by level."""

from pyspark.sql import functions as F

from mandigrid.operators import rollup
from mandigrid.queries.common import (
    DISTRICT, INDIA, LEVELS, MARKET, OBS, STATE, d, n, names, present, s,
)
from mandigrid.sources.standins import monthly


def market_rows(spark, sf_dir):
    return rollup.rollup_varieties(monthly(spark, sf_dir))


def variety_mean(spark, sf_dir):
    return present(market_rows(spark, sf_dir).drop("taluk"))


def variety_weighted(spark, sf_dir):
    obs = monthly(spark, sf_dir).withColumn("variety_tonnage", F.col("tonnage"))
    return present(rollup.rollup_varieties(obs, "weighted").drop("taluk"))


def _level(level, missing_price="exclude"):
    def query(spark, sf_dir):
        return present(rollup.rollup_level(market_rows(spark, sf_dir), level, missing_price))
    return query


def rollup_all_levels(spark, sf_dir):
    return present(rollup.rollup_all_levels(market_rows(spark, sf_dir)))


def rollup_contributors(spark, sf_dir):
    return present(rollup.contributors(market_rows(spark, sf_dir), "state"))


def _variety(level):
    def query(spark, sf_dir):
        return present(rollup.rollup_variety_level(monthly(spark, sf_dir), level))
    return query


def _market_sql(price):
    return f"""WITH {OBS}
SELECT {d('period')} AS date, state, district, market, commodity, min(category) AS category,
       {s(price)} AS price, {s('max(tonnage)')} AS tonnage, {names('variety')} AS varieties
FROM obs GROUP BY period, state, district, market, commodity"""


def _level_sql(ctes, table, keys, price="price", extra=""):
    keys = "".join(k + ", " for k in keys)
    return f"""WITH {ctes}
SELECT {d('date')} AS date, {keys}commodity, category, {s(price)} AS price,
       {s('tonnage')} AS tonnage, {n('contrib')} AS contrib{extra} FROM {table}"""


_SETS = """,
sets AS (
  SELECT date AS set_date, commodity AS set_commodity{key}, {lists}
  FROM mk WHERE tonnage IS NOT NULL AND tonnage <> 0 GROUP BY date, commodity{group})"""

_STATE_SETS = STATE + _SETS.format(
    key=", state AS set_state", group=", state", lists=names("district") + " AS districts")
_INDIA_SETS = INDIA + _SETS.format(
    key="", group="", lists=f"{names('district')} AS districts, {names('state')} AS states")
_STATE_JOIN = ("state_rows JOIN sets ON date = set_date AND commodity = set_commodity"
               " AND state = set_state")
_INDIA_JOIN = "india_rows JOIN sets ON date = set_date AND commodity = set_commodity"

_DILUTED = f"""WITH {MARKET}
SELECT {d('date')} AS date, state, district, commodity, min(category) AS category,
       {s('coalesce(sum(price * tonnage), 0) / sum(tonnage)')} AS price,
       {s('sum(tonnage)')} AS tonnage, {n('count(*)')} AS contrib
FROM mk WHERE tonnage IS NOT NULL AND tonnage <> 0 GROUP BY date, state, district, commodity"""


def _variety_sql(*keys):
    keys = "".join(k + ", " for k in keys)
    return f"""WITH {OBS}
SELECT {d('period')} AS date, {keys}category, commodity, variety,
       {s('avg(modal_price)')} AS price, {n('count(*)')} AS contrib
FROM obs GROUP BY period, {keys}category, commodity, variety"""


QUERIES = {
    "variety_mean": (variety_mean, _market_sql("avg(modal_price)")),
    "variety_weighted": (variety_weighted, _market_sql(
        "sum(modal_price * tonnage) / nullif(max(tonnage), 0)")),
    "rollup_district": (_level("district"), _level_sql(
        DISTRICT, "district_rows", ["state", "district"])),
    "rollup_district_dilute": (_level("district", "dilute"), _DILUTED),
    "rollup_state": (_level("state"), _level_sql(
        _STATE_SETS, _STATE_JOIN, ["state"], extra=", districts")),
    "rollup_country": (_level("india"), _level_sql(
        _INDIA_SETS, _INDIA_JOIN, [], extra=", districts, states")),
    "rollup_all_levels": (rollup_all_levels, _level_sql(
        LEVELS, "levels", ["level", "state", "district"])),
    "rollup_contributors": (rollup_contributors, f"""WITH {MARKET}
SELECT DISTINCT {d('date')} AS date, state, commodity, market
FROM mk WHERE tonnage IS NOT NULL AND tonnage <> 0"""),
    "variety_by_state": (_variety("state"), _variety_sql("state")),
    "variety_by_district": (_variety("district"), _variety_sql("state", "district")),
    "variety_by_country": (_variety("india"), _variety_sql()),
}
