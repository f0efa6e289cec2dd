"""What units trade."""

from pyspark.sql import functions as F

from mandigrid.operators import catalogue, rollup
from mandigrid.queries.common import DISTRICT, OBS, STATE, n, names, present
from mandigrid.queries.rollups import market_rows
from mandigrid.sources.standins import monthly, observations


def _with_varieties(spark, sf_dir):
    return market_rows(spark, sf_dir)


def _state_rows(spark, sf_dir):
    return rollup.rollup_level(market_rows(spark, sf_dir), "state")


def unit_records(spark, sf_dir):
    return present(catalogue.unit_records(_state_rows(spark, sf_dir), "state"))


def market_records(spark, sf_dir):
    return present(catalogue.market_records(monthly(spark, sf_dir)))


def market_commodities(spark, sf_dir):
    return present(catalogue.market_commodities(_with_varieties(spark, sf_dir)))


def unit_varieties(spark, sf_dir):
    return present(catalogue.unit_varieties(_with_varieties(spark, sf_dir), "district"))


def distinct_units(spark, sf_dir):
    return catalogue.distinct_units(observations(spark, sf_dir))


def _text(entry, fields):
    """One catalogue entry as text."""
    return F.concat_ws("|", *[
        F.array_join(entry[f], "+") if f == "varieties" else entry[f].cast("string")
        for f in fields])


def _catalogue(level, fields):
    def query(spark, sf_dir):
        out = catalogue.unit_catalogue(level, _with_varieties(spark, sf_dir))
        return out.withColumn("commodities", F.array_join(
            F.transform("commodities", lambda e: _text(e, fields)), ";"))
    return query


_ROLLED = ["category", "commodity", "records_coverage", "records_total", "varieties"]


def commodity_entries(spark, sf_dir):
    return catalogue.dictionary_entries(observations(spark, sf_dir))


def commodity_dictionary(spark, sf_dir):
    return present(catalogue.commodity_dictionary(observations(spark, sf_dir)))


def commodities_without_category(spark, sf_dir):
    dictionary = catalogue.commodity_dictionary(observations(spark, sf_dir))
    return catalogue.without_other(dictionary, "BASIC").select("commodity")


def market_commodity_list(spark, sf_dir):
    return present(catalogue.commodities_by(observations(spark, sf_dir), "market"))


def country_catalogue(spark, sf_dir):
    return present(catalogue.country_catalogue(observations(spark, sf_dir)))


def value_counts(spark, sf_dir):
    return catalogue.value_counts(observations(spark, sf_dir), "category", "district")


def _catalogue_sql(ctes, table, *keys):
    cols = ", ".join(keys)
    on = " AND ".join(f"r.{k} = v.{k}" for k in (*keys, "commodity"))
    return f"""WITH {ctes},
r AS (SELECT {cols}, category, commodity, count(*) AS cov, sum(contrib) AS total
      FROM {table} GROUP BY ALL),
v AS (SELECT {cols}, commodity, string_agg(DISTINCT variety, '+' ORDER BY variety) AS varieties
      FROM obs GROUP BY ALL)
SELECT {", ".join("r." + k for k in keys)},
       string_agg(concat_ws('|', r.category, r.commodity, CAST(cov AS VARCHAR),
                  CAST(total AS VARCHAR), varieties), ';' ORDER BY r.category, r.commodity)
       AS commodities
FROM r JOIN v ON {on} GROUP BY ALL"""


QUERIES = {
    "unit_records": (unit_records, f"""WITH {STATE}
SELECT state, category, commodity, {n('count(*)')} AS records_coverage,
       {n('sum(contrib)')} AS records_total
FROM state_rows GROUP BY state, category, commodity"""),
    "market_records": (market_records, f"""WITH {OBS}
SELECT state, district, market, category, commodity, {names('variety')} AS varieties,
       {n('count(*)')} AS records
FROM obs GROUP BY state, district, market, category, commodity"""),
    "market_commodities": (market_commodities, f"""WITH {OBS}
SELECT state, district, market, category, commodity, {names('variety')} AS varieties,
       {n('count(DISTINCT period)')} AS records
FROM obs GROUP BY state, district, market, category, commodity"""),
    "unit_varieties": (unit_varieties, f"""WITH {OBS}
SELECT state, district, category, commodity, {names('variety')} AS varieties
FROM obs GROUP BY state, district, category, commodity"""),
    "distinct_units": (distinct_units, f"WITH {OBS} SELECT DISTINCT state, district FROM obs"),
    "catalogue_state": (_catalogue("state", _ROLLED),
                        _catalogue_sql(STATE, "state_rows", "state")),
    "catalogue_district": (_catalogue("district", _ROLLED),
                           _catalogue_sql(DISTRICT, "district_rows", "state", "district")),
    "catalogue_market": (_catalogue("market", ["category", "commodity", "records", "varieties"]),
                         f"""WITH {OBS},
r AS (SELECT state, district, market, category, commodity, count(DISTINCT period) AS records,
             string_agg(DISTINCT variety, '+' ORDER BY variety) AS varieties
      FROM obs GROUP BY ALL)
SELECT state, district, market,
       string_agg(concat_ws('|', category, commodity, CAST(records AS VARCHAR), varieties), ';'
                  ORDER BY category, commodity) AS commodities
FROM r GROUP BY state, district, market"""),
    "commodity_entries": (commodity_entries, f"""WITH {OBS}
SELECT DISTINCT commodity, 'variety' AS field, variety AS value FROM obs UNION
SELECT commodity, 'state', state FROM obs UNION
SELECT commodity, 'market', market FROM obs UNION
SELECT commodity, 'category', category FROM obs"""),
    "commodity_dictionary": (commodity_dictionary, f"""WITH {OBS}
SELECT commodity, {names('variety')} AS varieties, {names('state')} AS states,
       {names('category')} AS categories
FROM obs GROUP BY commodity"""),
    "commodities_without_category": (commodities_without_category, f"""WITH {OBS}
SELECT commodity FROM obs GROUP BY commodity HAVING count(*) FILTER (category = 'BASIC') = 0"""),
    "market_commodity_list": (market_commodity_list, f"""WITH {OBS}
SELECT market, {names('commodity')} AS commodities FROM obs GROUP BY market"""),
    "country_catalogue": (country_catalogue, f"""WITH {OBS}
SELECT category, {names('commodity')} AS commodities FROM obs GROUP BY category ORDER BY category"""),
    "value_counts": (value_counts, f"""WITH {OBS}
SELECT category, district, {n('count(*)')} AS n FROM obs GROUP BY category, district"""),
}
