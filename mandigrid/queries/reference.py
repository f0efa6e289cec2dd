"""Hierarchies, census tables, crop production and city prices."""

from pyspark.sql import functions as F

from mandigrid.operators import reference_data as ref
from mandigrid.plans.reference_tables import clean_postal_directory
from mandigrid.queries.common import OBS, d, names, present, s
from mandigrid.sources.standins import observations, places, table

MEASURES = ref.MEASURES


def _postal(spark, sf_dir):
    return observations(spark, sf_dir).select(
        "state", "district", F.col("commodity").alias("taluk"), F.col("variety").alias("pin"))


def taluks_of_districts(spark, sf_dir):
    return present(ref.taluks_of_districts(_postal(spark, sf_dir)))


def districts_of_taluks(spark, sf_dir):
    return present(ref.districts_of_taluks(_postal(spark, sf_dir)))


def places_by_pin(spark, sf_dir):
    out = ref.places_by_pin(_postal(spark, sf_dir))
    return out.withColumn("places", F.array_join(F.transform(
        "places", lambda p: F.concat_ws("/", p["state"], p["district"], p["taluk"])), ","))


def postal_directory(spark, sf_dir):
    """Suppliers as post offices with names written in several ways."""
    raw = places(spark, sf_dir).select(
        F.col("s_suppkey").cast("string").alias("pin"),
        F.concat(F.lit("**"), F.upper("market"), F.lit(" Mandalam..*")).alias("taluk"),
        F.concat("district", F.lit(" & co (KAR)")).alias("district"),
        F.concat(F.lit(" "), "state", F.lit(" & delhi")).alias("state"))
    return clean_postal_directory(raw)


def _census(spark, sf_dir):
    """Customers counted by nation (district) and region (state), segments as kinds."""
    nation = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, sf_dir, "customer").join(
        F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    rural = F.col("c_mktsegment").isin("MACHINERY", "FURNITURE", "HOUSEHOLD")
    measures = [F.sum(F.floor(F.abs("c_acctbal") / (i + 1)).cast("double")).alias(m)
                for i, m in enumerate(MEASURES)]
    kinds = people.withColumn("tru", F.explode(F.array(
        F.lit("Total"), F.when(rural, "Rural").otherwise("Urban"))))

    def level(label, name):
        rows = kinds.groupBy(F.col(name).alias("name"), F.col("r_name").alias("state"), "tru").agg(
            F.sum(F.floor("c_acctbal").cast("double")).alias("area"), *measures)
        return rows.select(F.lit(label).alias("level"), "name", "state", "tru", "area", *MEASURES)

    return level("DISTRICT", "n_name").unionByName(level("STATE", "r_name"))


def census_repartition(spark, sf_dir):
    return present(ref.split_census(
        _census(spark, sf_dir), "ASIA", "NEWLAND", ["NATION_2", "NATION_7"]))


def census_pivot(spark, sf_dir):
    wide = ref.census_by_unit(_census(spark, sf_dir), "DISTRICT")
    return present(wide.select("name", "state", *[
        F.col(f"{k}.{path}").alias(f"{k}_{alias}") for k in ("rural", "urban", "total")
        for path, alias in (("area", "area"), ("population.total", "people"))]))


_TYPES = ["click", "error", "purchase", "signup", "view"]


def city_prices_long(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    wide = events.groupBy(
        F.col("ts").cast("date").alias("date"), F.lit("NORTH zone").alias("zone"),
        F.when(F.col("user_id") == 1, "Modal Price").when(F.col("user_id") == 2, "T.PURAM")
        .otherwise(F.concat(F.lit("cITY "), "user_id")).alias("city")).agg(*[
            F.sum(F.when(F.col("event_type") == t, F.floor("value"))).alias(t) for t in _TYPES])
    return present(ref.city_prices(wide, _TYPES))


def production_reshape(spark, sf_dir):
    """Events as the rows of one sheet in which names are written once."""
    v, user = F.col("value"), F.col("user_id").cast("string")
    cells = table(spark, sf_dir, "events").select(
        F.lit(1).alias("sheet"), F.col("event_id").alias("row_no"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("state "), user)).alias("state"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("CROP "), user)).alias("crop"),
        F.when(v > 50, F.concat(F.lit("DIST-A"), user)).alias("district"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("20"), user)).alias("year"),
        F.when(v > 30, F.lit(" Kharif ")).alias("season"),
        F.when(v < 100, v).alias("area_ha"),
        F.when(v < 20, v * 2).alias("production_t"),
        F.when(v >= 20, v * 3).alias("production_split"),
        F.when(v < 70, F.lit(1.5)).alias("yield_t_ha"),
        F.when(v >= 90, F.lit(2.5)).alias("yield_split"))
    return present(ref.reshape_production(cells))


# --- SQL -------------------------------------------------------------------

_RURAL = "c_mktsegment IN ('MACHINERY', 'FURNITURE', 'HOUSEHOLD')"


def _level_sql(label, name):
    measures = ", ".join(
        f"sum(floor(abs(c_acctbal) / {i + 1})) AS {m}" for i, m in enumerate(MEASURES))
    return f"""SELECT '{label}' AS level, {name} AS name, r_name AS state, tru,
       sum(floor(c_acctbal)) AS area, {measures}
FROM kinds GROUP BY {name}, r_name, tru"""


_CENSUS = f"""kinds AS (
  SELECT *, unnest(['Total', CASE WHEN {_RURAL} THEN 'Rural' ELSE 'Urban' END]) AS tru
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
census AS ({_level_sql('DISTRICT', 'n_name')} UNION ALL {_level_sql('STATE', 'r_name')})"""

_MEMBERS = "level = 'DISTRICT' AND name IN ('NATION_2', 'NATION_7')"
_SUMS = ", ".join(f"sum({m}) AS {m}" for m in ("area", *MEASURES))


def _left(m):
    less = f"c.{m} - coalesce(u.{m}, 0)"
    kept = less if m == "area" else f"CASE WHEN {less} > 0 THEN {less} END"
    return f"CASE WHEN c.name = 'ASIA' THEN {kept} ELSE c.{m} END AS {m}"


_OUT = ", ".join(f"{s(m)} AS {m}" for m in ("area", *MEASURES))
_REPARTITION = f"""WITH {_CENSUS},
u AS (SELECT tru, {_SUMS} FROM census WHERE {_MEMBERS} GROUP BY tru),
states AS (
  SELECT c.* REPLACE (CASE WHEN tru = 'Total' THEN a.area ELSE c.area END AS area)
  FROM census c JOIN (SELECT name, sum(area) AS area FROM census
                      WHERE level = 'STATE' AND tru <> 'Total' GROUP BY name) a
    ON a.name = c.name WHERE level = 'STATE'),
result AS (
  SELECT level, name, state, c.tru, {", ".join(_left(m) for m in ("area", *MEASURES))}
  FROM states c LEFT JOIN u ON u.tru = c.tru UNION ALL
  SELECT 'STATE', 'NEWLAND', 'NEWLAND', tru, {", ".join(("area", *MEASURES))} FROM u UNION ALL
  SELECT level, name, CASE WHEN {_MEMBERS} THEN 'NEWLAND' ELSE state END, tru,
         {", ".join(("area", *MEASURES))} FROM census WHERE level <> 'STATE')
SELECT level, name, state, tru, {_OUT} FROM result"""


def _kind(k, m):
    return s(f"max(CASE WHEN tru = '{k.title()}' THEN {m} END)")


_PIVOT = f"""WITH {_CENSUS}
SELECT name, state, {", ".join(
    f"{_kind(k, m)} AS {k}_{alias}" for k in ("rural", "urban", "total")
    for m, alias in (("area", "area"), ("total", "people")))}
FROM census WHERE level = 'DISTRICT' GROUP BY name, state"""

_CITIES = f"""
WITH wide AS (
  SELECT {d('ts')} AS date, user_id, event_type, sum(floor(value)) AS price
  FROM events GROUP BY ALL),
cities AS (SELECT DISTINCT date, user_id FROM wide)
SELECT c.date, 'North Zone' AS zone, CASE WHEN c.user_id = 2 THEN 'Thiruvananthapuram'
       ELSE 'City ' || c.user_id END AS city, product, {s('price')} AS price
FROM (SELECT date, user_id, unnest({_TYPES}) AS product FROM cities) c
LEFT JOIN wide w ON w.date = c.date AND w.user_id = c.user_id AND event_type = product
WHERE c.user_id <> 1"""

_FILLED = ["state", "crop", "district", "year", "season", "area_ha"]
_FIGURES = ["production_t", "production_split", "yield_t_ha", "yield_split"]
_present = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in (*_FILLED, *_FIGURES))
_PRODUCTION = f"""
WITH cells AS (
  SELECT event_id AS row_no,
         CASE WHEN event_type = 'click' THEN 'State ' || user_id END AS state,
         CASE WHEN event_type = 'view' THEN 'Crop ' || user_id END AS crop,
         CASE WHEN value > 50 THEN 'Dist-A' || user_id END AS district,
         CASE WHEN event_type = 'error' THEN '20' || user_id END AS year,
         CASE WHEN value > 30 THEN 'Kharif' END AS season,
         CASE WHEN value < 100 THEN value END AS area_ha,
         CASE WHEN value < 20 THEN value * 2 END AS production_t,
         CASE WHEN value >= 20 THEN value * 3 END AS production_split,
         CASE WHEN value < 70 THEN CAST(1.5 AS DOUBLE) END AS yield_t_ha,
         CASE WHEN value >= 90 THEN CAST(2.5 AS DOUBLE) END AS yield_split
  FROM events),
filled AS (
  SELECT row_no, {", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in _FILLED)},
         {", ".join(_FIGURES)}
  FROM cells WINDOW w AS (ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
kept AS (SELECT * FROM filled WHERE {_present} >= 4)
SELECT CAST(1 AS BIGINT) AS sheet, row_no, state, crop, district, year, season,
       {s('coalesce(area_ha, 0)')} AS area_ha,
       {s('coalesce(production_split, 0) + coalesce(production_t, 0)')} AS production_t,
       {s('coalesce(yield_split, 0) + coalesce(yield_t_ha, 0)')} AS yield_t_ha
FROM kept WHERE row_no < (SELECT max(row_no) FROM kept)"""

QUERIES = {
    "taluks_of_districts": (taluks_of_districts, f"""WITH {OBS}
SELECT state, district, {names('commodity')} AS taluks FROM obs GROUP BY state, district"""),
    "districts_of_taluks": (districts_of_taluks, f"""WITH {OBS}
SELECT state, commodity AS taluk, {names('district')} AS districts
FROM obs GROUP BY state, commodity"""),
    "places_by_pin": (places_by_pin, f"""WITH {OBS},
t AS (SELECT DISTINCT variety AS pin, state, district, commodity FROM obs)
SELECT pin, string_agg(state || '/' || district || '/' || commodity, ','
                       ORDER BY state, district, commodity) AS places
FROM t GROUP BY pin"""),
    "postal_directory": (postal_directory, r"""
SELECT CAST(s_suppkey AS VARCHAR) AS pin, s_name || ' .' AS taluk,
       upper(n_name[1]) || lower(n_name[2:]) || ' And Co' AS district,
       array_to_string(list_transform(string_split(r_name, ' '),
                                      lambda w: upper(w[1]) || lower(w[2:])), ' ')
         || ' and NCT of Delhi' AS state
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "census_repartition": (census_repartition, _REPARTITION),
    "census_pivot": (census_pivot, _PIVOT),
    "city_prices_long": (city_prices_long, _CITIES),
    "production_reshape": (production_reshape, _PRODUCTION),
}
