"""The dashboard's read queries over the roll-up table."""

import hashlib

from pyspark.sql import DataFrame, functions as F

from mandigrid.operators import catalogue, rollup
from mandigrid.operators.relational import (
    any_of, find_slice, find_sorted_limited, keep_matching, only_in_first, selected_commodities,
)
from mandigrid.plans import serving
from mandigrid.queries.common import DISTRICT, LEVELS, MARKET, OBS, STATE, d, n, present, s
from mandigrid.queries.quality import END, LOOSE, START, _stats_sql
from mandigrid.queries.rollups import market_rows
from mandigrid.session import shared_base
from mandigrid.sources.bulletins import stack
from mandigrid.sources.sinks import write_rollup
from mandigrid.sources.stored import stored_table
from mandigrid.sources.standins import observations, table


_COLUMNS = ["level", "date", "commodity", "state", "district", "market", "category", "price",
            "tonnage", "contrib"]


_SOURCES = ("lineitem", "supplier", "part", "nation", "region")


def _stored(spark, sf_dir, name, build, grow=None, schema=None) -> DataFrame:
    """The stored table ``name`` of a data folder, up to date with the files it is made from."""
    home = f"{shared_base(spark)}/{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    sources = {t: f"{sf_dir}/{t}.parquet" for t in _SOURCES}
    return stored_table(spark, home, sources, build, grow, ["lineitem"], schema)


def rollup_table(spark, sf_dir) -> DataFrame:
    """All levels, market rows included, as a stored table by level and commodity.

    Readers filter on these, so they list and scan the partitions they ask for. New order lines
    renew the partitions of the commodities that they name.
    """
    return _rollups(spark, sf_dir).select(*_COLUMNS)


def _stored_markets(spark, sf_dir) -> DataFrame:
    """The market rows of the roll-up table: made once, read by the roll-ups and all catalogues."""
    rows = _rollups(spark, sf_dir).filter(F.col("level") == "market").withColumn("commodity", F.col("named"))
    return rows.select(*market_rows(spark, sf_dir).columns)


def _rollups(spark, sf_dir) -> DataFrame:
    schema = _whole(market_rows(spark, sf_dir).withColumn("level", F.lit("market"))).schema

    def renew(path, named=None):
        markets = market_rows(spark, sf_dir)
        if named is not None:
            markets = markets.join(named, "commodity")
        # they are dealt by their aggregation already, and not moved once more
        write_rollup(_whole(markets.withColumn("level", F.lit("market"))), path, rebalance=False)
        stored = spark.read.schema(schema).parquet(path).filter(F.col("level") == "market")
        stored = stored.withColumn("commodity", F.col("named"))
        if named is not None:
            stored = stored.join(named, "commodity")
        write_rollup(_whole(_above(stored)), path)

    def grow(path, new_files):
        lines = spark.read.parquet(*new_files).select("l_partkey").distinct()
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("commodity"))
        renew(path, part.join(lines, "l_partkey").select("commodity").distinct())

    return _stored(spark, sf_dir, "rollups", renew, grow, schema)


def _whole(rows) -> DataFrame:
    """Roll-up rows of any level with all columns of the stored table.

    ``named`` is the commodity as it is: as a folder's name the empty one is NULL.
    """
    absent = {"district": "string", "state": "string", "market": "string", "taluk": "string",
              "contrib": "long", "varieties": "array<string>"}
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in absent.items()
                             if c not in rows.columns}).withColumn("named", F.col("commodity"))
    return rows.select(*_COLUMNS, "taluk", "varieties", "named")


def _above(markets) -> DataFrame:
    """The levels above the markets."""
    levels = [rollup.rollup_level(markets, level).withColumn("level", F.lit(level))
              for level in ("district", "state", "india")]
    return stack([f.select(*[c for c in _COLUMNS if c in f.columns]) for f in levels])


def _levels(spark, sf_dir) -> DataFrame:
    markets = market_rows(spark, sf_dir)
    rows = markets.withColumn("level", F.lit("market"))
    return stack([rows.select(*[c for c in _COLUMNS if c in rows.columns]), _above(markets)])


def series_state(spark, sf_dir):
    return present(serving.series(rollup_table(spark, sf_dir), "state", "ASIA", "PROMO"))


def series_district(spark, sf_dir):
    return present(serving.series(rollup_table(spark, sf_dir), "district", "NATION_7", "PROMO",
                                  state="ASIA"))


def series_bundle(spark, sf_dir):
    return present(serving.series_bundle(
        rollup_table(spark, sf_dir), ["ASIA"], ["NATION_7", "NATION_12"], "Supplier#000000003",
        "PROMO"))


def series_compare(spark, sf_dir):
    rows = serving.compare(rollup_table(spark, sf_dir), "state", ["ASIA", "EUROPE"], "LARGE")
    return present(rows.select("date", "state", "commodity", "price", "tonnage", "contrib"))


def _catalogue(spark, sf_dir, level) -> DataFrame:
    def write(path):
        catalogue.unit_catalogue(level, _stored_markets(spark, sf_dir), stored=True).write.parquet(path)

    return _stored(spark, sf_dir, f"catalogue-{level}", write)


def _state_catalogue(spark, sf_dir):
    return _catalogue(spark, sf_dir, "state")


def _district_catalogue(spark, sf_dir):
    return _catalogue(spark, sf_dir, "district")


def _market_catalogue(spark, sf_dir):
    return _catalogue(spark, sf_dir, "market")


def units_for_commodity(spark, sf_dir):
    return present(serving.units_for_commodity(
        _district_catalogue(spark, sf_dir), "SMALL", "EUROPE"))


def hierarchy_options(spark, sf_dir):
    markets = _market_catalogue(spark, sf_dir)
    shown = serving.units_for_commodity(markets, "PROMO").select(
        F.lit("market").alias("level"), F.col("market").alias("unit"), "commodity").distinct()
    return serving.hierarchy_options(
        _state_catalogue(spark, sf_dir), _district_catalogue(spark, sf_dir), markets, "market",
        "ASIA", "NATION_7", shown)


def trade_map(spark, sf_dir):
    places = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), (F.col("n_nationkey") * 1.5).alias("lat"))
    centres = places.filter(F.col("lat") > 10)
    return present(serving.trade_map(rollup_table(spark, sf_dir), "district", "PROMO", START, END,
                                     "ASIA", centres))


def quality_map_default(spark, sf_dir):
    return present(serving.quality_map(
        rollup_table(spark, sf_dir), _state_catalogue(spark, sf_dir), "state", "PROMO", START, END))


def quality_map(spark, sf_dir):
    return present(serving.quality_map(
        rollup_table(spark, sf_dir), _state_catalogue(spark, sf_dir), "district", "PROMO", START,
        END, LOOSE, "ASIA"))


def unit_difference(spark, sf_dir):
    """Places with customers that have no market."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"))
    markets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"))
    return only_in_first(customers, markets, "place")


def semi_filter(spark, sf_dir):
    """Markers of markets that have large lots."""
    obs = observations(spark, sf_dir)
    keys = ["market", "district", "state"]
    return keep_matching(obs.select(*keys).distinct(), obs.filter(F.col("tonnage") >= 50), keys)


def union_of_selections(spark, sf_dir):
    rows = any_of(observations(spark, sf_dir), "district", ["NATION_2", "NATION_12"], state="ASIA")
    return rows.groupBy("district", "commodity").agg(F.count(F.lit(1)).alias("n"))


def selected_only(spark, sf_dir):
    obs = observations(spark, sf_dir)
    wanted = table(spark, sf_dir, "part").filter(F.col("p_type").isin("ECONOMY", "SMALL")).select(
        F.when(F.col("p_type") == "ECONOMY", "BASIC").otherwise("SPECIAL").alias("category"),
        F.col("p_type").alias("commodity"))
    return selected_commodities(obs, wanted).groupBy("category", "commodity").agg(
        F.count(F.lit(1)).alias("n"))


def top_rows(spark, sf_dir):
    rows = rollup.rollup_level(market_rows(spark, sf_dir), "state").select(
        "date", "state", "commodity", "tonnage", F.struct("tonnage", "date", "state", "commodity")
        .alias("rank"))
    return present(find_sorted_limited(rows, "rank", 20, ascending=False).drop("rank"))


def sliced_rows(spark, sf_dir):
    rows = rollup.rollup_level(market_rows(spark, sf_dir), "state").drop("districts")
    return present(find_slice(rows, ["date", "state", "commodity"], 30, 45, commodity="PROMO"))


def states_without_country(spark, sf_dir):
    rows = rollup_table(spark, sf_dir)
    units = rows.select(F.coalesce("state", F.lit("India")).alias("name")).distinct()
    return serving.states_without_country(units)


def _series_sql(level, unit, extra=""):
    return f"""WITH {LEVELS}
SELECT {d('date')} AS date, {s('price')} AS price, {s('tonnage')} AS tonnage,
       {n('contrib')} AS contrib, {level}
FROM levels WHERE level = '{level}' AND {level} = '{unit}' AND commodity = 'PROMO' {extra}"""


_ENTRIES = """
r AS (SELECT state, district, category, commodity, count(*) AS cov, sum(contrib) AS total
      FROM district_rows GROUP BY ALL),
v AS (SELECT state, district, commodity, string_agg(DISTINCT variety, ',' ORDER BY variety)
      AS varieties FROM obs GROUP BY ALL)"""

QUERIES = {
    "series_state": (series_state, _series_sql("state", "ASIA")),
    "series_district": (series_district, _series_sql("district", "NATION_7", "AND state = 'ASIA'")),
    "series_bundle": (series_bundle, f"""WITH {LEVELS},
picked AS (
  SELECT level, state AS unit, commodity, date, price, tonnage, contrib FROM levels
  WHERE level = 'state' AND state = 'ASIA' UNION ALL
  SELECT level, district, commodity, date, price, tonnage, contrib FROM levels
  WHERE level = 'district' AND state = 'ASIA' AND district IN ('NATION_7', 'NATION_12') UNION ALL
  SELECT 'market', market, commodity, date, price, tonnage, NULL FROM mk
  WHERE state = 'ASIA' AND market = 'Supplier#000000003')
SELECT level || '.' || unit || '.' || commodity || '.avg' AS series_id, level, unit, commodity,
       {d('date')} AS date, {s('price')} AS price, {s('tonnage')} AS tonnage,
       {n('contrib')} AS contrib
FROM picked WHERE commodity = 'PROMO'"""),
    "series_compare": (series_compare, f"""WITH {STATE}
SELECT {d('date')} AS date, state, commodity, {s('price')} AS price, {s('tonnage')} AS tonnage,
       {n('contrib')} AS contrib
FROM state_rows WHERE state IN ('ASIA', 'EUROPE') AND commodity = 'LARGE'"""),
    "units_for_commodity": (units_for_commodity, f"""WITH {DISTRICT}, {_ENTRIES}
SELECT r.state, r.district, r.category, r.commodity, {n('cov')} AS records_coverage,
       {n('total')} AS records_total, varieties
FROM r JOIN v ON r.state = v.state AND r.district = v.district AND r.commodity = v.commodity
WHERE r.commodity = 'SMALL' AND r.state = 'EUROPE'"""),
    "hierarchy_options": (hierarchy_options, f"""WITH {DISTRICT}
SELECT DISTINCT 'state' AS level, state AS unit, commodity FROM district_rows
WHERE state = 'ASIA' UNION
SELECT 'district', district, commodity FROM district_rows
WHERE state = 'ASIA' AND district = 'NATION_7' UNION
SELECT 'market', market, commodity FROM mk
WHERE state = 'ASIA' AND district = 'NATION_7' AND commodity <> 'PROMO'"""),
    "trade_map": (trade_map, f"""WITH {DISTRICT}
SELECT state, district, commodity, {s('sum(tonnage)')} AS aggr_tonnage, '{START}' AS start_date,
       '{END}' AS end_date, district AS name, {s('any_value(n_nationkey * CAST(1.5 AS DOUBLE))')} AS lat
FROM district_rows JOIN nation ON n_name = district
WHERE commodity = 'PROMO' AND state = 'ASIA' AND date >= DATE '{START}' AND date < DATE '{END}'
  AND n_nationkey * 1.5 > 10
GROUP BY state, district, commodity"""),
    "quality_map_default": (quality_map_default, f"""WITH {STATE}
SELECT r.*, v.varieties FROM (
  SELECT state, category, commodity, {n('count(*)')} AS records_coverage,
         {n('sum(contrib)')} AS records_total
  FROM state_rows WHERE commodity = 'PROMO' GROUP BY ALL) r
JOIN (SELECT state, string_agg(DISTINCT variety, ',' ORDER BY variety) AS varieties
      FROM obs WHERE commodity = 'PROMO' GROUP BY state) v ON r.state = v.state"""),
    "quality_map": (quality_map, _stats_sql(
        DISTRICT, "district_rows", ["state", "district"],
        "AND state = 'ASIA' AND commodity = 'PROMO'", (60, 60, 0))),
    "unit_difference": (unit_difference, """
SELECT c_custkey AS place FROM customer EXCEPT SELECT s_suppkey FROM supplier"""),
    "semi_filter": (semi_filter, f"""WITH {OBS}
SELECT DISTINCT market, district, state FROM obs WHERE tonnage >= 50"""),
    "union_of_selections": (union_of_selections, f"""WITH {OBS}
SELECT district, commodity, {n('count(*)')} AS n FROM obs
WHERE state = 'ASIA' AND (district = 'NATION_2' OR district = 'NATION_12')
GROUP BY district, commodity"""),
    "selected_commodities": (selected_only, f"""WITH {OBS}
SELECT category, commodity, {n('count(*)')} AS n FROM obs
WHERE commodity IN ('ECONOMY', 'SMALL') GROUP BY category, commodity"""),
    "top_rows": (top_rows, f"""WITH {STATE}
SELECT {d('date')} AS date, state, commodity, {s('tonnage')} AS tonnage FROM state_rows
ORDER BY state_rows.tonnage DESC, state_rows.date DESC, state DESC, commodity DESC LIMIT 20"""),
    "sliced_rows": (sliced_rows, f"""WITH {STATE}
SELECT {d('date')} AS date, state, commodity, category, {s('price')} AS price,
       {s('tonnage')} AS tonnage, {n('contrib')} AS contrib
FROM state_rows WHERE commodity = 'PROMO'
ORDER BY state_rows.date, state LIMIT 15 OFFSET 30"""),
    "states_without_country": (states_without_country, f"""WITH {MARKET}
SELECT DISTINCT state AS name FROM mk"""),
}
