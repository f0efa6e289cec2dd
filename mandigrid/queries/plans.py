"""Whole plans on tables derived from the benchmark: the SQL twin states the outcome."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from mandigrid.operators import reference_data as ref
from mandigrid.plans import bulletins, reference_tables as tables
from mandigrid.plans.statistics import combine_statistics, compute_statistics
from mandigrid.operators.rollup import rollup_level
from mandigrid.queries import quality as quality_queries
from mandigrid.queries.common import OBS, STATE, n, names, present, s
from mandigrid.queries.matching import _damaged
from mandigrid.queries.quality import END, START
from mandigrid.queries.reference import _CENSUS, _census
from mandigrid.queries.rollups import market_rows
from mandigrid.operators.relational import find
from mandigrid.session import shared_dir
from mandigrid.sources.sinks import append_documents, write_rollup
from mandigrid.sources.standins import observations, places, table


def _markets(spark, sf_dir):
    """Suppliers as markets with a true place and an address that tells it."""
    taluk = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), F.initcap("p_name").alias("taluk"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("market_id"), F.col("s_nationkey").alias("code"), "s_acctbal")
    rows = places(spark, sf_dir).join(supplier, F.col("s_suppkey") == F.col("market_id")).join(
        taluk, F.col("market_id") == F.col("k"), "left").withColumn(
        "taluk", F.coalesce("taluk", F.lit("Outlying Hamlet")))  # more suppliers than parts
    district = F.concat(F.lit("Nation "), F.char(F.col("code") + 65))
    state = F.initcap("state")
    pin = (F.col("code") + 500000).cast("string")
    return rows.select(
        "market_id", "market", state.alias("state"), district.alias("district"), "taluk",
        pin.alias("pin"), "s_acctbal",
        F.concat(F.lit("No. 12 Mill Street, "), "taluk", F.lit(" Mandal, DISST "), district,
                 F.lit("-"), pin, F.lit(", "), state).alias("apmc_address"),
        F.lit("").alias("secretary_address"), (F.col("s_acctbal") > 0).alias("regulated"))


def market_locations(spark, sf_dir):
    markets = _markets(spark, sf_dir)
    postal = markets.select("pin", "taluk", "district", "state")
    raw = markets.drop("district", "taluk", "pin")
    return tables.build_market_locations(raw, postal)


def market_profiles(spark, sf_dir):
    placed = _markets(spark, sf_dir).withColumns({
        "market_cleaned": F.col("market"), "established": F.col("market_id").cast("string"),
        "regulated_commodities": F.lit("*"), "cleaning_or_grading": F.lit("NA"),
        "cold_storage": F.lit("2"), "incoming": F.lit("Rail"), "outgoing": F.lit("*"),
        "railway_dist": F.lit("1.5"), "market_fee": F.lit("1%"), "commission": F.lit(""),
        "sale_process": F.lit("Auction"), "payment_process": F.lit("Cash"),
        "income": F.when(F.col("s_acctbal") > 0, F.floor("s_acctbal").cast("string"))
        .otherwise("*"), "expenditure": F.lit("100"), "reserves": F.lit("7"),
        "liabilities": F.lit("NA")})
    coordinates = placed.select("state", "market", F.lit(1.5).alias("lat"),
                                F.col("market_id").cast("double").alias("lng"))
    out = tables.build_market_profiles(placed, coordinates)
    return present(out.select(
        "name", "state", "district", "taluk", "established", "num_commodities_regulated",
        F.col("address.pin").alias("pin"), F.col("transport.outgoing").alias("outgoing"),
        F.col("business.commission").alias("commission"),
        F.col("accounting.profit").alias("profit"),
        F.col("accounting.apmc_liabilities").alias("liabilities"),
        F.col("coordinates.lng").alias("lng")))


def _locations(spark, sf_dir):
    return places(spark, sf_dir).select("state", "district", F.col("market").alias("taluk"))


def states_with_census(spark, sf_dir):
    wide = ref.census_by_unit(_census(spark, sf_dir), "STATE").withColumn("name", _damaged("name"))
    out = tables.build_states(_locations(spark, sf_dir), wide)
    return present(out.select("state", "districts", F.col("census.total.area").alias("area"),
                              F.col("census.rural.population.work").alias("work")))


def districts_with_census(spark, sf_dir):
    wide = ref.census_by_unit(_census(spark, sf_dir), "DISTRICT").withColumn(
        "name", _damaged("name"))
    out = tables.build_districts(_locations(spark, sf_dir), wide)
    return present(out.select("state", "district", F.col("census.total.area").alias("area")))


def state_boundaries(spark, sf_dir):
    """Shapes under a misspelt name, one under an alternate one only."""
    states = table(spark, sf_dir, "region").select(F.col("r_name").alias("state"))
    odd = F.col("state") == "EUROPE"
    shapes = states.select(
        F.when(odd, "Old Continent").otherwise(_damaged("state")).alias("name_1"),
        F.when(odd, "Evropa & more|EUROPA").alias("varname_1"),
        F.concat(F.lit("shape of "), "state").alias("geometry"))
    matched = tables.match_state_boundaries(shapes, states)
    out = tables.boundary_features(shapes, matched, "State", "name_1")
    return out.select("id", F.col("properties.level").alias("level"),
                      F.col("properties.name").alias("name"), "geometry")


def district_boundaries(spark, sf_dir):
    districts = _locations(spark, sf_dir).select("state", "district").distinct()
    shapes = districts.select("state", F.concat(_damaged("district"), F.lit(" (Old)"))
                              .alias("name_2"), F.lit(None).cast("string").alias("varname_2"),
                              F.col("district").alias("geometry"))
    matched = tables.match_district_boundaries(shapes, districts)
    out = tables.boundary_features(shapes, matched, "District", ["state", "name_2"])
    return tables.boundary_of(out, "ASIA").select("state", "id", "geometry")


def integrated_bulletins(spark, sf_dir):
    """Bulletin rows through cleaning and integration."""
    obs = observations(spark, sf_dir).withColumns({
        "market": F.concat(F.lit(" "), "market", F.lit(" Mkt.")),
        "commodity": F.when(F.col("commodity") == "PROMO", " Soanf").otherwise(F.col("commodity")),
        "tonnage": F.when(F.col("tonnage") < 5, F.lit(0.0)).when(
            F.col("tonnage") < 10, F.lit(float("nan"))).otherwise(F.col("tonnage"))})
    locations = places(spark, sf_dir).select(
        F.concat_ws("_", "state", "market").alias("location_key"), "district",
        F.col("market").alias("taluk"))
    clean = bulletins.clean_bulletins(obs.drop("district"))
    out = bulletins.integrate_bulletins(clean, locations)
    return present(out.groupBy("state", "district", "market", "commodity_translated").agg(
        F.count(F.lit(1)).alias("n"), F.count("tonnage").alias("weighed"),
        F.sum("tonnage").alias("tonnage")))


def _all_rows(reports: dict) -> DataFrame:
    """All rows of all reports, each with its report's name; NULL where a report lacks a column."""
    named = [report.withColumn("report", F.lit(name)) for name, report in reports.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def statistics(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return present(_all_rows(compute_statistics(obs, START, END)))


def statistics_combined(spark, sf_dir):
    obs = observations(spark, sf_dir)
    reports = combine_statistics(compute_statistics(obs, START, END))
    return present(_all_rows({k: reports[k] for k in ("nas_by_state_year", "coverage_by_year")}))


def stored_rollups(spark, sf_dir):
    """State rows written as a partitioned table, one commodity renewed, one read back."""
    rows = rollup_level(market_rows(spark, sf_dir), "state").withColumn("level", F.lit("state"))
    path = shared_dir(spark, "rollups")
    write_rollup(rows, path)
    write_rollup(find(rows, commodity="PROMO").withColumn("contrib", -F.col("contrib")), path)
    stored = spark.read.parquet(path)
    return present(stored.groupBy("level", "commodity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("contrib").alias("contrib")))


def stored_documents(spark, sf_dir):
    """Places appended twice; the second time only what is new is added."""
    rows = places(spark, sf_dir).select("state", "district", "market")
    path = shared_dir(spark, "documents")
    append_documents(rows.filter(F.col("state") != "ASIA"), path, ["district", "market"])
    append_documents(rows, path, ["district", "market"])
    return spark.read.parquet(path)


# --- SQL -------------------------------------------------------------------

_TRUE = """true_places AS (
  SELECT s_suppkey, s_name, s_acctbal,
         array_to_string(list_transform(string_split(r_name, ' '),
                                        lambda w: upper(w[1]) || lower(w[2:])), ' ') AS state,
         'Nation ' || chr(s_nationkey + 65) AS district,
         coalesce(array_to_string(list_transform(string_split(p_name, ' '),
                  lambda w: upper(w[1]) || lower(w[2:])), ' '), 'Outlying Hamlet') AS taluk,
         CAST(500000 + s_nationkey AS VARCHAR) AS pin
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON p_partkey = s_suppkey)"""


def _reports():
    """Report name -> (SQL, measure) of the statistics."""
    q = quality_queries
    named, market = ("category", "commodity"), ("state", "district", "market")
    sql = {"nas_by_commodity": q.QUERIES["missing_total"][1]}
    for suffix, time in (("", ()), ("_year-month", ("year", "month")), ("_year", ("year",)),
                         ("_month", ("month",))):
        sql[f"nas_by_state{suffix}"] = q._missing_sql("state", *time)
        if time:
            sql[f"nas_by{suffix}"] = q._missing_sql(*time)
    by_state = q.QUERIES["tonnage_by_time"][1]
    mean_by_state = q.QUERIES["tonnage_month_mean"][1]
    sql["tonnage_by_state"], sql["tonnage_by_state_month_mean"] = by_state, mean_by_state
    sql["tonnage"] = by_state.replace("state, category", "category").replace(
        "days AS (SELECT DISTINCT date, category", "days AS (SELECT DISTINCT date, state, category")
    sql["tonnage_month_mean"] = mean_by_state.replace("SELECT state, category", "SELECT category"
                                                      ).replace("BY state, category", "BY category")
    sql["coverage_by_commodity"] = q._fixed_coverage_sql(*named)
    for time in (("year",), ("month",), ("year", "month")):
        sql["coverage_by_" + "-".join(time)] = q._coverage_sql(*named, *time)
    for name, place in (("market", market), ("state", ("state",))):
        sql[f"coverage_by_{name}"] = q._fixed_coverage_sql(*named, *place)
        for time in (("year",), ("year", "month")):
            sql[f"coverage_by_{name}_{'-'.join(time)}"] = q._coverage_sql(*named, *place, *time)
        cols = ", ".join((*named, *place))
        sql[f"coverage_by_{name}_month"] = f"""
WITH {q._coverage_cte(*named, *place, 'year', 'month')}
SELECT {cols}, month, {s('avg(coverage)')} AS coverage FROM cov GROUP BY {cols}, month"""
    return sql


def _all_rows_sql(reports):
    return "\nUNION ALL BY NAME\n".join(
        f"SELECT '{name}' AS report, * FROM ({sql})" for name, sql in reports.items())


QUERIES = {
    "market_locations": (market_locations, f"""WITH {_TRUE}
SELECT state || '_' || s_name AS location_key, s_name AS market_cleaned, s_name AS market, state,
       district, taluk FROM true_places"""),
    "market_profiles": (market_profiles, f"""WITH {_TRUE}
SELECT s_name AS name, state, district, taluk,
       CASE WHEN s_suppkey = 0 OR s_suppkey > 9999 THEN NULL
            WHEN s_suppkey < 10 THEN CAST(2000 + s_suppkey AS VARCHAR)
            WHEN s_suppkey < 59 THEN CAST(2000 + s_suppkey AS VARCHAR)
            WHEN s_suppkey < 100 THEN CAST(1900 + s_suppkey AS VARCHAR)
            WHEN s_suppkey < 1000 THEN s_suppkey || '0'
            ELSE CAST(s_suppkey AS VARCHAR) END || '-01-01' AS established,
       CAST(NULL AS VARCHAR) AS num_commodities_regulated, pin, CAST(NULL AS VARCHAR) AS outgoing,
       CAST(NULL AS VARCHAR) AS commission,
       {s('CASE WHEN s_acctbal > 0 THEN floor(s_acctbal) - 100 END')} AS profit,
       CAST(NULL AS DOUBLE) AS liabilities, CAST(s_suppkey AS DOUBLE) AS lng
FROM true_places"""),
    "states_with_census": (states_with_census, f"""WITH {_CENSUS},
l AS (SELECT r_name AS state, {names('n_name')} AS districts FROM supplier
      JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      GROUP BY r_name)
SELECT l.state, l.districts, {s("max(CASE WHEN tru = 'Total' THEN area END)")} AS area,
       {s("max(CASE WHEN tru = 'Rural' THEN work END)")} AS work
FROM l JOIN census c ON c.name = l.state AND c.level = 'STATE' GROUP BY l.state, l.districts"""),
    "districts_with_census": (districts_with_census, f"""WITH {_CENSUS},
l AS (SELECT DISTINCT r_name AS state, n_name AS district FROM supplier
      JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT l.state, l.district, {s("max(CASE WHEN tru = 'Total' THEN area END)")} AS area
FROM l JOIN census c ON c.name = l.district AND c.level = 'DISTRICT'
GROUP BY l.state, l.district"""),
    "state_boundaries": (state_boundaries, """
SELECT r_name AS id, 'State' AS level, r_name AS name, 'shape of ' || r_name AS geometry
FROM region"""),
    "district_boundaries": (district_boundaries, """
SELECT DISTINCT r_name AS state, n_name AS id, n_name AS geometry FROM supplier
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA'"""),
    "integrated_bulletins": (integrated_bulletins, f"""WITH {OBS},
o AS (SELECT state, district, market,
             CASE WHEN commodity = 'PROMO' THEN 'Saunf' ELSE commodity END AS commodity_translated,
             CASE WHEN tonnage >= 10 THEN tonnage END AS t FROM obs)
SELECT state, district, market, commodity_translated, {n('count(*)')} AS n,
       {n('count(t)')} AS weighed, {s('sum(t)')} AS tonnage
FROM o GROUP BY ALL"""),
    "statistics": (statistics, _all_rows_sql(_reports())),
    "statistics_combined": (statistics_combined, _all_rows_sql({
        "nas_by_state_year": quality_queries.QUERIES["combine_missing"][1],
        "coverage_by_year": f"""
WITH {quality_queries._coverage_cte('category', 'commodity', 'year')}
SELECT {n('year')} AS year, category, commodity, {s('coverage')} AS coverage, 'commodity' AS scope
FROM cov UNION ALL
SELECT {n('year')}, NULL, NULL, {s('avg(coverage)')}, 'total' FROM cov GROUP BY year"""})),
    "stored_rollups": (stored_rollups, f"""WITH {STATE}
SELECT 'state' AS level, commodity, {n('count(*)')} AS n,
       {n("sum(CASE WHEN commodity = 'PROMO' THEN -contrib ELSE contrib END)")} AS contrib
FROM state_rows GROUP BY commodity"""),
    "stored_documents": (stored_documents, """
SELECT r_name AS state, n_name AS district, s_name AS market FROM supplier
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
}
