"""Series on a day axis."""

from pyspark.sql import functions as F

from mandigrid.operators import quality, timeseries as ts
from mandigrid.operators.relational import price_outliers
from mandigrid.operators.rollup import rollup_level
from mandigrid.queries.common import OBS, STATE, d, n, present, s
from mandigrid.queries.quality import _coverage_cte, _missing_cte
from mandigrid.queries.rollups import market_rows
from mandigrid.sources.standins import day_prices, observations, table

_SERIES = ["market", "commodity"]
FIRST, LAST = "2023-12-30", "2024-02-02"


def _daily(spark, sf_dir):
    return ts.daily_series(day_prices(spark, sf_dir), _SERIES, "modal_price")


def fill_dates(spark, sf_dir):
    return present(ts.fill_dates(_daily(spark, sf_dir), FIRST, LAST, _SERIES))


def fill_dates_attributes(spark, sf_dir):
    """Rows of added days carry the attributes of their series."""
    rows = day_prices(spark, sf_dir).withColumns({
        "state": F.concat(F.lit("S"), F.substring("market", 1, 1)),
        "category": F.upper("commodity")})
    filled = ts.fill_dates(rows, FIRST, LAST, _SERIES)
    return present(filled.groupBy("state", "category", "date").agg(
        F.count(F.lit(1)).alias("n"), F.count("modal_price").alias("priced")))


def ffill_rows(spark, sf_dir):
    """All events of a type are one file; the value is blank on most lines."""
    lines = table(spark, sf_dir, "events").select(
        "event_type", "event_id", F.when(F.col("value") > 20, F.col("value")).alias("value"),
        F.when(F.col("value") > 30, F.col("user_id")).alias("user_id"))
    filled = ts.forward_fill(lines, "event_type", "event_id", ["value", "user_id"], chunk=1000)
    return present(filled)


def interpolate_time(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    gaps = daily.withColumn("modal_price", F.when(F.col("modal_price") > 30, F.col("modal_price")))
    return present(ts.interpolate(gaps, _SERIES, "modal_price"))


def price_diff(spark, sf_dir):
    return present(ts.difference(_daily(spark, sf_dir), _SERIES, "modal_price"))


def outliers(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return present(price_outliers(obs, 20000, district="NATION_7").groupBy(
        "market", "variety").agg(F.count(F.lit(1)).alias("n"), F.max("modal_price").alias("top")))


def _resample(unit):
    def query(spark, sf_dir):
        series = ["state", "district", "commodity"]
        rows = ts.resample(observations(spark, sf_dir), series, unit)
        return present(rows)
    return query


def unpivot_missing(spark, sf_dir):
    missing = quality.missing_by(observations(spark, sf_dir), ["state"], ["year"])
    shares = quality.missing_percent(missing)
    return present(ts.long_form(shares, ["category", "commodity", "state", "year"],
                                ["price_na_pct", "tonnage_na_pct", "joint_na_pct"]))


def complete_month_axis(spark, sf_dir):
    """Twelve months for every market, commodity and year, traded or not."""
    obs = quality.add_year_month(observations(spark, sf_dir))
    keys = ["market", "commodity", "year"]
    report = obs.groupBy(*keys, "month").agg(F.sum("tonnage").alias("tonnage"))
    return present(ts.complete_months(report, keys))


def complete_year_axis(spark, sf_dir):
    report = quality.coverage(observations(spark, sf_dir), ["year"])
    return present(ts.complete_years(report, years=(1990, 2015)))


def state_series_monthly(spark, sf_dir):
    """Roll-up rows regrouped by quarter: mean price, summed tonnage."""
    rows = rollup_level(market_rows(spark, sf_dir), "state")
    return present(ts.resample(rows, ["state", "commodity"], "quarter"))


_DAILY = """daily AS (
  SELECT CAST(user_id AS VARCHAR) AS market, event_type AS commodity, CAST(ts AS DATE) AS date,
         avg(value) AS modal_price
  FROM events GROUP BY ALL)"""
_CALENDAR = f"""cal AS (
  SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE)
         AS date)"""


def _resample_sql(unit):
    return f"""WITH {OBS}
SELECT state, district, commodity, {d(f"date_trunc('{unit}', date)")} AS date,
       {s('avg(modal_price)')} AS modal_price, {s('sum(tonnage)')} AS tonnage
FROM obs GROUP BY state, district, commodity, date_trunc('{unit}', date)"""


QUERIES = {
    "fill_dates": (fill_dates, f"""WITH {_DAILY}, {_CALENDAR},
keys AS (SELECT DISTINCT market, commodity FROM daily)
SELECT market, commodity, {d('date')} AS date, {s('modal_price')} AS modal_price
FROM (SELECT * FROM keys, cal) FULL JOIN daily USING (market, commodity, date)"""),
    "fill_dates_attributes": (fill_dates_attributes, f"""WITH {_CALENDAR},
rows AS (SELECT CAST(user_id AS VARCHAR) AS market, event_type AS commodity,
                CAST(ts AS DATE) AS date, value FROM events),
keys AS (SELECT DISTINCT market, commodity FROM rows),
full_rows AS (SELECT * FROM (SELECT * FROM keys, cal) FULL JOIN rows
              USING (market, commodity, date))
SELECT 'S' || substr(market, 1, 1) AS state, upper(commodity) AS category, {d('date')} AS date,
       {n('count(*)')} AS n, {n('count(value)')} AS priced
FROM full_rows GROUP BY 'S' || substr(market, 1, 1), upper(commodity), date"""),
    "ffill_rows": (ffill_rows, f"""
SELECT event_type, event_id,
       {s('last_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER w')} AS value,
       last_value(CASE WHEN value > 30 THEN user_id END IGNORE NULLS) OVER w AS user_id
FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "interpolate_time": (interpolate_time, f"""WITH {_DAILY},
g AS (SELECT market, commodity, date,
             CASE WHEN modal_price > 30 THEN modal_price END AS v FROM daily),
b AS (SELECT *,
        last_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER back AS bd,
        last_value(v IGNORE NULLS) OVER back AS bv,
        first_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER ahead AS ad,
        first_value(v IGNORE NULLS) OVER ahead AS av
      FROM g
      WINDOW back AS (PARTITION BY market, commodity ORDER BY date
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             ahead AS (PARTITION BY market, commodity ORDER BY date
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT market, commodity, {d('date')} AS date,
       {s('coalesce(v, bv + (av - bv) * (CAST(date - bd AS DOUBLE) / nullif(ad - bd, 0)), bv)')}
       AS modal_price
FROM b"""),
    "price_diff": (price_diff, f"""WITH {_DAILY}
SELECT market, commodity, {d('date')} AS date, {s('modal_price')} AS modal_price,
       {s('modal_price - lag(modal_price) OVER (PARTITION BY market, commodity ORDER BY date)')}
       AS diff
FROM daily"""),
    "price_outliers": (outliers, f"""WITH {OBS}
SELECT market, variety, {n('count(*)')} AS n, {s('max(modal_price)')} AS top
FROM obs WHERE district = 'NATION_7' AND modal_price > 20000 GROUP BY market, variety"""),
    "resample_day": (_resample("day"), _resample_sql("day")),
    "resample_week": (_resample("week"), _resample_sql("week")),
    "resample_month": (_resample("month"), _resample_sql("month")),
    "resample_quarter": (_resample("quarter"), _resample_sql("quarter")),
    "resample_year": (_resample("year"), _resample_sql("year")),
    "resample_rollup_quarter": (state_series_monthly, f"""WITH {STATE}
SELECT state, commodity, {d("date_trunc('quarter', date)")} AS date, {s('avg(price)')} AS price,
       {s('sum(tonnage)')} AS tonnage
FROM state_rows GROUP BY state, commodity, date_trunc('quarter', date)"""),
    "unpivot_missing": (unpivot_missing, f"""WITH {_missing_cte('state', 'year')},
p AS (SELECT category, commodity, state, year,
             CAST(modal_nas AS DOUBLE) * 100 / modal_len AS price_na_pct,
             CAST(tonnage_nas AS DOUBLE) * 100 / tonnage_len AS tonnage_na_pct,
             CAST(joint_nas AS DOUBLE) * 100 / tonnage_len AS joint_na_pct FROM missing)
SELECT category, commodity, state, {n('year')} AS year, measure, {s('value')} AS value
FROM p UNPIVOT (value FOR measure IN (price_na_pct, tonnage_na_pct, joint_na_pct))"""),
    "complete_month_axis": (complete_month_axis, f"""WITH {OBS},
r AS (SELECT market, commodity, year(date) AS year, month(date) AS month, sum(tonnage) AS tonnage
      FROM obs GROUP BY ALL),
axis AS (SELECT market, commodity, year, CAST(m AS BIGINT) AS month
         FROM (SELECT DISTINCT market, commodity, year FROM r), range(1, 13) t(m))
SELECT market, commodity, {n('year')} AS year, {n('month')} AS month, {s('tonnage')} AS tonnage
FROM axis LEFT JOIN r USING (market, commodity, year, month)"""),
    "complete_year_axis": (complete_year_axis, f"""WITH {_coverage_cte('year')}
SELECT CAST(y AS BIGINT) AS year, {s('coverage')} AS coverage
FROM range(1990, 2016) t(y) LEFT JOIN cov ON cov.year = y"""),
}
