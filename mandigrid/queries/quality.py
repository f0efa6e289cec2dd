"""Missing values, coverage, tonnage statistics."""

from pyspark.sql import functions as F

from mandigrid.operators import quality, rollup
from mandigrid.operators.relational import date_range
from mandigrid.queries.common import DISTRICT, MARKET, OBS, STATE, n, present, s
from mandigrid.queries.rollups import market_rows
from mandigrid.sources.standins import observations

START, END = "1996-01-01", "2000-07-01"
LOOSE = {"missing_prices": 60, "missing_tonnages": 60, "coverage": 0}


def _rolled(level):
    def rows(spark, sf_dir):
        markets = market_rows(spark, sf_dir)
        return markets if level == "market" else rollup.rollup_level(markets, level)
    return rows


def tonnage_aggregate(spark, sf_dir):
    return present(quality.tonnage_aggregate(
        _rolled("district")(spark, sf_dir), "district", "PROMO", START, END, "ASIA"))


def _stats(level, **options):
    def query(spark, sf_dir):
        return present(quality.unit_statistics(
            _rolled(level)(spark, sf_dir), level, START, END, **options))
    return query


def _missing(units, time):
    def query(spark, sf_dir):
        return present(quality.missing_by(observations(spark, sf_dir), units, time))
    return query


def missing_total(spark, sf_dir):
    return present(quality.missing_total(observations(spark, sf_dir)))


def missing_percent(spark, sf_dir):
    missing = quality.missing_by(observations(spark, sf_dir), ["state"], ["year"])
    return present(quality.missing_percent(missing))


def tonnage_by_time(spark, sf_dir):
    return present(quality.tonnage_by_time(observations(spark, sf_dir), ["state"]))


def tonnage_month_mean(spark, sf_dir):
    return present(quality.tonnage_month_mean(observations(spark, sf_dir), ["state"]))


def _coverage(keys, start=None, end=None):
    def query(spark, sf_dir):
        return present(quality.coverage(observations(spark, sf_dir), keys, start, end))
    return query


_NAMED = ["category", "commodity"]
_MARKET_KEYS = ["state", "district", "market"]


def coverage_month_mean(spark, sf_dir):
    report = quality.coverage(observations(spark, sf_dir), [*_NAMED, "state", "year", "month"])
    return present(quality.coverage_month_mean(report))


def coverage_year_mean(spark, sf_dir):
    report = quality.coverage(observations(spark, sf_dir), [*_NAMED, *_MARKET_KEYS, "year"])
    return present(quality.coverage_year_mean(report))


def combine_tonnage(spark, sf_dir):
    obs = quality.add_year_month(quality.market_day_tonnage(observations(spark, sf_dir)))
    report = obs.groupBy("state", "year", *_NAMED).agg(F.sum("tonnage").alias("tonnage"))
    return present(quality.combine_commodities(report, ["state", "year"], sums=["tonnage"]))


def combine_missing(spark, sf_dir):
    report = quality.missing_by(observations(spark, sf_dir), ["state"], ["year"])
    return present(quality.combine_commodities(report, ["state", "year"], sums=quality.MISSING))


def combine_coverage(spark, sf_dir):
    report = quality.coverage(observations(spark, sf_dir), [*_NAMED, "state", "year"])
    return present(quality.combine_commodities(report, ["state", "year"], means=["coverage"]))


def weighted_mean_ratio(spark, sf_dir):
    report = quality.missing_by(observations(spark, sf_dir), ["state"], ["year", "month"])
    return present(quality.weighted_missing(report, ["state", "year"]))


def half_open_range(spark, sf_dir):
    rows = date_range(observations(spark, sf_dir), START, END)
    return present(rows.groupBy("state").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")))


# --- SQL -------------------------------------------------------------------

_RANGE = f"date >= DATE '{START}' AND date < DATE '{END}'"
_DAYS = f"(DATE '{END}' - DATE '{START}')"


def _stats_sql(ctes, table, keys, where="", thresholds=(100, 100, 0), contrib=True):
    cols = ", ".join(keys)
    pct = "floor(sum(CASE WHEN {} IS NULL THEN 1 ELSE 0 END) * 100.0 / count(*) + 0.5)"
    total = f"{n('sum(contrib)')} AS records_total," if contrib else ""
    p, t, c = thresholds
    return f"""WITH {ctes},
g AS (
  SELECT {cols}, commodity, {n('count(*)')} AS records_coverage,
         {n('sum(CASE WHEN tonnage IS NULL THEN 1 ELSE 0 END)')} AS missing_tonnages_total,
         {n('sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END)')} AS missing_prices_total, {total}
         {n(pct.format('tonnage'))} AS missing_tonnages,
         {n(pct.format('price'))} AS missing_prices,
         {n(f'floor(count(*) * 100.0 / nullif({_DAYS}, 0) + 0.5)')} AS coverage,
         '{START}' AS start_date, '{END}' AS end_date
  FROM {table} WHERE {_RANGE} {where} GROUP BY {cols}, commodity)
SELECT * FROM g WHERE missing_prices < {p} AND missing_tonnages < {t} AND coverage > {c}"""


_DAY_CTE = OBS + """,
first_rows AS (
  SELECT *, row_number() OVER (
    PARTITION BY date, state, district, market, category, commodity
    ORDER BY variety, modal_price NULLS FIRST, tonnage NULLS FIRST) AS rn
  FROM obs)"""


def _missing_cte(*keys):
    group = "".join(", " + k for k in keys)
    exprs = {"state": "state", "year": "year(date) AS year", "month": "month(date) AS month"}
    cols = "".join(", " + exprs[k] for k in keys)
    return f"""{_DAY_CTE},
missing AS (
  SELECT category, commodity{cols},
         sum(CASE WHEN min_price IS NULL THEN 1 ELSE 0 END) AS min_nas,
         sum(CASE WHEN max_price IS NULL THEN 1 ELSE 0 END) AS max_nas,
         sum(CASE WHEN modal_price IS NULL THEN 1 ELSE 0 END) AS modal_nas,
         count(*) AS modal_len,
         sum(CASE WHEN rn = 1 AND tonnage IS NULL THEN 1 ELSE 0 END) AS tonnage_nas,
         sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS tonnage_len,
         sum(CASE WHEN rn = 1 AND tonnage IS NULL AND modal_price IS NULL THEN 1 ELSE 0 END)
           AS joint_nas
  FROM first_rows GROUP BY category, commodity{group.replace('year', 'year(date)').replace('month', 'month(date)')})"""


_COUNTS = ", ".join(f"{n(c)} AS {c}" for c in quality.MISSING)


def _missing_sql(*keys):
    cols = "".join((f", {n(k)} AS {k}" if k != "state" else ", state") for k in keys)
    return f"WITH {_missing_cte(*keys)} SELECT category, commodity{cols}, {_COUNTS} FROM missing"


_DAY_TONNAGE = OBS + """,
days AS (SELECT DISTINCT date, state, district, market, category, commodity, tonnage FROM obs)"""


def _coverage_cte(*keys):
    exprs = {"year": "year(date) AS year", "month": "month(date) AS month"}
    cols = ", ".join(exprs.get(k, k) for k in keys)
    group = ", ".join({"year": "year(date)", "month": "month(date)"}.get(k, k) for k in keys)
    return f"""{OBS},
cov AS (
  SELECT {cols}, count(DISTINCT date) * 100.0
         / (last_day(max(date)) - CAST(date_trunc('month', min(date)) AS DATE) + 1) AS coverage
  FROM obs GROUP BY {group})"""


def _coverage_sql(*keys):
    cols = ", ".join(n(k) + f" AS {k}" if k in ("year", "month") else k for k in keys)
    return f"WITH {_coverage_cte(*keys)} SELECT {cols}, {s('coverage')} AS coverage FROM cov"


def _fixed_coverage_sql(*keys):
    cols = ", ".join(keys)
    first, last = f"DATE '{START}'", f"DATE '{END}'"
    days = f"count(DISTINCT CASE WHEN date BETWEEN {first} AND {last} THEN date END)"
    return f"""WITH {OBS}
SELECT {cols}, {s(f"{days} * 100.0 / ({last} - {first} + 1)")} AS coverage
FROM obs GROUP BY {cols}"""


def _combine_sql(ctes, table, measures):
    return f"""WITH {ctes}
SELECT state, {n('year')} AS year, category, commodity, {measures}, 'commodity' AS scope
FROM {table} GROUP BY state, year, category, commodity UNION ALL
SELECT state, {n('year')} AS year, NULL, NULL, {measures}, 'total'
FROM {table} GROUP BY state, year"""


_wmean = "sum({0} * {1}) / nullif(sum({1}), 0)"

QUERIES = {
    "tonnage_aggregate": (tonnage_aggregate, f"""WITH {DISTRICT}
SELECT state, district, commodity, {s('sum(tonnage)')} AS aggr_tonnage,
       '{START}' AS start_date, '{END}' AS end_date, district AS name
FROM district_rows WHERE commodity = 'PROMO' AND state = 'ASIA' AND {_RANGE}
GROUP BY state, district, commodity"""),
    "stats_state": (_stats("state"), _stats_sql(STATE, "state_rows", ["state"])),
    "stats_district": (_stats("district", state="ASIA", commodity="PROMO"), _stats_sql(
        DISTRICT, "district_rows", ["state", "district"],
        "AND state = 'ASIA' AND commodity = 'PROMO'")),
    "stats_market": (_stats("market", thresholds=LOOSE), _stats_sql(
        MARKET, "mk", ["state", "district", "market"], thresholds=(60, 60, 0), contrib=False)),
    "missing_by_state": (_missing(["state"], []), _missing_sql("state")),
    "missing_by_state_year_month": (_missing(["state"], ["year", "month"]),
                                    _missing_sql("state", "year", "month")),
    "missing_over_time": (_missing([], ["year", "month"]), _missing_sql("year", "month")),
    "missing_total": (missing_total, f"""WITH {OBS},
t AS (SELECT DISTINCT commodity, date, state, district, market, tonnage FROM obs)
SELECT o.commodity, tonnage_nas, modal_nas, min_nas, max_nas FROM
 (SELECT commodity, {n('sum(CASE WHEN modal_price IS NULL THEN 1 ELSE 0 END)')} AS modal_nas,
         {n('sum(CASE WHEN min_price IS NULL THEN 1 ELSE 0 END)')} AS min_nas,
         {n('sum(CASE WHEN max_price IS NULL THEN 1 ELSE 0 END)')} AS max_nas
  FROM obs GROUP BY commodity) o
JOIN (SELECT commodity, {n('sum(CASE WHEN tonnage IS NULL THEN 1 ELSE 0 END)')} AS tonnage_nas
      FROM t GROUP BY commodity) u ON o.commodity = u.commodity"""),
    "missing_percent": (missing_percent, f"""WITH {_missing_cte('state', 'year')}
SELECT category, commodity, state, {n('year')} AS year,
       {s('modal_nas * 100.0 / modal_len')} AS price_na_pct,
       {s('tonnage_nas * 100.0 / tonnage_len')} AS tonnage_na_pct,
       {s('joint_nas * 100.0 / tonnage_len')} AS joint_na_pct
FROM missing"""),
    "tonnage_by_time": (tonnage_by_time, f"""WITH {_DAY_TONNAGE}
SELECT 'year-month' AS grain, state, category, commodity, {n('year(date)')} AS year,
       {n('month(date)')} AS month, {s('sum(tonnage)')} AS tonnage
FROM days GROUP BY state, category, commodity, year(date), month(date) UNION ALL
SELECT 'year', state, category, commodity, {n('year(date)')}, NULL, {s('sum(tonnage)')}
FROM days GROUP BY state, category, commodity, year(date) UNION ALL
SELECT 'total', state, category, commodity, NULL, NULL, {s('sum(tonnage)')}
FROM days GROUP BY state, category, commodity"""),
    "tonnage_month_mean": (tonnage_month_mean, f"""WITH {_DAY_TONNAGE},
m AS (SELECT state, category, commodity, year(date) AS year, month(date) AS month,
             sum(tonnage) AS tonnage FROM days GROUP BY ALL)
SELECT state, category, commodity, {n('month')} AS month, {s('avg(tonnage)')} AS tonnage
FROM m GROUP BY state, category, commodity, month"""),
    "coverage_commodity": (_coverage(_NAMED, START, END), _fixed_coverage_sql(*_NAMED)),
    "coverage_market": (_coverage([*_NAMED, *_MARKET_KEYS], START, END),
                        _fixed_coverage_sql(*_NAMED, *_MARKET_KEYS)),
    "coverage_state_year": (_coverage([*_NAMED, "state", "year"]),
                            _coverage_sql(*_NAMED, "state", "year")),
    "coverage_year_month": (_coverage([*_NAMED, "year", "month"]),
                            _coverage_sql(*_NAMED, "year", "month")),
    "coverage_month": (_coverage([*_NAMED, "month"]), _coverage_sql(*_NAMED, "month")),
    "coverage_month_mean": (coverage_month_mean, f"""
WITH {_coverage_cte(*_NAMED, 'state', 'year', 'month')}
SELECT category, commodity, state, {n('month')} AS month, {s('avg(coverage)')} AS coverage
FROM cov GROUP BY category, commodity, state, month"""),
    "coverage_year_mean": (coverage_year_mean, f"""
WITH {_coverage_cte(*_NAMED, *_MARKET_KEYS, 'year')}
SELECT {n('year')} AS year, {s('avg(coverage)')} AS coverage FROM cov GROUP BY year"""),
    "combine_tonnage": (combine_tonnage, _combine_sql(
        _DAY_TONNAGE.replace("commodity, tonnage FROM obs", "commodity, year(date) AS year, tonnage FROM obs"),
        "days", f"{s('sum(tonnage)')} AS tonnage")),
    "combine_missing": (combine_missing, _combine_sql(
        _missing_cte("state", "year"), "missing",
        ", ".join(f"{n(f'sum({c})')} AS {c}" for c in quality.MISSING))),
    "combine_coverage": (combine_coverage, _combine_sql(
        _coverage_cte(*_NAMED, "state", "year"), "cov", f"{s('avg(coverage)')} AS coverage")),
    "weighted_mean_ratio": (weighted_mean_ratio, f"""
WITH {_missing_cte('state', 'year', 'month')}
SELECT state, {n('year')} AS year,
       {s(_wmean.format('min_nas', 'modal_len'))} AS min_nas,
       {s(_wmean.format('max_nas', 'modal_len'))} AS max_nas,
       {s(_wmean.format('modal_nas', 'modal_len'))} AS modal_nas,
       {n('sum(modal_len)')} AS modal_len,
       {s(_wmean.format('tonnage_nas', 'tonnage_len'))} AS tonnage_nas,
       {n('sum(tonnage_len)')} AS tonnage_len
FROM missing GROUP BY state, year"""),
    "half_open_range": (half_open_range, f"""WITH {OBS}
SELECT state, {n('count(*)')} AS n, CAST(min(date) AS VARCHAR) AS first,
       CAST(max(date) AS VARCHAR) AS last
FROM obs WHERE {_RANGE} GROUP BY state"""),
}
