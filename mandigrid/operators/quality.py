"""Missing values, date coverage and tonnage statistics."""

from pyspark.sql import DataFrame, functions as F

from mandigrid.functions.dates import (
    add_year_month, day_count, month_span_days, percent, round_percent,
)
from mandigrid.functions.missing import count_missing
from mandigrid.operators.relational import date_range, within_thresholds

MISSING = ["min_nas", "max_nas", "modal_nas", "modal_len", "tonnage_nas", "tonnage_len",
            "joint_nas"]
_UNIT = {
    "state": ["state"],
    "district": ["state", "district"],
    "market": ["state", "district", "market"],
}


def tonnage_aggregate(rows: DataFrame, level, commodity, start, end, state=None) -> DataFrame:
    """Tonnage of one commodity per unit within a date range."""
    rows = date_range(rows.filter(F.col("commodity") == commodity), start, end)
    rows = rows.filter(F.col("tonnage").isNotNull())
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    name = F.col(level)
    return (rows.filter(name.isNotNull()).groupBy(*_UNIT[level], "commodity")
            .agg(F.sum("tonnage").alias("aggr_tonnage"))
            .withColumns({"start_date": F.lit(start).cast("date"),
                          "end_date": F.lit(end).cast("date"), "name": name}))


def unit_statistics(rows: DataFrame, level, start, end, commodity=None, state=None,
                    thresholds=None) -> DataFrame:
    """Completeness of each unit's series within a date range, in whole percent.

    Units that fail a threshold are left out; a zero-day range has no coverage.
    """
    rows = date_range(rows, start, end)
    if commodity is not None:
        rows = rows.filter(F.col("commodity") == commodity)
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    records = F.count(F.lit(1))
    measures = [
        records.alias("records_coverage"),
        count_missing("tonnage").alias("missing_tonnages_total"),
        count_missing("price").alias("missing_prices_total"),
    ]
    if level != "market":
        measures.append(F.sum("contrib").alias("records_total"))
    days = day_count(F.lit(start).cast("date"), F.lit(end).cast("date"))
    grouped = rows.groupBy(*_UNIT[level], "commodity").agg(*measures).withColumns({
        "missing_tonnages": round_percent(percent("missing_tonnages_total", "records_coverage")),
        "missing_prices": round_percent(percent("missing_prices_total", "records_coverage")),
        "coverage": round_percent(percent("records_coverage", days)),
        "start_date": F.lit(start).cast("date"),
        "end_date": F.lit(end).cast("date"),
    })
    return within_thresholds(grouped, **(thresholds or {}))


def market_days(obs: DataFrame) -> DataFrame:
    """One row per market, commodity and day with its counts of missing values.

    All reports on missing values and coverage can be made from these rows.
    Prices count once per bulletin row. Tonnage is repeated on every variety of
    a market's day, so it counts once per (date, market), as do rows without both;
    of several varieties the first one, in order, stands for the day.
    """
    place = [c for c in ("state", "district", "market") if c in obs.columns]
    first = F.struct("variety", "modal_price", "tonnage")
    days = obs.groupBy("date", *place, "category", "commodity").agg(
        *[count_missing(f"{p}_price").alias(f"{p}_nas") for p in ("min", "max", "modal")],
        F.count(F.lit(1)).alias("modal_len"),
        (count_missing("tonnage") > 0).cast("long").alias("tonnage_gap"),
        F.min(first).alias("first"),
        F.collect_set("tonnage").alias("weighed"),
    )
    return add_year_month(days).withColumns({
        "tonnage_nas": F.col("first.tonnage").isNull().cast("long"),
        "tonnage_len": F.lit(1).cast("long"),
        "joint_nas": (F.col("first.tonnage").isNull()
                      & F.col("first.modal_price").isNull()).cast("long"),
        # of a day that repeats a tonnage it counts once
        "tonnage": F.when(F.size("weighed") > 0, F.aggregate(
            "weighed", F.lit(0.0), lambda a, b: a + b)),
    }).drop("first", "weighed")


DAY_COUNTS = [*MISSING, "tonnage_gap", "tonnage"]


def months_of_days(days: DataFrame, units=()) -> DataFrame:
    """Market days added up by month: counts, tonnage, and the days as a bitmap."""
    return days.groupBy("category", "commodity", *units, "year", "month").agg(
        *[F.sum(c).alias(c) for c in DAY_COUNTS], days_seen("date").alias("days"))


def months_of_months(months: DataFrame, units=()) -> DataFrame:
    """Months of wider units: counts are added, days united."""
    return months.groupBy("category", "commodity", *units, "year", "month").agg(
        *[F.sum(c).alias(c) for c in DAY_COUNTS], F.bit_or("days").alias("days"))


def missing_by(obs: DataFrame, units=(), time=()) -> DataFrame:
    """Missing prices and tonnages per unit, period and commodity.

    One pass: market days are aggregated first, with map-side combining, and the
    groups are sums over them. Nothing is joined.
    """
    return missing_in_days(market_days(obs), units, time)


def missing_in_days(days: DataFrame, units=(), time=()) -> DataFrame:
    return days.groupBy("category", "commodity", *units, *time).agg(
        *[F.sum(c).alias(c) for c in MISSING])


def missing_over_time(obs: DataFrame, time=("year", "month")) -> DataFrame:
    return missing_by(obs, (), time)


def missing_total(obs: DataFrame) -> DataFrame:
    """Missing values per commodity; tonnage once per distinct (date, market, tonnage)."""
    return missing_total_in_days(market_days(obs))


def missing_total_in_days(days: DataFrame) -> DataFrame:
    return days.groupBy("commodity").agg(
        F.sum("tonnage_gap").alias("tonnage_nas"),
        *[F.sum(f"{p}_nas").alias(f"{p}_nas") for p in ("modal", "min", "max")])


def missing_percent(missing: DataFrame) -> DataFrame:
    """Counts to shares; the counts themselves are left out."""
    keys = [c for c in missing.columns if c not in MISSING]
    return missing.select(
        *keys,
        percent("modal_nas", "modal_len").alias("price_na_pct"),
        percent("tonnage_nas", "tonnage_len").alias("tonnage_na_pct"),
        percent("joint_nas", "tonnage_len").alias("joint_na_pct"),
    )


def ratio_to_count(share, length):
    """The count a share in percent stands for."""
    return F.col(share) / 100 * F.col(length)


def market_day_tonnage(obs: DataFrame) -> DataFrame:
    """Tonnage once per distinct observation key."""
    place = [c for c in ("state", "district", "market") if c in obs.columns]
    return obs.select("date", *place, "category", "commodity", "tonnage").distinct()


def tonnage_by_time(obs: DataFrame, units=()) -> DataFrame:
    """Total tonnage by year and month, by year, and overall, in one pass.

    ``grain`` names the row's kind; the months are the input of the mean below.
    """
    return tonnage_of_days(market_day_tonnage(obs), units)


def tonnage_of_days(days: DataFrame, units=()) -> DataFrame:
    fixed = [*units, "category", "commodity"]
    rows = days if "year" in days.columns else add_year_month(days)
    monthly = rows.groupBy(*fixed, "year", "month").agg(F.sum("tonnage").alias("tonnage"))
    sets = [[*fixed, "year", "month"], [*fixed, "year"], fixed]
    out = monthly.groupingSets(sets, *fixed, "year", "month").agg(
        F.grouping_id().alias("_g"), F.sum("tonnage").alias("tonnage"))
    grain = (F.when(F.col("_g") == 0, "year-month").when(F.col("_g") == 1, "year")
             .otherwise("total"))
    return out.select(grain.alias("grain"), *fixed, "year", "month", "tonnage")


def tonnage_month_mean(obs: DataFrame, units=()) -> DataFrame:
    """Mean over the years of each calendar month's total."""
    return tonnage_month_mean_of_days(market_day_tonnage(obs), units)


def tonnage_month_mean_of_days(days: DataFrame, units=()) -> DataFrame:
    fixed = [*units, "category", "commodity"]
    rows = days if "year" in days.columns else add_year_month(days)
    monthly = rows.groupBy(*fixed, "year", "month").agg(F.sum("tonnage").alias("tonnage"))
    return monthly.groupBy(*fixed, "month").agg(F.avg("tonnage").alias("tonnage"))


def days_seen(date):
    """Aggregate: the days of one month that occur, a bit for each."""
    return F.bit_or(F.expr(f"shiftleft(1L, dayofmonth({date}) - 1)"))


def coverage(obs: DataFrame, keys, start=None, end=None) -> DataFrame:
    """Share of days with at least one row, in percent.

    The days are those from ``start`` to ``end``, both included, or, without
    them, the whole months from the group's first to its last date. No distinct days
    are shuffled: a month of a group is one bitmap, combined map-side.
    """
    rows = obs if "year" in obs.columns else add_year_month(obs)
    units = [k for k in keys if k not in ("year", "month")]
    months = rows.filter(F.col("date").isNotNull()).groupBy(*units, "year", "month").agg(
        days_seen("date").alias("days"))
    return coverage_of_months(months, keys, start, end)


def _days_between(start, end):
    """Bitmap of the days of a row's month that lie in a range of dates."""
    month = F.col("year") * 12 + F.col("month")

    def number(d):
        return F.year(d) * 12 + F.month(d)

    all_days = F.lit(-1).cast("long")
    first = F.when(month == number(start), F.expr("shiftleft(-1L, dayofmonth(_start) - 1)"))
    last = F.when(month == number(end), F.expr("shiftleft(1L, dayofmonth(_end)) - 1"))
    inside = F.coalesce(first, all_days).bitwiseAND(F.coalesce(last, all_days))
    return F.when(month.between(number(start), number(end)), inside).otherwise(F.lit(0).cast("long"))


def coverage_of_months(months: DataFrame, keys, start=None, end=None) -> DataFrame:
    """``coverage`` from bitmaps: ``months`` has year, month, days and one row for each month of
    the keys' units."""
    rows = months.filter(F.col("days").isNotNull())
    if start is not None:
        rows = rows.withColumns({"_start": F.lit(start).cast("date"), "_end": F.lit(end).cast("date")})
        start, end = F.col("_start"), F.col("_end")
        inside = F.bit_count(F.col("days").bitwiseAND(_days_between(start, end)))
        span = F.datediff(F.first(end), F.first(start)) + 1
        return rows.groupBy(*keys).agg(percent(F.sum(inside), span).alias("coverage"))
    month = F.make_date("year", "month", F.lit(1))
    span = month_span_days(F.min(month), F.max(month))
    return rows.groupBy(*keys).agg(percent(F.sum(F.bit_count("days")), span).alias("coverage"))


_PLACE_SETS = {"market": ["state", "district", "market"], "state": ["state"]}


def coverage_reports(months: DataFrame, start, end, by_state: DataFrame = None) -> dict:
    """All coverage reports, by name; each is a lazy DataFrame.

    ``months`` are those of markets (``months_of_days``); ``by_state`` those of states, if they
    have been stored.
    """
    by_state = months_of_months(months, ["state"]) if by_state is None else by_state
    named = ["category", "commodity"]
    total = months_of_months(by_state)
    reports = {"commodity": coverage_of_months(total, named, start, end)}
    for time in (["year"], ["month"], ["year", "month"]):
        reports["-".join(time)] = coverage_of_months(total, [*named, *time])
    for name, place in _PLACE_SETS.items():
        own = months if name == "market" else by_state
        reports[name] = coverage_of_months(own, [*named, *place], start, end)
        for time in (["year"], ["year", "month"]):
            reports[f"{name}_{'-'.join(time)}"] = coverage_of_months(own, [*named, *place, *time])
        reports[f"{name}_month"] = coverage_month_mean(reports[f"{name}_year-month"])
    return reports


def coverage_month_mean(by_year_month: DataFrame) -> DataFrame:
    """Mean over the years of each calendar month's coverage."""
    keys = [c for c in by_year_month.columns if c not in ("year", "coverage")]
    return by_year_month.groupBy(*keys).agg(F.avg("coverage").alias("coverage"))


def coverage_year_mean(by_market_year: DataFrame) -> DataFrame:
    return by_market_year.groupBy("year").agg(F.avg("coverage").alias("coverage"))


def combine_commodities(report: DataFrame, keys, sums=(), means=()) -> DataFrame:
    """A report by keys and commodity, and by keys alone (commodity NULL).

    Both come from one pass over the report rows.
    """
    keys = list(keys)
    named = [*keys, "category", "commodity"]
    out = report.groupingSets([named, keys], *named).agg(
        F.grouping("commodity").alias("_total"),
        *[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means])
    return out.withColumn("scope", F.when(F.col("_total") == 1, "total").otherwise("commodity")
                          ).drop("_total")


def weighted_mean(value, weight):
    """Aggregate: mean of ``value`` weighted by ``weight``."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def weighted_missing(missing: DataFrame, keys) -> DataFrame:
    """Missing counts averaged by group size."""
    return missing.groupBy(*keys).agg(
        weighted_mean("min_nas", "modal_len").alias("min_nas"),
        weighted_mean("max_nas", "modal_len").alias("max_nas"),
        weighted_mean("modal_nas", "modal_len").alias("modal_nas"),
        F.sum("modal_len").alias("modal_len"),
        weighted_mean("tonnage_nas", "tonnage_len").alias("tonnage_nas"),
        F.sum("tonnage_len").alias("tonnage_len"),
    )
