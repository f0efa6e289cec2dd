"""All statistics reports of a bulletin table."""

from pyspark.sql import DataFrame

from mandigrid.operators import quality
from mandigrid.session import shared_dir

_TIMES = {"": [], "_year-month": ["year", "month"], "_year": ["year"], "_month": ["month"]}


def compute_statistics(obs: DataFrame, start, end, store=None) -> dict:
    """Report name -> lazy DataFrame, for all commodities at once.

    The bulletins are read once, for a table of market months: counts, tonnage and
    the month's days as a bitmap. It and the months of the states, made of it, are
    written to the shared folder, where they also outlive a lost executor; every
    report comes from one of the two.
    """
    spark = obs.sparkSession
    store = store or shared_dir(spark, "statistics")

    def stored(df, name):
        df.write.parquet(f"{store}/{name}")
        return spark.read.parquet(f"{store}/{name}")

    months = stored(quality.months_of_days(
        quality.market_days(obs), ["state", "district", "market"]), "market_months")
    by_state = stored(quality.months_of_months(months, ["state"]), "state_months")

    reports = {"nas_by_commodity": quality.missing_total_in_days(by_state)}
    for suffix, time in _TIMES.items():
        reports[f"nas_by_state{suffix}"] = quality.missing_in_days(by_state, ["state"], time)
        if time:
            reports[f"nas_by{suffix}"] = quality.missing_in_days(by_state, (), time)
    for name, units in (("tonnage", []), ("tonnage_by_state", ["state"])):
        reports[name] = quality.tonnage_of_days(by_state, units)
        reports[f"{name}_month_mean"] = quality.tonnage_month_mean_of_days(by_state, units)
    for name, report in quality.coverage_reports(months, start, end, by_state).items():
        reports[f"coverage_by_{name}"] = report
    return reports


_MEASURES = {"nas": quality.MISSING, "tonnage": ["tonnage"], "coverage": ["coverage"]}


def combine_statistics(reports: dict) -> dict:
    """Each report summed (coverage: averaged) over commodities as well."""
    out = {}
    for name, report in reports.items():
        kind = name.split("_")[0]
        columns = [c for c in _MEASURES[kind] if c in report.columns]
        keys = [c for c in report.columns if c not in ("category", "commodity", *_MEASURES[kind])]
        if "category" not in report.columns or not keys:
            continue
        sums, means = (([], columns) if kind == "coverage" else (columns, []))
        out[name] = quality.combine_commodities(report, keys, sums, means)
    return out
