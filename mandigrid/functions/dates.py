"""Dates, day counts and rounding."""

from pyspark.sql import Column, functions as F

from mandigrid.fixed_values import CENTURY_PIVOT
from mandigrid.functions.missing import col


def bulletin_date(c) -> Column:
    """dd/mm/YYYY, else ISO, else NULL."""
    c = F.trim(col(c))
    return F.coalesce(F.try_to_timestamp(c, F.lit("dd/MM/yyyy")).cast("date"),
                      F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))


def prepend_century(yy) -> Column:
    """Two-digit years from 59 are of the last century."""
    yy = col(yy).cast("int")
    return F.when(yy.between(CENTURY_PIVOT, 99), yy + 1900).otherwise(yy + 2000)


def established(c) -> Column:
    """Year of establishment as a date, from one to four digits; 0 is unknown."""
    text = F.trim(col(c))
    value = text.try_cast("int")
    digits = F.length(value.cast("string"))
    year = (F.when(value == 0, None)
            .when(digits == 1, value + 2000)
            .when(digits == 2, prepend_century(value))
            .when(digits == 3, value * 10)
            .when(digits == 4, value))
    return F.when(year.isNotNull(), F.make_date(year, F.lit(1), F.lit(1)))


def day_count(start, end) -> Column:
    return F.datediff(col(end), col(start))


def month_span_days(first, last) -> Column:
    """Days from the first of the first month to the end of the last month."""
    return F.datediff(F.last_day(col(last)), F.trunc(col(first), "MM")) + 1


def round_percent(x) -> Column:
    """To a whole percent, halves up."""
    return F.floor(col(x) + 0.5)


def percent(part, whole) -> Column:
    return F.try_divide(col(part) * 100.0, col(whole))


def add_year_month(df, date="date"):
    return df.withColumns({"year": F.year(date), "month": F.month(date)})
