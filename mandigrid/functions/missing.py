"""Missing values.

NaN, blanks and marker words become NULL once, where data enters; everything
after that tests for NULL only.
"""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from mandigrid.fixed_values import MISSING_MARKERS


def col(c):
    return F.col(c) if isinstance(c, str) else c


def nan_as_null(c) -> Column:
    return F.nanvl(col(c), F.lit(None).cast("double"))


def marker_as_null(c, markers=MISSING_MARKERS) -> Column:
    """Trimmed text, or NULL if it is blank or one of the marker words."""
    text = F.trim(col(c))
    return F.when(~text.isin(*markers), text)


def number(c) -> Column:
    """A double from text; anything unreadable (markers, blanks, NaN) is NULL."""
    return nan_as_null(col(c).try_cast("double"))


def zero_as_null(c) -> Column:
    return F.nullif(col(c), F.lit(0.0))


def has_tonnage(c="tonnage") -> Column:
    """Tonnage was reported and is not zero."""
    return F.coalesce(nan_as_null(c), F.lit(0.0)) != 0


def count_missing(c) -> Column:
    """Aggregate: how many rows have no value."""
    return F.count_if(col(c).isNull())


def normalise(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating-point column."""
    fractional = (T.DoubleType, T.FloatType)
    return df.withColumns({
        f.name: nan_as_null(f.name) for f in df.schema if isinstance(f.dataType, fractional)
    })
