"""Selections, ranges, de-duplication and ordered reads."""

from pyspark.sql import DataFrame, functions as F

from mandigrid.fixed_values import DEFAULT_THRESHOLDS, OUTLIER_PRICE


def find(df: DataFrame, **equals) -> DataFrame:
    for name, value in equals.items():
        df = df.filter(F.col(name) == value)
    return df


def find_sorted(df, by, ascending=True, **equals) -> DataFrame:
    return find(df, **equals).orderBy(F.col(by).asc() if ascending else F.col(by).desc())


def find_sorted_limited(df, by, n, ascending=True, **equals) -> DataFrame:
    return find_sorted(df, by, ascending, **equals).limit(n)


def find_slice(df, by, start, stop, **equals) -> DataFrame:
    """Rows start..stop-1 in the order of ``by`` (a total order, or ties are open)."""
    ordered = find(df, **equals).orderBy(*([by] if isinstance(by, str) else by))
    return ordered.offset(start).limit(stop - start)


def date_range(df, start, end, date="date") -> DataFrame:
    """start <= date < end"""
    d = F.col(date)
    return df.filter((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date")))


def selected_commodities(df, selection: DataFrame) -> DataFrame:
    """Rows whose (category, commodity) is on the selection list."""
    return df.join(selection, ["category", "commodity"], "left_semi")


def price_outliers(df, above=OUTLIER_PRICE, price="modal_price", **equals) -> DataFrame:
    return find(df, **equals).filter(F.col(price) > above)


def within_thresholds(df, missing_prices=DEFAULT_THRESHOLDS["missing_prices"],
                      missing_tonnages=DEFAULT_THRESHOLDS["missing_tonnages"],
                      coverage=DEFAULT_THRESHOLDS["coverage"]) -> DataFrame:
    """All three comparisons are strict, so a unit without any price is dropped."""
    return df.filter((F.col("missing_prices") < missing_prices)
                     & (F.col("missing_tonnages") < missing_tonnages)
                     & (F.col("coverage") > coverage))


def with_values(df, n=None) -> DataFrame:
    """Rows with at least ``n`` values, or with any value at all."""
    return df.dropna(how="all") if n is None else df.dropna(thresh=n)


def exclude_row(df, market, regulated="regulated") -> DataFrame:
    """Leave out the regulated record of one market that was entered twice."""
    return df.filter((F.col("market") != market) | ~F.col(regulated))


def keep_one(df, key, order=None) -> DataFrame:
    """One row per key, the same one on every run.

    The smallest row counts, by ``order`` and then by all columns. This is an
    aggregate with map-side combining, so a key with very many rows is never
    gathered in one task.
    """
    key = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    first = list(order or [])
    ranked = F.struct(*first, *[c for c in rest if c not in first])
    return (df.groupBy(*key).agg(F.min(ranked).alias("_r"))
            .select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns]))


def keep_last(df, key, order) -> DataFrame:
    """The row with the highest ``order`` per key (then the largest row)."""
    key = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in key]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    return (df.groupBy(*key).agg(F.max(ranked).alias("_r"))
            .select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns]))


def any_of(df, column, values, **equals) -> DataFrame:
    """Union of selections: the column equals any of the values."""
    return find(df, **equals).filter(F.col(column).isin(*values))


def only_in_first(first: DataFrame, second: DataFrame, on) -> DataFrame:
    """Distinct names of the first source that the second does not have."""
    on = [on] if isinstance(on, str) else list(on)
    return first.select(*on).distinct().join(second.select(*on).distinct(), on, "left_anti")


def keep_matching(df: DataFrame, kept: DataFrame, on) -> DataFrame:
    on = [on] if isinstance(on, str) else list(on)
    return df.join(kept.select(*on), on, "left_semi")
