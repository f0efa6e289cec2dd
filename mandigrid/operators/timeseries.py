"""Series on a day axis: completion, filling, differences, resampling."""

from pyspark.sql import DataFrame, Window, functions as F

from mandigrid.fixed_values import AXIS_YEARS

SERIES = ["market", "commodity", "variety"]
ATTRIBUTES = ["state", "district", "taluk", "category", "commodity_translated"]


def _calendar(keys: DataFrame, start, end, step="1 day") -> DataFrame:
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"),
                      F.expr(f"interval {step}"))
    return keys.withColumn("date", F.explode(days))


def fill_dates(obs: DataFrame, start, end, series=SERIES) -> DataFrame:
    """Every series has a row for every day; measures of added days are NULL.

    Attributes are constant within a series, so they travel with the key table
    and no window is needed. Rows outside the range are kept as they are.

    The rows themselves are not shuffled by day: only the distinct days of each
    series are compared with the calendar, and the days it lacks are added. A day
    with a third of all rows is a single key there.
    """
    series = [c for c in series if c in obs.columns]
    attributes = [c for c in ATTRIBUTES if c in obs.columns and c not in series]
    keys = obs.groupBy(*series).agg(*[F.max(a).alias(f"_{a}") for a in attributes],
                                    F.count(F.lit(1)).alias("_n")).drop("_n")
    seen = obs.select(*series, "date").distinct()
    absent = _calendar(keys, start, end).join(seen, [*series, "date"], "left_anti").select(
        *series, "date", *[F.col(f"_{a}").alias(a) for a in attributes])
    if attributes:
        obs_columns = obs.columns
        obs = obs.join(keys, series, "left").select(*[
            F.coalesce(c, f"_{c}").alias(c) if c in attributes else F.col(c)
            for c in obs_columns])
    return obs.unionByName(absent, allowMissingColumns=True)


def complete_axis(df: DataFrame, axis, low, high, keys=()) -> DataFrame:
    """A row for every value low..high of an integer axis, per key."""
    axis_values = F.sequence(F.lit(low), F.lit(high))
    spark = df.sparkSession
    if keys:
        wanted = df.select(*keys).distinct().withColumn(axis, F.explode(axis_values))
    else:
        wanted = spark.range(low, high + 1).select(F.col("id").cast("int").alias(axis))
    return wanted.join(df, [*keys, axis], "full")


def complete_months(df, keys=()):
    return complete_axis(df, "month", 1, 12, keys)


def complete_years(df, keys=(), years=AXIS_YEARS):
    return complete_axis(df, "year", *years, keys)


def forward_fill(df: DataFrame, group, order, columns, chunk=100_000) -> DataFrame:
    """Blank cells take the last value above them, by ``order`` within ``group``.

    ``order`` is an explicit integer row number. A group of any length is cut into
    chunks of row numbers; each chunk's last values are carried across chunks on
    a summary of one row per chunk, and the chunks are filled in parallel.
    """
    group = [group] if isinstance(group, str) else list(group)
    columns = [columns] if isinstance(columns, str) else list(columns)
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    last = cut.groupBy(*group, "_chunk").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_last_{c}")
        for c in columns])
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = last.select(*group, "_chunk", *[
        F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns])
    within = Window.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0)
    # group columns may be NULL, and such rows form a group of their own
    a, b = cut.alias("a"), carried.alias("b")
    same = F.col("a._chunk").eqNullSafe(F.col("b._chunk"))
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    joined = a.join(b, same, "left").select(
        *[F.col(f"a.{c}") for c in cut.columns], *[F.col(f"b._carry_{c}") for c in columns])
    return joined.select(*[
        F.coalesce(F.last(c, ignorenulls=True).over(within), f"_carry_{c}").alias(c)
        if c in columns else F.col(c) for c in df.columns])


def carry_headers(cells: DataFrame, group, order, header, names) -> DataFrame:
    """Header lines label the lines after them and are themselves left out.

    ``header`` is a Column that holds on header lines; ``names`` maps each new
    column to the text it takes from them.
    """
    marked = cells.withColumns({n: F.when(header, c) for n, c in names.items()}
                               ).withColumn("_header", header)
    filled = forward_fill(marked, group, order, list(names))
    return filled.filter(~F.col("_header")).drop("_header")


def label_headings(lines: DataFrame, group, order, column="line", mark="#") -> DataFrame:
    """A list with ``#category`` heading lines as (category, commodity) rows."""
    text = F.trim(column)
    labelled = carry_headers(lines, group, order, text.startswith(mark),
                             {"category": F.substring(text, F.lit(2), F.length(text))})
    return labelled.filter(text != "").select(group, order, "category", text.alias("commodity"))


def daily_series(df: DataFrame, series, value, date="date") -> DataFrame:
    """One value per series and day: the mean of the day's values.

    After this a series has no more rows than its calendar has days, which is
    what lets the window operators below keep a series in one task.
    """
    return df.groupBy(*series, date).agg(F.avg(value).alias(value))


def interpolate(daily: DataFrame, series, value, date="date") -> DataFrame:
    """Gaps are filled linearly in elapsed time.

    Before the first value a gap stays open; after the last it holds that value.
    Expects one row per series and day.
    """
    # the next value is the last one seen from the other end: a growing frame is updated row by
    # row, while one that shrinks would be computed anew for each row
    upwards = Window.partitionBy(*series).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    downwards = Window.partitionBy(*series).orderBy(F.desc(date)).rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col(value).isNotNull(),
                   F.struct(F.col(date).alias("d"), F.col(value).alias("v")))
    marked = daily.withColumn("_p", point)
    before = F.last("_p", ignorenulls=True).over(upwards)
    after = F.last("_p", ignorenulls=True).over(downwards)
    spanned = marked.withColumns({"_b": before, "_a": after})
    share = F.try_divide(F.datediff(date, "_b.d"), F.datediff("_a.d", "_b.d"))
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * share
    filled = F.coalesce(F.col(value), line, F.col("_b.v"))
    return spanned.select(*[filled.alias(c) if c == value else F.col(c) for c in daily.columns])


def difference(daily: DataFrame, series, value, date="date") -> DataFrame:
    """Change against the series' previous row; NULL on the first."""
    ordered = Window.partitionBy(*series).orderBy(date)
    return daily.withColumn("diff", F.col(value) - F.lag(value).over(ordered))


UNITS = {"day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def resample(df: DataFrame, series, unit, date="date") -> DataFrame:
    """Mean price and summed tonnage per series and day, week, month, quarter or year."""
    measures = []
    for price in ("price", "modal_price"):
        if price in df.columns:
            measures.append(F.avg(price).alias(price))
    if "tonnage" in df.columns:
        measures.append(F.sum("tonnage").alias("tonnage"))
    start = F.date_trunc(UNITS[unit], F.col(date)).cast("date")
    return df.groupBy(*series, start.alias(date)).agg(*measures)


def long_form(df: DataFrame, ids, values, name="measure", value="value") -> DataFrame:
    return df.unpivot(ids, values, name, value)
