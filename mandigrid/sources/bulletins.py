"""Bulletin files: headerless comma-separated lines of 9 to 13 fields."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from mandigrid.functions.dates import bulletin_date
from mandigrid.functions.missing import number
from mandigrid.schema import (
    BULLETIN_LAYOUTS, BULLETIN_NUMBERS, BULLETIN_TEXT, OLDER_LAYOUTS,
)

_LAYOUTS = {"current": BULLETIN_LAYOUTS, "older": OLDER_LAYOUTS}
# a field with the comma before it; quotes protect commas and double themselves
_FIELD = r',(\s*"(?:[^"]|"")*"\s*|[^,]*)'


def _fields(line):
    """The fields of a line; only lines with quotes take the slow way."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))
    unquoted = F.transform(quoted, lambda f: F.replace(
        F.btrim(f, F.lit('" ')), F.lit('""'), F.lit('"')))
    return F.when(F.contains(line, F.lit('"')), unquoted).otherwise(F.split(line, ",", -1))


def _pick(name, layouts):
    """The field called ``name``, wherever the row's width puts it.

    A name that a layout lists several times is joined back together.
    """
    fields, width = F.col("_fields"), F.size("_fields")
    out = None
    for n, columns in layouts.items():
        at = [i for i, column in enumerate(columns) if column == name]
        if not at:
            continue
        value = (fields[at[0]] if len(at) == 1
                 else F.concat_ws(" ", *[F.trim(fields[i]) for i in at]))
        out = F.when(width == n, value) if out is None else out.when(width == n, value)
    return F.lit(None).cast("string") if out is None else out


def parse_lines(lines: DataFrame, generation="current", column="value") -> DataFrame:
    """Rows of text to typed bulletin rows, batch or stream, in one pass.

    The layout is chosen for each row by its number of fields; rows of a width
    that no layout has are left out (``unreadable_lines`` returns them). They are left
    out while the line is taken apart: a filter would be pushed below that, and take
    each line apart a second time.
    """
    layouts = _LAYOUTS[generation]
    known = F.filter(F.array(_fields(F.col(column))), lambda f: F.size(f).isin(*layouts))
    split = lines.select(F.explode(known).alias("_fields"))
    date, *text = [(name, _pick(name, layouts)) for name in BULLETIN_TEXT]
    numbers = {name: number(_pick(name, layouts)) for name in BULLETIN_NUMBERS}
    return split.select(
        bulletin_date(date[1]).alias("date"),
        *[F.nullif(F.trim(c), F.lit("")).alias(name) for name, c in text],
        *[c.alias(name) for name, c in numbers.items()],
    )


def unreadable_lines(lines: DataFrame, generation="current", column="value") -> DataFrame:
    return lines.filter(~F.size(_fields(F.col(column))).isin(*_LAYOUTS[generation]))


def read_bulletins(spark, paths, generation="current") -> DataFrame:
    """All day files of a folder or pattern, stacked."""
    return parse_lines(spark.read.text(paths), generation)


def stream_bulletins(spark, path, generation="current", files_per_batch=None) -> DataFrame:
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_lines(reader.text(path), generation)


def stack(frames) -> DataFrame:
    """Frames on top of each other by column name; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drop_repeated_headers(df: DataFrame, headings) -> DataFrame:
    """Leave out rows in which any cell is one of the heading words."""
    cells = F.array(*[F.col(c).cast("string") for c in df.columns])
    return df.filter(~F.coalesce(F.exists(cells, lambda x: x.isin(*headings)), F.lit(False)))


def repair_split_name(df: DataFrame, parts, name="commodity") -> DataFrame:
    """Join a name that its own commas split over several columns."""
    whole = F.concat_ws(" ", *[F.trim(F.col(p)) for p in parts])
    return df.withColumn("_whole", whole).drop(*parts).withColumnRenamed("_whole", name)
