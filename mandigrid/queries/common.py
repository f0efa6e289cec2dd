"""How query results and their SQL twins are written down so that they compare equal.

Dates and arrays become text. Fractions are snapped to the nearest 1/65536: sums
taken in another order differ in their last bits, and unlike a decimal place this
grid has practically no ties for such a difference to decide.
"""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

GRID = 65536.0


def snap(c):
    return F.floor(c * GRID + 0.5).cast("double") / GRID


def present(df: DataFrame) -> DataFrame:
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = snap(c)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def s(x):
    """SQL: a fraction on the grid."""
    return f"floor(({x}) * 65536.0 + 0.5) / 65536.0"


def d(x):
    """SQL: a date as text."""
    return f"CAST(CAST({x} AS DATE) AS VARCHAR)"


def n(x):
    return f"CAST({x} AS BIGINT)"


def names(x):
    """SQL: distinct values in order, as text."""
    return f"string_agg(DISTINCT {x}, ',' ORDER BY {x})"


OBS = """obs AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
         r_name AS state, n_name AS district, s_name AS market,
         CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'BASIC' ELSE 'SPECIAL' END AS category,
         p_type AS commodity, p_brand AS variety,
         CASE WHEN l_tax = 0.08 THEN NULL
              ELSE l_extendedprice / l_quantity * (1 - l_discount) END AS min_price,
         CASE WHEN l_tax = 0.08 THEN NULL
              ELSE l_extendedprice / l_quantity * (1 + l_tax) END AS max_price,
         CASE WHEN l_tax = 0.08 THEN NULL ELSE l_extendedprice / l_quantity END AS modal_price,
         CASE WHEN l_discount = 0.10 THEN NULL ELSE l_quantity END AS tonnage
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)"""

MARKET = OBS + """,
mk AS (
  SELECT period AS date, state, district, market, commodity, min(category) AS category,
         avg(modal_price) AS price, max(tonnage) AS tonnage
  FROM obs GROUP BY period, state, district, market, commodity)"""

_W = ("sum(price * tonnage) / nullif(sum(CASE WHEN price IS NOT NULL THEN tonnage END), 0)")


def level_cte(name, *keys):
    cols = ", ".join(["date", *keys, "commodity"])
    return f"""{name} AS (
  SELECT {cols}, min(category) AS category, {_W} AS price, sum(tonnage) AS tonnage,
         count(*) AS contrib, count(DISTINCT market) AS n_markets
  FROM mk WHERE tonnage IS NOT NULL AND tonnage <> 0 GROUP BY {cols})"""


DISTRICT = MARKET + ",\n" + level_cte("district_rows", "state", "district")
STATE = MARKET + ",\n" + level_cte("state_rows", "state")
INDIA = MARKET + ",\n" + level_cte("india_rows")
LEVELS = (DISTRICT + ",\n" + level_cte("state_rows", "state") + ",\n" + level_cte("india_rows")
          + """,
levels AS (
  SELECT 'district' AS level, date, commodity, state, district, category, price, tonnage, contrib
  FROM district_rows UNION ALL
  SELECT 'state', date, commodity, state, NULL, category, price, tonnage, contrib
  FROM state_rows UNION ALL
  SELECT 'india', date, commodity, NULL, NULL, category, price, tonnage, contrib
  FROM india_rows)""")
