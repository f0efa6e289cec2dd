"""Daily market-bulletin analytics on Spark DataFrames.

Everything in this package is a function from DataFrames (or Columns) to
DataFrames (or Columns); nothing holds on to a session or collects a table.
"""

__version__ = "0.1.0"
