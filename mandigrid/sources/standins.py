"""Benchmark tables read as market bulletins.

region > nation > supplier stands in for state > district > market, part type
and brand for commodity and variety, order lines for bulletin rows. The tables
have no missing values, so two columns decide where one is.
"""

from pyspark.sql import DataFrame, functions as F


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_places(lines: DataFrame, spark, sf_dir) -> DataFrame:
    """Order lines with market, district and state.

    The supplier table is joined as it is read: the estimated size of a join is far
    too high and would hide from the optimizer that this side is small.
    """
    supplier = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_nationkey", F.col("s_name").alias("market"))
    return _with_district(lines.join(supplier, lines.l_suppkey == supplier.s_suppkey),
                          spark, sf_dir)


def documents(spark, sf_dir, *columns) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def districts(spark, sf_dir) -> DataFrame:
    """The 25 nations with their regions; these two tables have a fixed size."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("district"), F.col("r_name").alias("state"))


def _with_district(df, spark, sf_dir):
    return df.join(F.broadcast(districts(spark, sf_dir)),
                   F.col("s_nationkey") == F.col("n_nationkey"))


def places(spark, sf_dir) -> DataFrame:
    """suppkey, market, district, state."""
    return _with_district(table(spark, sf_dir, "supplier"), spark, sf_dir).select(
        "s_suppkey", F.col("s_name").alias("market"), "district", "state")


def observations(spark, sf_dir) -> DataFrame:
    """One bulletin row per order line.

    The supplier and part sides grow with the data, so the way they are joined
    is left to the optimizer.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_shipdate")
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("commodity"), F.col("p_brand").alias("variety"))
    joined = with_places(lines, spark, sf_dir).join(part, lines.l_partkey == part.p_partkey)
    price = F.when(F.col("l_tax") != 0.08, F.col("l_extendedprice") / F.col("l_quantity"))
    date = F.col("l_shipdate").cast("date")
    return joined.select(
        date.alias("date"),
        F.trunc(date, "MM").alias("period"),
        "state", "district", "market",
        F.when(F.col("commodity").isin("ECONOMY", "STANDARD"), "BASIC").otherwise("SPECIAL")
        .alias("category"),
        "commodity", "variety",
        (price * (1 - F.col("l_discount"))).alias("min_price"),
        (price * (1 + F.col("l_tax"))).alias("max_price"),
        price.alias("modal_price"),
        F.when(F.col("l_discount") != 0.10, F.col("l_quantity")).alias("tonnage"),
    )


def monthly(spark, sf_dir) -> DataFrame:
    """Bulletin rows dated by month, so that several rows fall into one group."""
    return observations(spark, sf_dir).drop("date").withColumnRenamed("period", "date")


def day_prices(spark, sf_dir) -> DataFrame:
    """Events as priced day records: user is the market, event type the commodity."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("ts").cast("date").alias("date"),
        F.col("user_id").cast("string").alias("market"),
        F.col("event_type").alias("commodity"),
        "event_id",
        F.col("value").alias("modal_price"),
    )
