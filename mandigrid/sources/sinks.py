"""Writers. Executors write their own partitions; nothing passes the driver."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from mandigrid.operators.relational import keep_one


def write_rollup(df: DataFrame, path, partitions=("level", "commodity"), rebalance=True):
    """Replace just the (level, commodity) partitions that ``df`` holds.

    Rows are rebalanced by partition before the write: small partitions end up in
    one file each, and one with a third of the rows is split over many tasks. Without
    ``rebalance`` every task writes a file to each partition that it has rows of.
    """
    ((df.hint("rebalance", *partitions) if rebalance else df)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partitions).parquet(path))


def round_fractions(df: DataFrame, decimals=3) -> DataFrame:
    fractional = (T.DoubleType, T.FloatType)
    return df.withColumns({f.name: F.round(f.name, decimals) for f in df.schema
                           if isinstance(f.dataType, fractional)})


def write_csv_report(df: DataFrame, path, decimals=3, replace=True):
    """Rounded CSV with a heading; an existing report stays unless replaced."""
    (round_fractions(df, decimals)
     .write.mode("overwrite" if replace else "ignore").option("header", True).csv(path))


def append_documents(df: DataFrame, path, key=None, partitions=()):
    """Append rows; with a key, rows whose key is stored already are left out.

    Of rows with the same key the first in order stays. NULL is a value like others in a key.
    """
    if key:
        df = without_stored(keep_one(df, list(key)), existing(df.sparkSession, path), key)
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def without_stored(df: DataFrame, stored: DataFrame | None, key) -> DataFrame:
    """Rows of ``df`` whose key is not in ``stored``; NULLs are equal."""
    if stored is None:
        return df
    known = stored.select(*[F.col(k).alias(f"_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return df.join(known, same, "left_anti")


def existing(spark, path, schema=None) -> DataFrame | None:
    """The table below ``path``, None if there is none yet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def point_features(markets: DataFrame) -> DataFrame:
    """One GeoJSON point per market, as JSON text; missing values are null."""
    properties = F.struct(*[F.col(c) for c in (
        "name", "state", "district", "taluk", "regulated", "established")
        if c in markets.columns])
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array("lng", "lat").alias("coordinates")).alias("geometry"),
        F.col("id"),
        properties.alias("properties"),
    )
    return markets.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_point_features(markets: DataFrame, path):
    """Newline-delimited features, readable by GeoJSON tools line by line."""
    point_features(markets).write.mode("overwrite").text(path)


# Features of one FeatureCollection.
_FEATURES = 10_000


def write_feature_collection(markets: DataFrame, path):
    """FeatureCollections as JSON texts, one a line, each of at most ``_FEATURES`` features.

    Rows are numbered within their partition, so no collection holds a whole one. Where a
    single envelope is asked for, the reader joins the features.
    """
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the row in the lower 33
    text = point_features(markets).withColumn("part", F.floor(at / F.lit(_FEATURES)))
    text = text.withColumn("task", F.spark_partition_id())
    (text.groupBy("task", "part").agg(F.array_join(F.collect_list("value"), ",").alias("features"))
     .select(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "features", F.lit("]}")))
     .write.mode("overwrite").text(path))
