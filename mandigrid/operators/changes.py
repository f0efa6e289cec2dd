"""What is different between two versions of a table, and a version made from the differences."""

from pyspark.sql import DataFrame, functions as F


def _row_hash(columns):
    """128 bits over all values; NULL differs from every value."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    return F.xxhash64(*parts), F.xxhash64(F.lit("again"), *reversed(parts))


def changes(old: DataFrame, new: DataFrame, key) -> DataFrame:
    """Rows added, changed and removed: ``change`` and the new row, or of a removed row its key.

    ``key`` names the columns that identify a row in both versions; NULL is a value like
    others in a key. Rows are compared by a hash of the other columns, so a version is
    shuffled once, by key, and with few columns if Spark can join by hash.
    """
    key, values = list(key), [c for c in new.columns if c not in key]
    first, second = _row_hash(values)

    def side(df, name):
        same = F.struct(first.alias("a"), second.alias("b")).alias("hash")
        kept = df.select(*key, same) if name == "_o" else df.select(*key, *values, same)
        return kept.withColumnsRenamed({c: f"{name}_{c}" for c in (*key, "hash")})

    pairs = side(old, "_o").join(side(new, "_n"), [
        F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in key], "full")
    change = (F.when(F.col("_o_hash").isNull(), "added").when(F.col("_n_hash").isNull(), "removed")
              .when(F.col("_o_hash") != F.col("_n_hash"), "changed"))
    removed = F.col("_n_hash").isNull()
    rows = pairs.withColumn("change", change).filter(F.col("change").isNotNull())
    return rows.select("change", *[F.when(removed, F.col(f"_o_{k}")).otherwise(F.col(f"_n_{k}"))
                                   .alias(k) for k in key], *values)


def replay(old: DataFrame, feed: DataFrame, key, order) -> DataFrame:
    """The version that ``feed`` leads to from ``old``: of each key its last change counts.

    ``order`` is the column of the feed that puts changes of a key in order.
    """
    key = list(key)
    columns = old.columns
    row = F.struct("change", *[F.col(c) for c in columns]).alias("row")
    last = feed.groupBy(*key).agg(F.max_by(row, F.col(order)).alias("row"))
    same = [old[k].eqNullSafe(F.col(f"row.{k}")) for k in key]
    kept = old.join(last.select("row"), same, "left_anti")
    made = last.filter(F.col("row.change") != "removed").select(*[F.col(f"row.{c}") for c in columns])
    return kept.unionByName(made)
