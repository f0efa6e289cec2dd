"""A table that several writers append to at the same time, with one row for each key.

Below its folder, ``rows`` holds the batches, by date and batch, and ``log`` numbered entries
that each name a batch. A batch counts when it is in the log. An entry is created only if its
number is free, so of two writers that saw the same table one comes second: it looks at what
the other added and tries again with the next number.
"""

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, functions as F

from mandigrid.operators.relational import keep_one
from mandigrid.session import materialise
from mandigrid.sources.sinks import existing, without_stored

# Seconds after which an entry without a name is one whose writer was lost.
_PATIENCE = 60


class CommittedTable:
    def __init__(self, spark, path, schema):
        """``schema`` of the rows, with a column ``date``."""
        self.spark, self.path = spark, path
        self.schema = type(schema)([*schema.fields]).add("batch", "string")

    def _entries(self) -> dict[int, str]:
        """Number and batch of each entry; a batch is one small row."""
        while True:
            files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.commit")
            try:
                found = files.load(f"{self.path}/log").select(
                    F.regexp_extract("path", r"(\d+)\.commit$", 1).cast("long").alias("number"),
                    F.decode("content", "UTF-8").alias("batch"), "modificationTime").collect()
            except Exception as error:
                if "PATH_NOT_FOUND" in str(error):
                    return {}
                raise
            begun = [r for r in found if not r["batch"]
                     and r["modificationTime"].timestamp() > time.time() - _PATIENCE]
            if not begun:
                return {r["number"]: r["batch"] for r in found}
            time.sleep(0.2)

    def _create(self, number: int, batch: str) -> bool:
        """Whether the entry was free and is ours now."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{number:012d}.commit")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            out = files.create(path, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        out.write(bytearray(batch.encode()))
        out.close()
        return True

    def read(self, entries: dict[int, str] = None) -> DataFrame:
        """The rows of all batches in the log (or among ``entries``)."""
        names = sorted({b for b in (self._entries() if entries is None else entries).values() if b})
        rows = existing(self.spark, f"{self.path}/rows", self.schema)
        if rows is None:
            return self.spark.createDataFrame([], self.schema).drop("batch")
        named = self.spark.createDataFrame([(n,) for n in names], "batch string")
        return rows.join(named, "batch", "left_semi").drop("batch")

    def append(self, batch: DataFrame, key, name: str, meanwhile=None) -> int:
        """Add the rows of ``batch`` whose key is new, and return the entry's number.

        A batch of the same ``name`` that is in the log already adds nothing. ``meanwhile``
        is called between reading and committing (for tests).
        """
        key = list(key)
        fresh, attempt = materialise(keep_one(batch, key), "arrivals"), 0
        while True:
            entries = self._entries()
            done = [n for n, b in entries.items() if b and b.rsplit("~", 1)[0] == name]
            if done:
                return done[0]
            dates = fresh.select("date").distinct()
            stored = self.read(entries)
            known = stored.join(dates, stored["date"].eqNullSafe(dates["date"]), "left_semi")
            label = f"{name}~{attempt}"
            (without_stored(fresh, known, key).withColumn("batch", F.lit(label)).hint("rebalance", "date")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("date", "batch").parquet(f"{self.path}/rows"))
            if meanwhile is not None and attempt == 0:
                meanwhile()
            number = max(entries, default=0) + 1
            if self._create(number, label):
                return number
            attempt += 1  # another writer was first


def append_shared(arrivals: DataFrame, path, key, checkpoint):
    """Append a stream's rows whose key is new to a table that other streams append to as well.

    A replayed batch has its name in the log and adds nothing.
    """
    def add(batch: DataFrame, number: int):
        spark = batch.sparkSession
        ident = spark.read.text(f"{checkpoint}/metadata").select(
            F.get_json_object("value", "$.id")).first()[0]
        CommittedTable(spark, path, batch.schema).append(batch, key, f"{ident}-{number}")

    return (arrivals.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
