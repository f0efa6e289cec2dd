"""Arriving day files: clean, locate, drop repeats, append; and refresh roll-ups."""

from pyspark.sql import DataFrame, functions as F, types as T

from mandigrid.operators import rollup
from mandigrid.operators.changes import changes
from mandigrid.operators.relational import keep_one
from mandigrid.plans.bulletins import clean_bulletins, integrate_bulletins
from mandigrid.session import materialise
from mandigrid.sources.sinks import existing, without_stored

KEY = ["date", "state", "market", "commodity", "variety", "grade"]


def ingest(bulletins: DataFrame, locations: DataFrame = None) -> DataFrame:
    """The batch cleaning steps on a stream (without the whole-commodity variety rule)."""
    clean = clean_bulletins(bulletins, variety_rule=False)
    return clean if locations is None else integrate_bulletins(clean, locations)


def _prunable(dates: DataFrame) -> DataFrame:
    """Dates with a condition that all meet: only a side that is filtered lets Spark skip the
    partitions of the other side that it doesn't name."""
    return dates.filter(F.col("date") >= F.lit("0001-01-01").cast("date"))


def rows_of_dates(stored: DataFrame, dates: DataFrame) -> DataFrame:
    """The stored rows of some dates, and of none: those without a date have a partition of their
    own. Partitions of other dates are not read."""
    dated = stored.join(_prunable(dates), "date", "left_semi")
    return dated.unionByName(stored.filter(F.col("date").isNull()))


def append_new(arrivals: DataFrame, store, key, checkpoint):
    """Append the rows whose key is not stored yet, however late they arrive.

    What is stored is the memory: the stream keeps no state and drops nothing. Every
    micro-batch leaves out the keys that stand in the store for its dates, whichever stream
    or run wrote them. A batch that is replayed after a failure finds what it wrote before
    and adds the rest; several streams may follow each other into one store, each with a
    checkpoint of its own (at the same time they could both add a key that is new to both).
    """
    key = list(key)

    def add(batch: DataFrame, number: int):
        fresh = keep_one(batch, key)
        stored = existing(batch.sparkSession, store, batch.schema)
        if stored is not None:
            fresh = without_stored(fresh, rows_of_dates(stored, batch.select("date").distinct()), key)
        fresh.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(store)

    return (arrivals.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _stream_id(spark, checkpoint) -> str:
    """The id that Spark gives a checkpoint: a new checkpoint has a new one."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


ROLLUP_KEY = ["level", "date", "commodity", "category", "state", "district"]


class RollupStore:
    """Roll-ups that grow with every batch, kept by mergeable partials.

    Below ``path``: ``partials`` (one row for each market's day and batch), ``rollups`` by date,
    and ``feed``, the changes that each batch made to the roll-ups. Bulletin rows themselves
    are not kept: a touched date is made again from its markets' partials.

    A batch has a name and its own partitions everywhere, so a batch that is repeated after a
    failure replaces what it wrote before and adds nothing. Its changes are written before the
    roll-ups they lead to, and only once: a repeated batch, which may find roll-ups of its own,
    leaves a finished feed alone. One writer at a time.
    """

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def _table(self, name) -> DataFrame | None:
        schemas = {"partials": _PARTIALS, "rollups": _ROLLUPS, "feed": _FEED}
        return existing(self.spark, f"{self.path}/{name}", T.StructType.fromDDL(schemas[name]))

    def _write(self, rows: DataFrame, name, *partitions):
        (rows.hint("rebalance", *partitions).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
         .parquet(f"{self.path}/{name}"))

    def add(self, batch: DataFrame, name: str, number: int = 0):
        """Merge a batch of bulletins; ``number`` puts the batches' changes in order."""
        partials = rollup.market_partials(batch).withColumns({
            "batch": F.lit(name), "covers": F.array(F.lit(name))})
        self._write(partials, "partials", "date", "batch")
        every = self._table("partials")
        if every is None:
            return  # nothing has arrived yet
        touched = every.filter(F.col("batch") == name).select("date").distinct()
        markets = rollup.merge_partials(self.partials_of(touched))
        new = materialise(rollup.rollup_all_levels(markets), "touched-rollups")
        self._publish(new, touched, name, number)
        self._write(new, "rollups", "date")

    def partials_of(self, dates: DataFrame) -> DataFrame:
        """The partials of some dates that count: not those that a merged batch covers."""
        rows = rows_of_dates(self._table("partials"), dates)
        merged = rows.filter(F.size("covers") > 1).select("date", "batch", "covers").distinct().select(
            F.col("date").alias("_d"), F.explode("covers").alias("_b"), F.col("batch").alias("_by"))
        covered = (F.col("date").eqNullSafe(F.col("_d")) & (F.col("batch") == F.col("_b"))
                   & (F.col("batch") != F.col("_by")))
        return rows.join(merged, covered, "left_anti")

    def merge(self, name: str):
        """Put the partials of each date into one batch, ``name``. What it covers stays until it
        is removed by hand, but counts no more."""
        every = self._table("partials")
        rows = self.partials_of(every.select("date").distinct())
        names = rows.select("date", F.explode("covers").alias("b")).groupBy("date").agg(
            F.sort_array(F.collect_set("b")).alias("covers"))
        names = names.withColumns({"covers": F.concat("covers", F.array(F.lit(name))), "batch": F.lit(name)})
        added = rollup.add_partials(rows).withColumnRenamed("date", "_d")
        out = added.join(names, F.col("_d").eqNullSafe(F.col("date"))).drop("_d")
        # the partitions it replaces are left until the new ones are complete
        self._write(out, "partials", "date", "batch")

    def _publish(self, new, touched, name, number):
        feed = self._table("feed")
        if feed is not None and not feed.filter(F.col("batch") == name).isEmpty():
            return
        old = self._table("rollups")
        old = new.limit(0) if old is None else rows_of_dates(old, touched).select(*new.columns)
        found = changes(old, new, ROLLUP_KEY).withColumns({
            "number": F.lit(number).cast("long"), "batch": F.lit(name)})
        self._write(found, "feed", "batch")

    def rollups(self) -> DataFrame:
        return self._table("rollups")

    def feed(self) -> DataFrame:
        return self._table("feed")


_MEASURES = "price double, tonnage double, contrib long"
_ROLLUPS = f"level string, date date, commodity string, category string, state string, district string, {_MEASURES}"
_FEED = f"change string, {_ROLLUPS}, number long, batch string"
_PARTIALS = ("date date, state string, district string, market string, commodity string, taluk string, category string,"
             " p_sum double, p_n long, tonnage double, covers array<string>, batch string")


def refresh_rollups(arrivals: DataFrame, path, checkpoint):
    """Merge each micro-batch into the ``RollupStore`` at ``path``.

    A batch has the checkpoint's id and its number for a name, so one that is replayed after
    a failure counts once, and one of another stream or a new checkpoint for itself. The
    stream keeps no aggregation state.
    """
    def update(batch: DataFrame, number: int):
        spark = batch.sparkSession
        RollupStore(spark, path).add(batch, f"{_stream_id(spark, checkpoint)}-{number}", number)

    return (arrivals.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
