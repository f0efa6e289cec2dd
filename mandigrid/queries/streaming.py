"""Streams that are run to the end of their input and then read back.

The tables are read by a streaming file source; results and checkpoints go to the
session's shared folder.
"""

from pyspark.sql import DataFrame, functions as F

from mandigrid.operators.changes import changes, replay
from mandigrid.operators.rollup import rollup_all_levels, rollup_varieties
from mandigrid.queries.common import LEVELS, d, n, present, s
from mandigrid.session import materialise, shared_dir
from mandigrid.sources.commits import CommittedTable, append_shared
from mandigrid.sources.standins import table, with_places
from mandigrid.streaming.ingest import (
    ROLLUP_KEY, RollupStore, append_new, ingest, refresh_rollups,
)


def _stream(spark, sf_dir, name) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(sf_dir))


def stream_ingest(spark, sf_dir):
    """Day prices: cleaned, one row per market, commodity and day, appended."""
    events = _stream(spark, sf_dir, "events")
    rows = events.select(
        F.col("ts").cast("date").alias("date"), F.lit(" Orissa ").alias("state"),
        F.concat(F.lit(" M"), "user_id").alias("market"),
        F.when(F.col("event_type") == "view", "Soanf").otherwise(F.col("event_type"))
        .alias("commodity"), F.lit("Other").alias("variety"))
    clean = ingest(rows)
    base = shared_dir(spark, "ingest")
    key = ["date", "state", "market", "commodity", "variety"]
    append_new(clean, f"{base}/rows", key, f"{base}/state").awaitTermination()
    return present(spark.read.parquet(f"{base}/rows"))


def shared_ingest(spark, sf_dir):
    """Two streams that append the same events to one table at the same time."""
    base, key = shared_dir(spark, "shared"), ["date", "market", "commodity"]
    rows = _stream(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("date"), F.col("user_id").alias("market"),
        F.col("event_type").alias("commodity"))
    started = [append_shared(rows, f"{base}/table", key, f"{base}/state-{i}") for i in (1, 2)]
    for stream in started:
        stream.awaitTermination()
    return present(CommittedTable(spark, f"{base}/table", rows.schema).read())


def _bulletins(lines, spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("commodity"), F.col("p_brand").alias("variety"))
    return (with_places(lines, spark, sf_dir)
            .join(part, F.col("l_partkey") == F.col("p_partkey"))).select(
        F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("date"), "state", "district",
        "market", F.when(F.col("commodity").isin("ECONOMY", "STANDARD"), "BASIC")
        .otherwise("SPECIAL").alias("category"), "commodity", "variety",
        F.when(F.col("l_tax") != 0.08, F.col("l_extendedprice") / F.col("l_quantity"))
        .alias("modal_price"),
        F.when(F.col("l_discount") != 0.10, F.col("l_quantity")).alias("tonnage"))


def stream_rollup(spark, sf_dir):
    """Order lines arriving as bulletins; the roll-ups of touched months are renewed."""
    rows = _bulletins(_stream(spark, sf_dir, "lineitem"), spark, sf_dir)
    base = shared_dir(spark, "refresh")
    refresh_rollups(rows, f"{base}/store", f"{base}/state").awaitTermination()
    return present(RollupStore(spark, f"{base}/store").rollups())


def _three_batches(spark, sf_dir):
    """A store that orders came to in three parts, the first two merged, the last repeated as if
    after a failure; and its roll-ups after the first part."""
    base, lines = shared_dir(spark, "batches"), table(spark, sf_dir, "lineitem")
    store, arrived = RollupStore(spark, f"{base}/store"), spark.readStream.schema(lines.schema)
    part = F.pmod("l_orderkey", F.lit(3))
    for k in range(3):
        lines.filter(part == k).write.mode("append").parquet(f"{base}/in")
        rows = _bulletins(arrived.parquet(f"{base}/in"), spark, sf_dir)
        refresh_rollups(rows, store.path, f"{base}/state").awaitTermination()
        if k == 0:
            first = materialise(store.rollups(), "first-rollups")
        if k == 1:
            store.merge("merged")
    last = store.feed().agg(F.max_by("batch", "number")).first()[0]
    store.add(_bulletins(lines.filter(part == 2), spark, sf_dir), last, 2)
    return store, first


def stream_partials(spark, sf_dir):
    """Roll-ups after three batches, a merge of partials and a replay."""
    return present(_three_batches(spark, sf_dir)[0].rollups())


def rollup_feed(spark, sf_dir):
    """The roll-ups of the first batch, brought up to date by the feed of the others."""
    store, first = _three_batches(spark, sf_dir)
    return present(replay(first, store.feed().filter("number > 0"), ROLLUP_KEY, "number"))


_ROWS = [*ROLLUP_KEY, "price", "tonnage", "contrib"]


def rollup_changes(spark, sf_dir):
    """Two versions of the roll-ups, without the orders of two different kinds, compared."""
    lines, part = table(spark, sf_dir, "lineitem"), F.pmod("l_orderkey", F.lit(9))
    old, new = (present(rollup_all_levels(rollup_varieties(_bulletins(rows, spark, sf_dir)))).select(*_ROWS)
                for rows in (lines.filter(part < 6), lines.filter(part > 1)))
    return changes(old, new, ROLLUP_KEY)


def _levels_sql(condition):
    return LEVELS.replace("FROM lineitem\n", f"FROM (SELECT * FROM lineitem WHERE {condition}) lineitem\n")


_LEVEL_ROWS = f"""SELECT level, {d('date')} AS date, commodity, category, state, district,
       {s('price')} AS price, {s('tonnage')} AS tonnage, {n('contrib')} AS contrib FROM levels"""
_SAME_KEY = " AND ".join(f"o.{k} IS NOT DISTINCT FROM n.{k}" for k in ROLLUP_KEY)
_MEASURES = ("price", "tonnage", "contrib")
_CHANGES = f"""
WITH o AS (WITH {_levels_sql('l_orderkey % 9 < 6')} {_LEVEL_ROWS}),
n AS (WITH {_levels_sql('l_orderkey % 9 > 1')} {_LEVEL_ROWS}),
pairs AS (
  SELECT CASE WHEN o.level IS NULL THEN 'added' WHEN n.level IS NULL THEN 'removed'
              WHEN {' OR '.join(f'o.{c} IS DISTINCT FROM n.{c}' for c in _MEASURES)} THEN 'changed' END AS change,
         {', '.join(f'CASE WHEN n.level IS NULL THEN o.{k} ELSE n.{k} END AS {k}' for k in ROLLUP_KEY)},
         {', '.join(f'n.{c}' for c in _MEASURES)}
  FROM o FULL JOIN n ON {_SAME_KEY})
SELECT * FROM pairs WHERE change IS NOT NULL"""

QUERIES = {
    "stream_ingest": (stream_ingest, f"""
SELECT DISTINCT {d('ts')} AS date, 'Odisha' AS state, 'M' || user_id AS market,
       CASE WHEN event_type = 'view' THEN 'Saunf' ELSE event_type END AS commodity,
       'Other' AS variety, CASE WHEN event_type = 'view' THEN 'Saunf' ELSE event_type END
       AS commodity_translated
FROM events"""),
    "shared_ingest": (shared_ingest, f"""
SELECT DISTINCT {d('ts')} AS date, user_id AS market, event_type AS commodity FROM events"""),
    "stream_rollup": (stream_rollup, f"WITH {LEVELS} {_LEVEL_ROWS}"),
    "stream_partials": (stream_partials, f"WITH {LEVELS} {_LEVEL_ROWS}"),
    "rollup_feed": (rollup_feed, f"WITH {LEVELS} {_LEVEL_ROWS}"),
    "rollup_changes": (rollup_changes, _CHANGES),
}
