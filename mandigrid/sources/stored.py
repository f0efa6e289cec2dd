"""Tables made from source files, with a manifest of the files they were made from.

Below a home folder, ``manifests`` has one row for each source file and version of the
stored table: path, length, time of change, and where that version's data is. A reader
lists the source files and compares; nothing else is remembered, so every session, and
every reader in it, sees the sources as they are.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from mandigrid.sources.sinks import existing

_MANIFEST = ("source string, path string, length long, modified long, data string,"
             " version long")


def source_files(spark, sources: dict) -> DataFrame:
    """source, path, length and modified of the files of each source; no file is opened."""
    out = None
    for name, path in sources.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        rows = files.select(F.lit(name).alias("source"), "path", "length", F.unix_millis(
            "modificationTime").alias("modified"))
        out = rows if out is None else out.unionByName(rows)
    return out


@dataclass
class Difference:
    """How the sources differ from those of a version: per source the number of files that came
    or went, and the paths of new files if none went and only ``growing`` sources changed."""

    came: dict
    went: dict
    new_paths: list


def _difference(spark, now: DataFrame, then: DataFrame, growing) -> Difference:
    key = ["source", "path", "length", "modified"]
    both = now.withColumn("_now", F.lit(1)).join(then.select(*key).withColumn("_then", F.lit(1)), key, "full")
    changed = both.filter("_now IS NULL OR _then IS NULL")
    counts = {r["source"]: r for r in changed.groupBy("source").agg(
        F.count("_now").alias("came"), F.count("_then").alias("went")).collect()}  # a row for each source
    came = {name: r["came"] for name, r in counts.items() if r["came"]}
    went = {name: r["went"] for name, r in counts.items() if r["went"]}
    paths = []
    if came and not went and set(came) <= set(growing):
        paths = [r["path"] for r in changed.select("path").collect()]  # the new files alone
    return Difference(came, went, paths)


def stored_table(spark, home, sources: dict, build, grow=None, growing=(), schema=None) -> DataFrame:
    """The stored table at ``home``, brought up to date with ``sources`` (name: path) first.

    ``build(path)`` writes the whole table. ``grow(path, new_paths)``, if given, renews only the
    partitions of the table that the new files of ``growing`` sources touch; any other
    difference builds a new version beside the old one. A version counts when its manifest is
    there, which is written last. It is read with ``schema``, if given.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    manifests = existing(spark, f"{home}/manifests", _MANIFEST)
    now = source_files(spark, sources)
    version, data = 0, None
    if manifests is not None:
        last = manifests.agg(F.max(F.struct("version", "data")).alias("m")).first()["m"]
        if last is not None:
            version, data = last["version"], last["data"]
    if data is not None:
        then = manifests.filter(F.col("version") == version)
        found = _difference(spark, now, then, growing)
        if not found.came and not found.went:
            return reader.parquet(data)
        if grow is not None and found.new_paths:
            grow(data, found.new_paths)
        else:
            data = None
    if data is None:
        data = f"{home}/data-{uuid.uuid4().hex[:12]}"
        build(data)
    (now.withColumns({"data": F.lit(data), "version": F.lit(version + 1).cast("long")}).coalesce(1)
     .write.mode("append").parquet(f"{home}/manifests"))
    return reader.parquet(data)
