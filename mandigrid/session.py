"""Session settings the package relies on, and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app="mandigrid", master=None, **extra):
    """A session with the settings above; cluster settings are left alone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def materialise(df, purpose):
    """``df`` as a table written to the shared folder, read back.

    Used where a costly result is needed several times. The files outlive the
    executors that wrote them and cut the lineage.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_dir(spark, purpose):
    """A fresh folder for ``purpose`` below the cluster's shared checkpoint folder."""
    return f"{shared_base(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"


def shared_base(spark):
    """The cluster's shared checkpoint folder.

    The session's ``spark.checkpoint.dir`` is used as it is. Where none is set, a
    session of one machine (master ``local``) takes a folder of its own; on a cluster
    that would be another folder on every executor, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="mandigrid-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")
