"""Session settings and the shared folder for materialised intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "rankfold", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Session with UTC, Arrow and adaptive execution on.

    Shuffle partitions are left to the cluster's own setting: adaptive execution
    merges small ones, and a fixed number that fits one data size is wrong for the next.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediates: `spark.checkpoint.dir` of the session, else a fresh local one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="rankfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder; one subfolder per application, to be removed after the run."""
    return f"{shared_folder(spark)}/rankfold-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Removes what this application has stored below the shared folder; call it when no result is read any more."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rankfold-{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read on from there.

    Used where a result is costly to recompute and is read more than once (model scores,
    permuted copies, value tables). It cuts the lineage and survives lost executors, and
    later reads still prune columns and push filters down.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
