"""Session set-up and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "12g", checkpoints: str | None = None
) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own. `checkpoints` names the shared folder."""
    builder = SparkSession.builder if checkpoints is None else SparkSession.builder.config("spark.checkpoint.dir", checkpoints)
    return (
        builder.master(f"local[{cores}]")
        .appName("screenflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _use_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder the session names; one JVM alone may use a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master == "local" or context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="screenflow-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see: this application's part of the checkpoint folder."""
    _use_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """`df` as a compressed table in the shared folder, read back: as `materialize`, for rows that are many and wide."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from the written rows.

    Used where a result must not be computed twice (row positions that depend on sampled range
    bounds) and between the rounds of an iteration. The written rows outlive their executors.
    """
    _use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
