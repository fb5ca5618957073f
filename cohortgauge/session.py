"""Session helpers: checkpoint location, stored intermediate tables, defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cohortgauge", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume (ANSI, AQE, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the cluster's shared folder.

    The folder named by ``spark.checkpoint.dir`` wins. A temporary folder is used
    only in local mode, where driver and executors share one disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return
    if context.getCheckpointDir() is not None:
        return
    if not context.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder every executor can reach; this plan "
            "writes an intermediate table so that lost executors cannot change it"
        )
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortgauge-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and continue from the written rows.

    No join is forced on the result: adaptive execution broadcasts it where its measured
    bytes allow and shuffles it otherwise.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
