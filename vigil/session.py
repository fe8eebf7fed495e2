"""SparkSession construction and cluster-shared folders."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # scan splits and post-shuffle partitions sized for executor memory at scale
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "vigil", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster call it without ``master`` and let spark-submit decide.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions is not None:  # else what spark-submit gave holds
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("VIGIL_DRIVER_MEMORY", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        pass
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one; only in local
    mode, where driver and executors are one process, an unset one is replaced
    by a fresh scratch folder.  On a cluster an unset one is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir is not set for {master}: executors need a shared folder")
        d = tempfile.mkdtemp(prefix="vigil-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 - Spark Connect: the server reads spark.checkpoint.dir
        pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path below the shared checkpoint folder, also for a driver that
    was started again."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Materialise ``df`` into the shared checkpoint folder and return a
    DataFrame reading it (reliable checkpoint: survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str = "table"):
    """``df`` written below the shared checkpoint folder as Parquet, which is
    smaller than a checkpoint for rows that hold texts or lists."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
