"""SparkSession construction and the shared checkpoint location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings that the operators are designed around.  AQE re-plans joins
# at runtime (broadcast when a side is measured small, skew-split otherwise)
# and coalesces the small post-shuffle partitions of the daily series.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "thetaflow", extra: dict | None = None) -> SparkSession:
    """Get or create a session with the settings above.

    ``master`` is only set when given (a cluster launcher supplies its own).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is used as is
    (Spark also makes it the context's checkpoint folder).  Only when it is
    unset, no checkpoint folder was given to the context, and the session runs
    in one process (local tests), a scratch folder is chosen, through
    ``setCheckpointDir`` -- the core setting itself cannot be changed at
    runtime.  On a cluster an unset folder is an error: executors would each
    write to a disk of their own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    sc = spark.sparkContext
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not re.match(r"local(\[[^\]]*\])?$", sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="thetaflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet to the shared checkpoint folder and reading it back.

    Survives executor loss (unlike a local checkpoint), and its readers take only the columns
    that they need; used where one table feeds many independent reports.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
