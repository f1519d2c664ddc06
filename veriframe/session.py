"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Samples of failing rows may be as large as the production cap of 10 000 rows per rule;
    # above this threshold Spark would shuffle every violation before ranking.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # A rerun of one day replaces that day's partitions only.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Tables written by rule or day: a task keeps this many files open and sorts, and spills, only
    # rows of further partitions. Small, because each open file buffers a row group.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators count on to an existing session."""
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "veriframe", **conf: str) -> SparkSession:
    """Create or reuse a session with the defaults above; `conf` entries win."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names in `spark.checkpoint.dir`.

    Only a local session without that setting falls back to a temporary folder: on a cluster a
    machine-local folder would be lost with its executor and is not visible to the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="veriframe-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
