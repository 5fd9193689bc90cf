"""Shared scratch folder for written intermediate tables and round trips.

On a cluster the folder is the one the cluster names in
``spark.checkpoint.dir`` (shared storage every executor can reach). Only a
local session without that setting gets a fresh temporary folder, as in
tests; a cluster session without it is an error, never a machine-local path.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _configured_dir(spark: SparkSession) -> str | None:
    try:
        current = spark.sparkContext._jsc.getCheckpointDir()
        if current.isPresent():
            return current.get()
        value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    except Exception:  # no SparkContext (e.g. a Spark Connect session)
        value = None
    return spark.conf.get("spark.checkpoint.dir", None) or value or None


def _is_local(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
    except Exception:  # cannot tell: treat as a cluster
        return False


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; set to a temporary one only in local mode."""
    configured = _configured_dir(spark)
    if configured:
        return configured.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    local = tempfile.mkdtemp(prefix="tricklens-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return _configured_dir(spark).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder (one per write, so retries never clash)."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
