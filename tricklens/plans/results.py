"""Results that readers always find whole.

Spark's overwrite deletes a folder before it fills it again, so a reader in
between finds nothing. Here a result changes in one step:

* a one-row result is one JSON file that a finished copy replaces
  (``replace_rows``); plain readers of the folder always see one row;
* a result of any size is written to a new version folder, and then a small
  pointer file is replaced (``publish``); ``read_published`` follows the pointer.
  Older versions stay for readers that opened them, all but the last ``keep``.

Replacing is a rename on file systems where that is one step (local, HDFS,
ABFS), and a single put elsewhere (object stores show an object only once it is complete).
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROWS_FILE = "part-00000.json"
POINTER = "_current"
RENAMING = ("hdfs", "viewfs", "abfs", "abfss")


def hadoop(spark: SparkSession, path: str):
    """(JVM, Hadoop path, its file system)."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _local(spark: SparkSession, path: str) -> str | None:
    """The path on this machine if the file system is the local one."""
    _, where, fs = hadoop(spark, path)
    return unquote(urlparse(fs.makeQualified(where).toUri().toString()).path) if fs.getScheme() == "file" else None


def put(spark: SparkSession, path: str, content: str) -> None:
    """Write a small file so that readers see its old content or its new one, never part of it and never none."""
    data = content.encode("utf-8")
    local = _local(spark, path)
    staged = f"{os.path.dirname(local or path)}/_staged-{uuid.uuid4().hex}"
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(staged, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.replace(staged, local)
        return
    jvm, where, fs = hadoop(spark, path)
    renames = fs.getScheme() in RENAMING
    target = jvm.org.apache.hadoop.fs.Path(staged) if renames else where
    out = fs.create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if renames:
        overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(target, where, overwrite)


def get(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, or None if there is none."""
    jvm, where, fs = hadoop(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _drop_others(spark: SparkSession, folder: str, kept: str) -> None:
    """What an earlier writer of another layout left beside the one file."""
    jvm, where, fs = hadoop(spark, folder)
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name not in (kept, f".{kept}.crc") and (name.startswith("part-") or name.endswith(".crc") or name == "_SUCCESS"):
            fs.delete(status.getPath(), False)
        elif name == f".{kept}.crc":  # a checksum of the file that was replaced
            fs.delete(status.getPath(), False)


def replace_rows(rows: DataFrame, folder: str) -> None:
    """The folder's content becomes ``rows`` (one row, or very few), as one file of JSON lines.

    Null fields are left out of the JSON objects, as Spark's JSON writer does.
    """
    folder = folder.rstrip("/")
    lines = rows.toJSON().collect()
    put(rows.sparkSession, f"{folder}/{ROWS_FILE}", "".join(f"{line}\n" for line in lines))
    _drop_others(rows.sparkSession, folder, ROWS_FILE)


def publish(df: DataFrame, folder: str, keep: int = 2) -> str:
    """A new version of the table in ``folder``; readers move to it once it is complete. Returns the version's path."""
    spark, folder = df.sparkSession, folder.rstrip("/")
    before = (get(spark, f"{folder}/{POINTER}") or "").split()
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{version}")
    put(spark, f"{folder}/{POINTER}", "\n".join([version, *before[: keep - 1]]))
    jvm, where, fs = hadoop(spark, folder)
    for old in before[keep - 1 :]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(where, old), True)
    return f"{folder}/{version}"


def published_path(spark: SparkSession, folder: str) -> str | None:
    """Where the current version of a published table lies; None if there is none yet."""
    versions = (get(spark, f"{folder.rstrip('/')}/{POINTER}") or "").split()
    return f"{folder.rstrip('/')}/{versions[0]}" if versions else None


def read_published(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The current version of a published table; None if there is none yet."""
    path = published_path(spark, folder)
    if path is None:
        return None
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
