"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder set as its checkpoint folder.

    Where neither is set, a temporary folder is used if all executors are threads of this
    machine's driver; on a cluster that is an error, as executors could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path
