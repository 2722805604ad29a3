"""A folder that the driver and all executors share, for stores and checkpoints."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which is made the checkpoint folder, too. One of our own serves a single machine alone."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if where is None and current.isDefined():
        return current.get().rstrip("/")
    if where is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="hornspark-")
        atexit.register(shutil.rmtree, where, True)
    if not current.isDefined():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def remove(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
