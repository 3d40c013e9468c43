"""The folder that driver and executors share, for files of the engine's own."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside spark.checkpoint.dir, gone when the process ends. On
    one machine, where that is unset, a temporary one; on a cluster its
    absence is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="phasegrid-")
        atexit.register(shutil.rmtree, root[7:], True)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone before us
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(remove)
    return path
