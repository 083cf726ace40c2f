"""Folders that the driver and all executors see, for intermediate tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, without a trailing slash. Only where none is set and
    all runs in one process (tests, a laptop) is a folder of this process's own used; elsewhere that
    is an error, as executors would write to disks of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isDefined():
            named = at.get()
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        else:
            named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there when the process ends is deleted."""
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made[:] = [m for m in _made if m[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_made):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone, so there is nobody to tell
            return
