"""The folder that driver and executors share, for tables that more than one job reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary folder, which
    goes with the process; on a cluster there is no such folder to fall back on."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _own:
        path = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[context.applicationId] = "file://" + path
    return _own[context.applicationId]
