"""A folder for tables that a job writes and reads again: in the cluster's shared folder, one for each application."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_folders: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, removed when the driver ends. Unset, a temporary folder serves a local session."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="annolith-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
        sc.setCheckpointDir(there)
        spark.conf.set("spark.checkpoint.dir", there)
    folder = f"{there.rstrip('/')}/annolith-scratch-{sc.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        where = sc._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return f"{folder}/{name}-{uuid.uuid4().hex}"
