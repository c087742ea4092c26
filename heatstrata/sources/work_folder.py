"""The shared folder for tables that a job writes and reads again.

All of an application's work lies in one folder named after it, its owner: ``remove_work`` takes it away
when its results have been read, and what a stopped application left can be told from others' by name.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may do without that setting: it then works below a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="heatstrata-")
        base = _local_folders[app]
    return f"{base.rstrip('/')}/{owner(spark)}/work-{uuid.uuid4().hex}"


def owner(spark: SparkSession) -> str:
    return f"heatstrata-{spark.sparkContext.applicationId}"


def remove_work(spark: SparkSession) -> bool:
    """Delete all work tables of this application; tables read from them cannot be read again. True if there were any."""
    folder = work_folder(spark).rsplit("/", 1)[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
