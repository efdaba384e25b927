"""Shared folder for tables and checkpoints that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="veilspark-")
        root = _LOCAL_FOLDERS[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
