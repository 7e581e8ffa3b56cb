"""The folder that the driver and every executor can reach, for tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of our own in the warehouse.

    Both are shared by all machines of a cluster.  A folder of our own on a local disk goes at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{uuid.uuid4().hex}"
        where = urlparse(_OWN[key])
        if where.scheme in ("", "file"):
            atexit.register(shutil.rmtree, where.path, ignore_errors=True)
    return _OWN[key]
