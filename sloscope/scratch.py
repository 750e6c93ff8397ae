"""A folder that driver and executors share, for what a query must write and reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: Folders of applications whose session names none.
_own: dict[str, str] = {}


def base_folder(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``.

    Where that is unset, one process that is driver and executor at once (tests) gets a
    folder of its own; on a cluster no local folder would do, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = f"file://{tempfile.mkdtemp(prefix='sloscope-')}"
        base = _own[application]
    return f"{base.rstrip('/')}/sloscope-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path below the application's."""
    return f"{base_folder(spark)}/{label}-{uuid.uuid4().hex}"
