"""Session factory: UTC, ANSI and adaptive execution on; everything else is the cluster's choice."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "sloscope", **extra: str) -> SparkSession:
    """A session on whatever master the environment names."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(app: str = "sloscope-local", cores: int | None = None, **extra: str) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    cores = cores or os.cpu_count() or 4
    local = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(cores),
    }
    built = session(app, **(local | extra))
    built.sparkContext.setLogLevel("ERROR")
    return built


def reach_workers(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, if it isn't installed for them."""
    home, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if home not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = f"{known['PYTHONPATH']}:{home}" if known.get("PYTHONPATH") else home
