"""Helpers shared by the training-data operators.

Every operator takes a DataFrame with at least the columns it names (extra
columns of any name are ignored or passed through untouched), never relies on
row order, and writes what it must reread as Parquet below
``spark.checkpoint.dir`` so that a lost executor costs a task and not a job.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.scratch import base_folder

#: ASCII white space as the operators define it, for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]"


_registered: set[str] = set()


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    """The application's own scratch folder goes with the application."""
    if folder in _registered:
        return
    _registered.add(folder)

    def drop() -> None:
        jvm = spark.sparkContext._jvm
        if jvm is not None and spark.sparkContext._jsc is not None:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(drop)


#: Folders that passing tables go to; the innermost one last.
_passing: list[str] = []


def stash(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and return the reread table; with ``keep`` it outlives a ``passing`` block."""
    spark = df.sparkSession
    folder = base_folder(spark)
    _drop_at_exit(spark, folder)
    held = _passing[:-1] if keep else _passing
    path = f"{held[-1] if held else folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stashed inside are deleted at the end, but for those kept."""
    folder = f"{base_folder(spark)}/passing-{uuid.uuid4().hex}"
    _passing.append(folder)
    try:
        yield
    finally:
        _passing.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Whole texts are long: batches of so many bytes, not of 10,000 rows, bound a Python worker's memory.
BATCH_BYTES = "8m"


def reach_workers(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, and get their rows in bounded batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    home, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = f"{known['PYTHONPATH']}:{home}" if known.get("PYTHONPATH") else home


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Columns of ``row_key``.
KEY = ("_did", "_th", "_tg")


def row_key() -> list[Column]:
    """A row's id (null is the least long) and 128 bits of its text's hash: rows alike in all are one row repeated."""
    text = text_or_empty()
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_did"), F.xxhash64(text).alias("_th"), F.xxhash64(F.lit("row"), text).alias("_tg")]


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct ``_row``, so that none can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def blocks_for(rows: int, per_block: int, least: int = 1) -> int:
    """How many blocks hold ``rows`` at about ``per_block`` each; grows with the input."""
    return max(least, -(-rows // per_block))
