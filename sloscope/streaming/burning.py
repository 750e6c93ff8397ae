"""Objectives on a stream, minute by minute: arbitrary state with a ring of sums and timers.

Each objective keeps the sums of the minutes that its longest window still needs, and when
the watermark has passed a minute, every window that ends there is two look-ups in the
running sums. Tasks add a micro-batch's events up by objective and minute before anything is
shuffled. So a trigger costs the new events and the closed minutes, whatever the history;
timers close the minutes in which nothing happened.

An objective sees its model's own series (without further labels). Events of minutes that
are already closed are ignored: the watermark's delay is what lateness is waited for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sloscope.functions import scalars as S
from sloscope.operators import slo

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MINUTE_MS = 60_000


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's events by objective and minute."""
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by(["slo", "minute"]).aggregate([("bad", "count"), ("bad", "sum")])
        sums = sums.select(["slo", "minute", "bad_count", "bad_sum"]).rename_columns(["slo", "minute", "total", "bad"])
        yield from sums.cast(pa.schema([("slo", pa.string()), ("minute", pa.int64()), ("total", pa.int64()), ("bad", pa.int64())])).combine_chunks().to_batches()


def windows_at(minutes: np.ndarray, sums: np.ndarray, ends: np.ndarray, windows: list[int]) -> np.ndarray:
    """Of sorted ``minutes`` with their ``sums`` (rows of two), the sums of each window that ends at each of ``ends``: ends x windows x 2."""
    running = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(sums, axis=0)))
    upto = running[np.searchsorted(minutes, ends, side="right")]
    return np.stack([upto - running[np.searchsorted(minutes, ends - w, side="left")] for w in windows], axis=1)


class _Ring(StatefulProcessor):
    """Per objective: the first minute, the last closed one, and (minute, total, bad) of minutes still needed."""

    def __init__(self, windows: list[int], step: int) -> None:
        self.windows, self.step = windows, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.held.get()[0]) if self.held.exists() else {"closed": None, "first": None, "sums": []}
        new = pd.concat(list(rows), ignore_index=True)
        if state["closed"] is not None:
            new = new[new["minute"] > state["closed"]]
        both = pd.concat([pd.DataFrame(state["sums"], columns=["minute", "total", "bad"], dtype="int64"), new[["minute", "total", "bad"]]])
        sums = both.groupby("minute", sort=True).sum().reset_index()
        if len(sums):
            first = int(sums["minute"].iloc[0])
            state["first"] = first if state["first"] is None else min(first, state["first"])
        state["sums"] = sums.to_numpy(np.int64)
        yield from self._close(key, state, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = json.loads(self.held.get()[0])
        state["sums"] = np.array(state["sums"], np.int64).reshape(-1, 3)
        yield from self._close(key, state, timerValues)

    def _close(self, key, state: dict, timer) -> Iterator[pd.DataFrame]:
        closed = timer.getCurrentWatermarkInMs() // _MINUTE_MS - 1
        begin = state["first"] if state["closed"] is None else state["closed"] + 1
        if begin is not None and closed >= begin:
            ends = np.arange(-(-begin // self.step) * self.step, closed + 1, self.step)
            if len(ends):
                found = windows_at(state["sums"][:, 0], state["sums"][:, 1:], ends, self.windows)
                columns = {f"{c}_{w}": found[:, k, n] for k, w in enumerate(self.windows) for n, c in enumerate(("total", "bad"))}
                yield pd.DataFrame({"slo": key[0], "minute": ends, **columns})
            state["closed"] = int(closed)
            state["sums"] = state["sums"][state["sums"][:, 0] > closed - max(self.windows)]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        # the next minute closes when the watermark has passed its end
        self.handle.registerTimer(max(timer.getCurrentWatermarkInMs() // _MINUTE_MS + 1, (begin or 0) + 1) * _MINUTE_MS)
        self.held.update((json.dumps(state | {"sums": state["sums"].tolist()}),))

    def close(self) -> None:
        pass


def minute_sums(events: DataFrame, slos: DataFrame) -> DataFrame:
    """slo, minute, total and bad of a stream's events, added up within each task's batches."""
    rules = F.broadcast(slos.select(F.col("name").alias("slo"), "model", "sli_kind", "threshold_ms"))
    rows = events.filter(F.size(F.coalesce("metadata", F.create_map().cast("map<string,string>"))) == 0).join(rules, "model")
    bad = F.when(F.col("sli_kind") == "latency_threshold", S.finite("latency_ms") > F.col("threshold_ms")).otherwise(~S.is_good())
    rows = rows.select("slo", S.minute_of().alias("minute"), F.coalesce(bad, F.lit(False)).cast("int").alias("bad"))
    return rows.mapInArrow(_added, "slo string, minute long, total long, bad long")


def burning(events: DataFrame, slos: DataFrame, tiers: tuple = slo.DEFAULT_TIERS, step: int = 1, late: str = "0 seconds") -> DataFrame:
    """The stream of ``slo.timeline``: every objective and tier at every ``step``-th closed minute."""
    windows = slo.tier_windows(tiers)
    timed = events.withColumn("event_time", S.event_time()).withWatermark("event_time", late)
    schema = "slo string, minute long, " + ", ".join(f"{c}_{w} long" for w in windows for c in ("total", "bad"))
    sums = minute_sums(timed, slos).groupBy("slo").transformWithStateInPandas(_Ring(windows, step), schema, "Append", "EventTime")
    return slo.tiers_at(sums, slos, tiers)


@contextmanager
def _states_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Arbitrary state needs this store; a query keeps the setting that it was started under."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def write_burning(events: DataFrame, slos: DataFrame, folder: str, checkpoint: str, tiers: tuple = slo.DEFAULT_TIERS, step: int = 1, late: str = "0 seconds", **trigger) -> StreamingQuery:
    """Starts ``burning`` into a folder of Parquet files."""
    with _states_in_rocksdb(events.sparkSession):
        out = burning(events, slos, tiers, step, late).writeStream.format("parquet").outputMode("append")
        return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(folder)
