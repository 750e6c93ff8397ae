"""Detectors of a user's own: one definition runs over tables and over streams.

A detector is a class with a ``kind``, a start state and ``observe``, which scores a stretch
of one model's values in the order of arrival and returns the state after it, as anything
that JSON can hold. A detector table names what watches which model with which settings.
Rows are read in sorted batches and only the state goes from batch to batch, so a model's
events are never held together. A detector that keeps a state for each part of its events
(the hour of the day, say) names the part by a column expression, and the parts run side by
side. Over a stream, what a micro-batch leaves is kept and enters the next one as its first
row, so that it makes no difference how the events are cut.

Values that aren't finite are observed like any other: what they mean is the detector's
choice. Events without an arrival number come first. A kind that isn't given is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.functions import scalars as S
from sloscope.operators.anomaly import UNNUMBERED

TABLE_SCHEMA = "detector_id string, model string, kind string, settings string"
STATE_SCHEMA = "model string, detector_id string, part long, state string"
_ROW = "arrival_seq long, ts_nanos long, model string, detector_id string, source string, value double, score double, part long, state string"
_KEY = ["model", "detector_id", "part"]


class Detector:
    """What a kind of detector must say. The score's size gives the severity, as z-scores do."""

    kind: str

    def part(self) -> Column:
        """The part of an event's state, a long; all events are one part unless a detector says otherwise."""
        return F.lit(0).cast("long")

    def start(self, settings: dict) -> Any:
        """The state before any event."""
        raise NotImplementedError

    def observe(self, values: np.ndarray, times: np.ndarray, settings: dict, state: Any) -> tuple[np.ndarray, Any]:
        """Each value's score, NaN where it is no anomaly, and the state after the last one."""
        raise NotImplementedError


class Seasonal(Detector):
    """A value against the mean and spread of all earlier ones of the same hour of the day.

    Settings: ``warmup`` earlier values at least (24), ``threshold`` spreads (4). Values that
    aren't finite are neither judged nor remembered. The state has four numbers an hour: how
    many values, the first one, and the sums of the differences to it and of their squares.
    """

    kind = "seasonal"

    def part(self) -> Column:
        return F.expr("pmod(ts_nanos div 3600000000000L, 24L)")

    def start(self, settings: dict) -> list:
        return [0, 0.0, 0.0, 0.0]

    def observe(self, values: np.ndarray, times: np.ndarray, settings: dict, state: list) -> tuple[np.ndarray, list]:
        score, good = np.full(len(values), np.nan), np.isfinite(values)
        x, (n, first, sums, squares) = values[good], state
        if not len(x):
            return score, state
        first = first if n else float(x[0])
        off = x - first
        count = n + np.arange(len(x))
        before = sums + np.concatenate(([0.0], np.cumsum(off)))
        squared = squares + np.concatenate(([0.0], np.cumsum(off * off)))
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = before[:-1] / count
            spread = np.sqrt(np.maximum(0.0, squared[:-1] / count - mean * mean))
            z = (off - mean) / spread
        fires = (count >= max(2, settings.get("warmup", 24))) & (spread > 1e-9 * np.maximum(1.0, np.abs(mean + first))) & (np.abs(z) >= settings.get("threshold", 4.0))
        score[good] = np.where(fires, z, np.nan)
        return score, [int(n + len(x)), first, float(before[-1]), float(squared[-1])]


def detector_rows(spark: SparkSession, rows: list[tuple[str, str, str, dict]]) -> DataFrame:
    """A table of (detector_id, model, kind, settings)."""
    return spark.createDataFrame([(i, m, k, json.dumps(s)) for i, m, k, s in rows], TABLE_SCHEMA)


def _observed(batches: Iterator[pd.DataFrame], kinds: dict[str, Detector]) -> Iterator[pd.DataFrame]:
    """Anomalies, and for each key the state after its last row; rows are sorted by key, a state before all events."""
    names = [x.split()[0] for x in _ROW.split(", ")]
    key, head, state = None, None, None

    def last() -> pd.DataFrame:
        model, detector_id, part = key
        return pd.DataFrame([(None, None, model, detector_id, head, None, None, part, json.dumps(state))], columns=names)

    for pdf in batches:
        for now, rows in pdf.groupby(_KEY, sort=False):
            kind, settings = rows["kind"].iloc[0], json.loads(rows["settings"].iloc[0] or "{}")
            if now != key:
                if key is not None:
                    yield last()
                key, head, state = now, kind, kinds[kind].start(settings)
            held = rows["state"].dropna()
            if len(held):
                state = json.loads(held.iloc[0])
            rows = rows[rows["state"].isna()]
            if not len(rows):
                continue
            values = rows["latency_ms"].to_numpy(float)
            score, state = kinds[kind].observe(values, rows["ts_nanos"].to_numpy(), settings, state)
            found = ~np.isnan(score)
            if found.any():
                out = rows[found]
                yield pd.DataFrame({"arrival_seq": out["arrival_seq"], "ts_nanos": out["ts_nanos"], "model": now[0], "detector_id": now[1], "source": kind, "value": values[found], "score": score[found], "part": now[2], "state": None})
    if key is not None:
        yield last()


def observe(events: DataFrame, table: DataFrame, kinds: list[Detector], prior: DataFrame | None = None) -> DataFrame:
    """Anomalies (``state`` null) and the states after all events (``state`` not null) of the detectors in ``table``.

    ``prior`` (STATE_SCHEMA) is what earlier events have left.
    """
    known = {k.kind: k for k in kinds}
    strange = [r["kind"] for r in table.filter(~F.col("kind").isin(list(known))).select("kind").distinct().collect()]
    if strange:
        raise ValueError(f"no detector of kind {', '.join(strange)}")
    rows = events.select("arrival_seq", "ts_nanos", "model", "latency_ms").join(F.broadcast(table), "model")
    part = F.coalesce(*(F.when(F.col("kind") == k.kind, k.part()) for k in kinds))
    rows = rows.select("arrival_seq", "ts_nanos", "model", "latency_ms", "detector_id", "kind", "settings", part.alias("part"), F.lit(None).cast("string").alias("state"))
    if prior is not None:
        held = prior.join(F.broadcast(table), ["model", "detector_id"])
        none = (F.lit(0).cast("long").alias("arrival_seq"), F.lit(0).cast("long").alias("ts_nanos"), F.lit(0.0).alias("latency_ms"))
        rows = rows.unionByName(held.select(*none, "model", "detector_id", "kind", "settings", "part", "state"))
    # no null among longs, which pandas would turn into doubles
    rows = rows.withColumn("arrival_seq", F.coalesce("arrival_seq", F.lit(UNNUMBERED).cast("long")))
    ordered = rows.repartition(*_KEY).sortWithinPartitions(*_KEY, F.col("state").isNull(), "arrival_seq")
    return ordered.mapInPandas(partial(_observed, kinds=known), _ROW).withColumn("arrival_seq", F.nullif("arrival_seq", F.lit(UNNUMBERED).cast("long")))


def anomalies_of(observed: DataFrame) -> DataFrame:
    found = observed.filter("state IS NULL")
    return found.select("arrival_seq", "ts_nanos", "model", "detector_id", "source", "value", "score", S.z_severity(F.col("score")).alias("severity"))


def states_of(observed: DataFrame) -> DataFrame:
    return observed.filter("state IS NOT NULL").select("model", "detector_id", "part", "state")


def detect(events: DataFrame, table: DataFrame, kinds: list[Detector]) -> DataFrame:
    """The anomalies of a table of events, in the columns of ``anomaly.detect``."""
    return anomalies_of(observe(events, table, kinds))
