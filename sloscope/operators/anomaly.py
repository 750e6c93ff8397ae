"""Streaming anomaly detectors as batch operators: EWMA z-score, thresholds, registry, ring.

A detector sees the events of one model in the order of arrival, whatever their labels.
The recurrences run over sorted Arrow batches with a three-number state carried from
batch to batch, so memory doesn't grow with a model's events. A stretch of events acts on
the state before it by a formula of four numbers (``after``), so a model's events are cut
by arrival into chunks that run side by side: one pass sums each chunk up, the sums alone
are read in order to find where every chunk starts, and a second pass scores the events.
Results don't depend on batches or tasks: detectors of equal settings give equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.functions import scalars as S

DETECTOR_SCHEMA = "detector_id string, model string, kind string, alpha double, threshold double, warmup long, direction string, severity string"
#: Fixed values of the preset for each objective.
ALPHA, THRESHOLD, WARMUP = 0.05, 4.0, 60
RING = 256
#: Arrival numbers that differ only in so many low bits share a chunk.
CHUNK_BITS = 16
#: Chunks of what came before, of events without an arrival number, and of the state after all others.
PRIOR, UNNUMBERED, LAST = -(2**63), -(2**63) + 1, 2**63 - 1

_ANOMALY = "arrival_seq long, ts_nanos long, model string, detector_id string, source string, value double, score double, severity string"
_STATE = "model string, detector_id string, arrival_seq long, ts_nanos long, value double, n long, mean double, variance double, z double"


def zscore_detector(detector_id: str, model: str, alpha: float = ALPHA, threshold: float = THRESHOLD, warmup: int = WARMUP) -> tuple:
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    return detector_id, model, "zscore", alpha, threshold, warmup, None, None


def threshold_detector(detector_id: str, model: str, limit: float, direction: str = "above", severity: str = "warning") -> tuple:
    if direction not in ("above", "below"):
        raise ValueError("direction must be above or below")
    return detector_id, model, "threshold", None, limit, None, direction, severity


def detector_table(spark: SparkSession, detectors: list[tuple]) -> DataFrame:
    return spark.createDataFrame(detectors, DETECTOR_SCHEMA)


def detectors_for(slos: DataFrame) -> DataFrame:
    """The preset z-score detector of every objective: two objectives on a model report an anomaly twice."""
    return slos.select(
        F.col("name").alias("detector_id"), "model", F.lit("zscore").alias("kind"), F.lit(ALPHA).alias("alpha"), F.lit(THRESHOLD).alias("threshold"),
        F.lit(WARMUP).cast("long").alias("warmup"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("severity"),
    )


def ewma(values: np.ndarray, alpha: float, n: int = 0, mean: float = 0.0, variance: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """z-score of each value against the state before it (NaN where undefined), and mean and variance after it.

    ``n``, ``mean`` and ``variance`` are the state before the first value. Two values
    must have been seen, and the spread be above the smallest float step, for a score.
    """
    means, variances, z = np.empty(len(values)), np.empty(len(values)), np.full(len(values), np.nan)
    tiny, root = np.finfo(float).eps, np.sqrt
    for k, x in enumerate(values.tolist()):
        if n == 0:
            mean, variance = x, 0.0
        else:
            diff = x - mean
            spread = root(variance)
            if n >= 2 and spread > tiny:
                z[k] = diff / spread
            step = alpha * diff
            mean += step
            variance = (1 - alpha) * (variance + diff * step)
        n += 1
        means[k], variances[k] = mean, variance
    return z, means, variances


def after(state: tuple[float, float], chunk: tuple[int, float, float, float], alpha: float) -> tuple[float, float]:
    """Mean and variance after a chunk, from those before it and the chunk's sums.

    The sums are its number of values, its first value, and the mean and variance after it
    if nothing came before. With a start off the first value by ``off``, each mean is off by
    what decay has left of that, and the squares of the differences follow from it.
    """
    mean, variance = state
    n, first, own_mean, own_variance = chunk
    decay, off = (1 - alpha) ** n, mean - first
    spread = decay * variance + own_variance + off * decay * (off * (1 - decay) - 2 * (own_mean - first))
    return own_mean + decay * off, spread if spread > 0 or spread != spread else 0.0


KEYS = ["model", "detector_id", "chunk"]
_SUMS = "model string, detector_id string, chunk long, alpha double, n long, first double, mean double, variance double"
_STARTS = "model string, detector_id string, chunk long, n0 long, mean0 double, variance0 double"


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each chunk's sums; rows are sorted by chunk and arrival, and one may go on in the next batch."""
    names = [x.split()[0] for x in _SUMS.split(", ")]
    key, held = None, []
    for pdf in batches:
        done = []
        for now, rows in pdf.groupby(KEYS, sort=False):
            x = rows["latency_ms"].to_numpy(float)
            if now != key:
                done += [held] if held else []
                key, held = now, [*now, float(rows["alpha"].iloc[0]), 0, x[0], 0.0, 0.0]
            _, means, variances = ewma(x, held[3], held[4], *held[6:])
            held[4:] = held[4] + len(x), held[5], means[-1], variances[-1]
        if done:
            yield pd.DataFrame(done, columns=names)
    if held:
        yield pd.DataFrame([held], columns=names)


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state before each chunk and, as chunk LAST, the one after all; rows are sorted by chunk."""
    key, n, state = None, 0, (0.0, 0.0)
    names = [x.split()[0] for x in _STARTS.split(", ")]
    for pdf in batches:
        found = []
        for model, detector, chunk, alpha, *sums in pdf.itertuples(index=False, name=None):
            if (model, detector) != key:
                found += [(*key, LAST, n, *state)] if key else []
                key, n, state = (model, detector), 0, (sums[1], 0.0)
            found.append((model, detector, chunk, n, *state))
            n, state = n + sums[0], after(state, sums, alpha)
        yield pd.DataFrame(found, columns=names)
    if key:
        yield pd.DataFrame([(*key, LAST, n, *state)], columns=names)


def _states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by chunk and arrival, with the state before the chunk; the last chunk's state is carried over."""
    key, state = None, (0, 0.0, 0.0)
    for pdf in batches:
        for now, rows in pdf.groupby(KEYS, sort=False):
            n, mean, variance = state if now == key else (rows[c].iloc[0] for c in ("n0", "mean0", "variance0"))
            x = rows["latency_ms"].to_numpy(float)
            z, means, variances = ewma(x, float(rows["alpha"].iloc[0]), n, mean, variance)
            counts = n + 1 + np.arange(len(rows))
            seen = {c: rows[c].to_numpy() for c in ("arrival_seq", "ts_nanos")}
            yield pd.DataFrame({"model": now[0], "detector_id": now[1], **seen, "value": x, "n": counts, "mean": means, "variance": variances, "z": np.where(np.isnan(z), None, z)})
            key, state = now, (int(counts[-1]), means[-1], variances[-1])


def _dealt(events: DataFrame, detectors: DataFrame, chunk_bits: int) -> DataFrame:
    """Each event under every z-score detector of its model, with its chunk; one explicit shuffle serves both passes and is never split by key."""
    wanted = detectors.filter("kind = 'zscore' AND detector_id IS NOT NULL").select("detector_id", "model", "alpha")
    rows = events.select("arrival_seq", "ts_nanos", "model", "latency_ms").join(F.broadcast(wanted), "model")
    chunk = F.coalesce(F.shiftright("arrival_seq", chunk_bits), F.lit(UNNUMBERED).cast("long"))
    return rows.select("model", "detector_id", chunk.alias("chunk"), "arrival_seq", "ts_nanos", "latency_ms", "alpha").repartition(*KEYS)


def zscore_starts(events: DataFrame, detectors: DataFrame, prior: DataFrame | None = None, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """model, detector_id, chunk, n0, mean0, variance0: the state before each chunk and, as chunk LAST, after all events.

    ``prior`` (model, detector_id, n, mean, variance) is the state that earlier events have
    left: a chunk like any other, before the first.
    """
    sums = _dealt(events, detectors, chunk_bits).sortWithinPartitions(*KEYS, "arrival_seq").mapInPandas(_sums, _SUMS)
    if prior is not None:
        known = prior.join(F.broadcast(detectors.filter("kind = 'zscore'").select("model", "detector_id", "alpha")), ["model", "detector_id"])
        sums = sums.union(known.select("model", "detector_id", F.lit(PRIOR).cast("long").alias("chunk"), "alpha", "n", F.col("mean").alias("first"), "mean", "variance"))
    return sums.repartition("model", "detector_id").sortWithinPartitions(*KEYS).mapInPandas(_starts, _STARTS)


def zscore_states(events: DataFrame, detectors: DataFrame, chunk_bits: int = CHUNK_BITS, starts: DataFrame | None = None) -> DataFrame:
    """For every event and z-score detector of its model: the state after it and its score before it.

    Events without an arrival number come first. What one task reads in order is a chunk's
    events, or one row a chunk; arrival numbers should therefore be dense. ``starts`` of
    ``zscore_starts`` may be given where they are already known.
    """
    starts = zscore_starts(events, detectors, None, chunk_bits) if starts is None else starts
    ordered = _dealt(events, detectors, chunk_bits).join(starts, KEYS).sortWithinPartitions(*KEYS, "arrival_seq")
    return ordered.mapInPandas(_states, _STATE)


def zscore_anomalies(events: DataFrame, detectors: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    wanted = F.broadcast(detectors.filter("kind = 'zscore'").select("detector_id", "model", "threshold", "warmup"))
    fired = zscore_states(events, detectors, starts=starts).join(wanted, ["model", "detector_id"]).filter((F.col("n") >= F.col("warmup")) & (F.abs("z") >= F.col("threshold")))
    return fired.select("arrival_seq", "ts_nanos", "model", "detector_id", F.lit("zscore").alias("source"), "value", F.col("z").alias("score"), S.z_severity(F.col("z")).alias("severity"))


def threshold_anomalies(events: DataFrame, detectors: DataFrame) -> DataFrame:
    wanted = F.broadcast(detectors.filter("kind = 'threshold'").select("detector_id", "model", "threshold", "direction", F.col("severity").alias("level")))
    rows = events.select("arrival_seq", "ts_nanos", "model", F.col("latency_ms").alias("value")).join(wanted, "model")
    rows = rows.filter(S.threshold_fires(F.col("value"), F.col("threshold"), F.col("direction")))
    score = F.abs(F.col("value") - F.col("threshold"))
    return rows.select("arrival_seq", "ts_nanos", "model", "detector_id", F.lit("threshold").alias("source"), "value", score.alias("score"), F.col("level").alias("severity"))


def detect(events: DataFrame, detectors: DataFrame) -> DataFrame:
    """The registry: every detector of an event's model sees it; models without any have no anomalies."""
    return zscore_anomalies(events, detectors).unionByName(threshold_anomalies(events, detectors))


def once_each(anomalies: DataFrame) -> DataFrame:
    """A view without the repeats that several objectives on one model give."""
    return anomalies.groupBy("arrival_seq", "ts_nanos", "model", "source", "value", "score", "severity").agg(F.min("detector_id").alias("detector_id"))


def ring(anomalies: DataFrame, most: int = RING) -> DataFrame:
    """The last ``most`` anomalies, oldest first."""
    last = anomalies.orderBy(F.desc("arrival_seq"), F.desc("detector_id")).limit(most)
    return last.orderBy("arrival_seq", "detector_id")
