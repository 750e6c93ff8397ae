"""The engine on streams.

Each micro-batch writes partial minute buckets to a folder of its own; a batch that is
run again overwrites its folder, so the sink is idempotent without a table format, and
late events need no watermark because partials add up. What must outlive a batch (detector
states, admitted series, the ring) are small tables kept by batch, and a hot model's events
of a micro-batch are scored by chunks like those of a table. A watermarked ``window`` form
stands beside for plain dashboards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sloscope.functions import scalars as S
from sloscope.operators import anomaly, buckets, slo
from sloscope.operators import detectors as custom
from sloscope.sources import journal
from sloscope.sources.events import to_wire
from sloscope.streaming.kept import Kept, exists
from sloscope.streaming.store import SERIES, batch_folder, stored_budgets, stream_id, write_store

_RESULT = "arrival_seq long, ts_nanos long, model string, detector_id string, source string, value double, score double, severity string"


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_date", F.to_date(F.timestamp_seconds(F.col("minute") * 60)))


def write_buckets(batch: DataFrame, batch_id: int, folder: str, sketches: bool = True) -> None:
    """One micro-batch's partial buckets in a folder by stream and batch, partitioned by day so that windows prune files.

    A stream keeps its id as long as its checkpoint: a batch that is run again replaces
    its own folder, and a new checkpoint's batches, which count from 0, replace no other's.
    """
    parts = _dated(buckets.minute_buckets(batch, sketches))
    parts.repartition("event_date").write.mode("overwrite").partitionBy("event_date").parquet(batch_folder(folder, stream_id(batch), batch_id))


def read_buckets(spark: SparkSession, folder: str, since_minute: int | None = None) -> DataFrame:
    """The merged buckets of all batches; ``since_minute`` prunes days and is pushed to the scan."""
    parts = spark.read.option("basePath", folder).parquet(folder)
    if since_minute is not None:
        parts = parts.filter((F.col("minute") >= since_minute) & (F.col("event_date") >= F.to_date(F.timestamp_seconds(F.lit(since_minute * 60)))))
    return buckets.merge_buckets(parts.drop("stream_id", "batch_id", "event_date"))


def compact_buckets(spark: SparkSession, folder: str, target: str, retention_minutes: int | None = None) -> None:
    """All batches of ``folder`` as one in ``target``, without buckets beyond the retention of their series."""
    merged = read_buckets(spark, folder)
    if retention_minutes is not None:
        merged = buckets.retain_newest(merged, retention_minutes)
    _dated(merged).repartition("event_date").write.mode("overwrite").partitionBy("event_date").parquet(f"{target}/stream_id=compact/batch_id=-1")


def ingest(events: DataFrame, folder: str, checkpoint: str, also: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Starts the bucket sink on a stream of events; ``also`` gets every micro-batch, too (a journal, say)."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write_buckets(batch, batch_id, folder)
            if also:
                also(batch, batch_id)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


EVALUATION_SCHEMA = """slo string, objective double, burn_rate_1h double, burn_rate_full_window double, budget_remaining double,
    alerts array<struct<tier_no: int, tier_label: string, severity: string, long_burn_rate: double, short_burn_rate: double, long_total: bigint, short_total: bigint>>"""


def evaluations(spark: SparkSession, keep: str) -> Kept:
    """The kept table of evaluations: the newest two, by stream and batch."""
    return Kept(spark, keep, f"{EVALUATION_SCHEMA}, evaluated_at timestamp")


def evaluate_every(events: DataFrame, checkpoint: str, evaluate: Callable[[int], DataFrame | None], seconds: int = 10, keep: str | None = None) -> StreamingQuery:
    """Calls ``evaluate`` with the batch number at every trigger, at least a second apart; ``keep`` holds its results for ``latest_evaluation``."""

    def step(batch: DataFrame, n: int) -> None:
        found = evaluate(n)
        if keep is not None and found is not None:
            evaluations(batch.sparkSession, keep).put(found.withColumn("evaluated_at", F.current_timestamp()), stream_id(batch), n)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, seconds)} seconds").start()


def latest_evaluation(spark: SparkSession, keep: str) -> DataFrame:
    """The newest result that ``evaluate_every`` kept: one row for each objective."""
    return evaluations(spark, keep).latest()


def _observe(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's events of a micro-batch in the order of arrival; the state is (n, mean, variance)."""
    rows = pd.concat(list(batches), ignore_index=True).sort_values("arrival_seq", kind="stable")
    n, mean, variance = state.get if state.exists else (0, 0.0, 0.0)
    alpha, threshold, warmup = (rows[c].iloc[0] for c in ("alpha", "threshold", "warmup"))
    z, means, variances = anomaly.ewma(rows["latency_ms"].to_numpy(float), float(alpha), n, mean, variance)
    state.update((int(n + len(rows)), float(means[-1]), float(variances[-1])))
    fires = (n + 1 + np.arange(len(rows)) >= warmup) & (np.abs(np.nan_to_num(z)) >= threshold) & ~np.isnan(z)
    out = rows[fires]
    score = z[fires]
    size = np.abs(score)
    severity = np.where(size >= 6, "critical", np.where(size >= 4, "warning", "info"))
    yield pd.DataFrame({"arrival_seq": out["arrival_seq"], "ts_nanos": out["ts_nanos"], "model": key[0], "detector_id": key[1], "source": "zscore", "value": out["latency_ms"], "score": score, "severity": severity})


def zscore_stream(events: DataFrame, detectors: DataFrame) -> DataFrame:
    """z-score anomalies of a stream of events; state is three numbers a key, so there is no watermark."""
    wanted = F.broadcast(detectors.filter("kind = 'zscore'").select("detector_id", "model", "alpha", "threshold", "warmup"))
    rows = events.select("arrival_seq", "ts_nanos", "model", "latency_ms").join(wanted, "model")
    return rows.groupBy("model", "detector_id").applyInPandasWithState(_observe, _RESULT, "n long, mean double, variance double", "append", GroupStateTimeout.NoTimeout)


def detect_stream(events: DataFrame, detectors: DataFrame) -> DataFrame:
    """The registry on a stream: every detector of an event's model sees it; thresholds need no state."""
    return zscore_stream(events, detectors).unionByName(anomaly.threshold_anomalies(events, detectors))


ADMITTED_SCHEMA = f"{SERIES}, first_seq long"
STARTS_SCHEMA = "model string, detector_id string, chunk long, n0 long, mean0 double, variance0 double"


def admit(batch: DataFrame, batch_id: int, home: str, cap: int = 10_000) -> DataFrame:
    """The events of a micro-batch whose series are among the first ``cap`` to arrive on the stream.

    Admitted series are kept below ``home``, at most ``cap`` of them; of a batch only its new
    series, one row each, are looked at. How many events were refused is written by batch.
    """
    stream = stream_id(batch)
    kept = Kept(batch.sparkSession, f"{home}/admitted", ADMITTED_SCHEMA)
    before = kept.before(stream, batch_id)
    rows = buckets.with_series(batch)
    fresh = rows.groupBy("series").agg(F.min("arrival_seq").alias("first_seq")).join(before.select("series"), "series", "left_anti")
    room = max(0, cap - before.count())
    admitted = kept.put(before.unionByName(fresh.orderBy("first_seq", "series").limit(room)), stream, batch_id)
    refused = rows.join(admitted.select("series"), "series", "left_anti").agg(F.count("*").alias("refused"))
    refused.write.mode("overwrite").parquet(batch_folder(f"{home}/refused", stream, batch_id))
    return rows.join(admitted.select("series"), "series", "left_semi").select(*batch.columns)


def refused_events(spark: SparkSession, home: str) -> DataFrame:
    """stream_id, batch_id, refused: events of series beyond the cap."""
    return spark.read.schema("refused long, stream_id string, batch_id long").option("basePath", f"{home}/refused").parquet(f"{home}/refused")


#: A detector table and the detectors of a user's own that it names.
Own = tuple[DataFrame, list[custom.Detector]]


def detect_batch(batch: DataFrame, batch_id: int, detectors: DataFrame, home: str, most: int = anomaly.RING, own: Own | None = None) -> None:
    """A micro-batch's anomalies, by chunks, added to those below ``home``; the ring of the last ``most`` goes along.

    The state of each (model, detector) before the batch enters as a chunk before all others,
    that of a user's own detector as the first row.
    """
    spark, stream = batch.sparkSession, stream_id(batch)
    states = Kept(spark, f"{home}/states", STARTS_SCHEMA)
    prior = states.before(stream, batch_id).filter(F.col("chunk") == anomaly.LAST)
    prior = prior.select("model", "detector_id", F.col("n0").alias("n"), F.col("mean0").alias("mean"), F.col("variance0").alias("variance"))
    starts = states.put(anomaly.zscore_starts(batch, detectors, prior), stream, batch_id)
    found = anomaly.zscore_anomalies(batch, detectors, starts).unionByName(anomaly.threshold_anomalies(batch, detectors))
    if own is not None:
        held = Kept(spark, f"{home}/own", custom.STATE_SCHEMA)
        place = batch_folder(f"{home}/observed", stream, batch_id)
        custom.observe(batch, *own, prior=held.before(stream, batch_id)).write.mode("overwrite").parquet(place)
        seen = spark.read.parquet(place)
        held.put(custom.states_of(seen), stream, batch_id)
        found = found.unionByName(custom.anomalies_of(seen))
    place = batch_folder(f"{home}/anomalies", stream, batch_id)
    found.write.mode("overwrite").parquet(place)
    ring = Kept(spark, f"{home}/ring", _RESULT)
    ring.put(anomaly.ring(ring.before(stream, batch_id).unionByName(spark.read.schema(_RESULT).parquet(place)), most), stream, batch_id)


def serve(events: DataFrame, detectors: DataFrame, home: str, checkpoint: str, cap: int = 10_000, ring: int = anomaly.RING, own: Own | None = None, **trigger) -> list[StreamingQuery]:
    """The whole ingest of a stream of events below the folder ``home``: store, journal and anomalies.

    Two queries run side by side, each with a checkpoint of its own: one admits series up to
    ``cap``, writes the store's levels and appends every micro-batch to the journal, the other
    runs the detectors (and with ``own`` those of a user) over all events, refused ones too. ``recent_anomalies`` reads the ring,
    ``store.stored_window`` and ``store.stored_budgets`` the store below ``home/store``; the
    journal replays with format ``journal``. Everything is written by stream and batch, so a
    new checkpoint replaces and deletes nothing of an older one.
    """
    journal.register(events.sparkSession)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write_store(admit(batch, batch_id, home, cap), batch_id, f"{home}/store", stream_id(batch))
            to_wire(batch).select("value").write.format("journal").mode("overwrite").save(batch_folder(f"{home}/journal", stream_id(batch), batch_id))
        finally:
            batch.unpersist()

    def detect(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            detect_batch(batch, batch_id, detectors, home, ring, own)
        finally:
            batch.unpersist()

    def start(sink: Callable[[DataFrame, int], None], name: str) -> StreamingQuery:
        return events.writeStream.foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/{name}").trigger(**(trigger or {"availableNow": True})).start()

    return [start(keep, "store"), start(detect, "anomalies")]


def serve_evaluations(spark: SparkSession, slos: DataFrame, home: str, checkpoint: str, tiers: tuple = slo.DEFAULT_TIERS, seconds: int = 10) -> StreamingQuery:
    """Evaluates the objectives from the store below ``home`` every so many seconds, events or none, for ``latest_evaluation``."""

    def evaluate(_: int) -> DataFrame | None:
        if not exists(spark, f"{home}/store/catalogue"):
            return None
        return slo.evaluation_of(stored_budgets(spark, f"{home}/store", slos, tiers), tiers)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return evaluate_every(ticks, checkpoint, evaluate, seconds, f"{home}/evaluations")


def recent_anomalies(spark: SparkSession, home: str, most: int = anomaly.RING) -> DataFrame:
    """The ring: the last anomalies that the detectors of ``serve`` have found; no more is read than it holds."""
    return anomaly.ring(Kept(spark, f"{home}/ring", _RESULT).latest(), most)


def all_anomalies(spark: SparkSession, home: str) -> DataFrame:
    """Every anomaly that ``serve`` has found."""
    return spark.read.schema(f"{_RESULT}, stream_id string, batch_id long").option("basePath", f"{home}/anomalies").parquet(f"{home}/anomalies").drop("stream_id", "batch_id")


def windowed_counts(events: DataFrame, size: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counters by model and event-time window, with a watermark; later events are dropped here, unlike in buckets."""
    rows = events.withColumn("event_time", S.event_time()).withWatermark("event_time", late)
    return rows.groupBy(F.window("event_time", size, slide or size), "model").agg(F.count("*").alias("total"), F.count_if(S.is_good()).alias("good"), F.count_if(S.is_server_failure()).alias("server_failures"))
