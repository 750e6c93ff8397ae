"""Minute buckets: the pre-aggregated form of a series, mergeable in any order.

A bucket is one row of counters for (series, minute), with sketches on demand; late
and out-of-order events need no care, since partial buckets of one minute just add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sloscope.functions import scalars as S

COUNTERS = S.STATUSES
#: Size parameter of latency sketches: the rank error at P99 is about 0.0003.
SKETCH_K = 800
#: log2 of the registers of version sketches (3.25 % standard error).
VERSION_LG_K = 10


def with_series(events: DataFrame) -> DataFrame:
    """Adds the series key and the minute."""
    return events.withColumns({"series": S.series_key(), "minute": S.minute_of()})


def _counters() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in COUNTERS]


def minute_buckets(events: DataFrame, sketches: bool = False) -> DataFrame:
    """One row of counters for each series and minute; with sketches also of latency and versions.

    Latencies that aren't finite count as events but are not in the sketch.
    """
    extra = []
    if sketches:
        extra = [F.kll_sketch_agg_double(S.finite("latency_ms"), F.lit(SKETCH_K)).alias("latency_sketch"), F.hll_sketch_agg("model_version", VERSION_LG_K).alias("version_sketch")]
    return with_series(events).groupBy("series", "minute").agg(*_counters(), *extra)


def merge_buckets(parts: DataFrame) -> DataFrame:
    """Partial buckets of the same minutes, from any number of batches, as one each."""
    extra = [F.kll_merge_agg_double(F.col("latency_sketch"), F.lit(SKETCH_K)).alias("latency_sketch")] if "latency_sketch" in parts.columns else []
    extra += [F.hll_union_agg("version_sketch").alias("version_sketch")] if "version_sketch" in parts.columns else []
    return parts.groupBy("series", "minute").agg(*[F.sum(c).alias(c) for c in COUNTERS], *extra)


def with_totals(buckets: DataFrame) -> DataFrame:
    """Adds total, good and server_failures."""
    total = F.col("success") + F.col("client_error") + F.col("server_error") + F.col("timeout")
    return buckets.withColumns({"total": total, "good": F.col("success"), "server_failures": F.col("server_error") + F.col("timeout")})


def retain_newest(buckets: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` buckets that exist of each series, however far apart they are."""
    newest = Window.partitionBy("series").orderBy(F.desc("minute"))
    return buckets.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= most).drop("_rank")


def admitted_series(events: DataFrame, cap: int = 10_000) -> DataFrame:
    """The first ``cap`` series to arrive, with the place of their first event.

    A top-k over one row a series; nothing else of the events is ordered.
    """
    first = with_series(events).groupBy("series").agg(F.min("arrival_seq").alias("first_seq"))
    return first.orderBy("first_seq", "series").limit(cap)


def with_admission(events: DataFrame, cap: int = 10_000) -> DataFrame:
    """Adds ``accepted``: whether the event's series is under the cap. Refused events stay visible to detectors."""
    admitted = admitted_series(events, cap).select("series", F.lit(True).alias("accepted"))
    return with_series(events).join(admitted, "series", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def accepted_events(events: DataFrame, cap: int = 10_000) -> DataFrame:
    return with_series(events).join(admitted_series(events, cap).select("series"), "series", "left_semi").select(*events.columns)


def series_meta(events: DataFrame) -> DataFrame:
    """For each series its last minute and the number of versions it ever had, windows and retention aside."""
    return with_series(events).groupBy("series").agg(F.max("minute").alias("last_minute"), F.count_distinct("model_version").alias("model_version_cardinality"))
