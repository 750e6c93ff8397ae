"""Rolling-window questions over a series.

A window of W minutes ends at the later of ``as_of`` and the series' last minute and
covers W + 1 buckets, both ends included; below a minute it is the current bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sloscope.functions import scalars as S
from sloscope.operators.buckets import SKETCH_K, with_series, with_totals

Minute = int | Column


def _lit(as_of_minute: Minute | None) -> Column:
    return F.lit(-(2**62)).cast("long") if as_of_minute is None else as_of_minute if isinstance(as_of_minute, Column) else F.lit(as_of_minute).cast("long")


def recent(events: DataFrame, minutes: int, as_of_minute: Minute | None) -> DataFrame:
    """Events that can be in a window of so many minutes at all; the filter is on the stored column and reaches the scan.

    Windows end at ``as_of_minute`` or later, so what is older than one window before
    it is in none. A series whose last event is older ends its window at ``as_of_minute``.
    """
    if not isinstance(as_of_minute, int):
        return events
    return events.filter(F.col("ts_nanos") >= max(0, as_of_minute - minutes) * S.MINUTE_NANOS)


def in_window(rows: DataFrame, minutes: int | None, as_of_minute: Minute | None = None) -> DataFrame:
    """Rows (series, minute) inside the window of their series; None takes all minutes.

    The right edge is one row a series, joined back to the rows.
    """
    if minutes is None:
        return rows
    edge = rows.groupBy("series").agg(F.greatest(F.max("minute"), _lit(as_of_minute)).alias("_to"))
    inside = F.col("minute").between(F.col("_to") - minutes, F.col("_to"))
    return rows.join(edge, "series").filter(inside).drop("_to")


def _outcome() -> list[Column]:
    return [F.count("*").alias("total"), F.count_if(S.is_good()).alias("good"), F.count_if(S.is_server_failure()).alias("server_failures")]


def window_query(events: DataFrame, window: str | int, quantile: float = 0.95, as_of_minute: Minute | None = None, exact: bool = True) -> DataFrame:
    """For each series: totals, success ratio, latency quantile and lifetime number of versions.

    An exact quantile keeps a series' distinct latencies in one aggregation buffer; with
    ``exact=False`` a sketch of fixed size takes their place, for series without bound.
    """
    minutes, q = S.window_minutes(window), min(1.0, max(0.0, quantile))
    rows = with_series(recent(events, minutes, as_of_minute)).select("series", "minute", "status", "latency_ms")
    if exact:
        latency = F.percentile(S.finite("latency_ms"), F.lit(q))
    else:
        latency = quantile_of(F.kll_sketch_agg_double(S.finite("latency_ms"), F.lit(SKETCH_K)), q)
    # both uses of the series table have the same columns, so that it is computed once
    known = with_series(events).groupBy("series").agg(F.count_distinct("model_version").alias("model_version_cardinality"), F.max("minute").alias("last_minute"))
    to = F.greatest("last_minute", _lit(as_of_minute))
    inside = rows.join(known, "series").filter(F.col("minute").between(to - minutes, to))
    found = inside.groupBy("series").agg(*_outcome(), latency.alias("latency_quantile_ms"), F.max("model_version_cardinality").alias("_versions"))
    # a series whose last event lies before the window still has a row, with nothing in it
    out = known.join(found, "series", "left").na.fill(0, ["total", "good", "server_failures"])
    return out.select(
        "series", F.coalesce(S.label("series", "model"), F.lit("unknown")).alias("model"), "total", "good", "server_failures",
        S.success_ratio().alias("success_ratio"), F.lit(q).alias("quantile"), "latency_quantile_ms", "model_version_cardinality",
    )


snapshot_all = window_query


def quantile_of(sketch: Column | str, q: float) -> Column:
    """A KLL sketch's quantile; null for an empty sketch."""
    column = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.when(F.kll_sketch_get_n_double(column) > 0, F.kll_sketch_get_quantile_double(column, F.lit(min(1.0, max(0.0, q)))))


def choose_series(rows: DataFrame, model: str | Column, fallback: bool = True) -> DataFrame:
    """Of rows with a ``series``, those of the one that a model's name stands for.

    That is the series labelled with the model alone, else (with ``fallback``) the
    first in key order that has the model among its labels.
    """
    named = rows.filter(S.label("series", "model") == model)
    if not fallback:
        return named.filter(S.is_bare())
    best = named.select("series").distinct().orderBy(F.desc(S.is_bare()), "series").limit(1)
    return named.join(F.broadcast(best), "series", "left_semi")


class UnknownModel(LookupError):
    """No series bears the model's name."""


def require_model(events: DataFrame, model: str) -> None:
    """Raises ``UnknownModel`` unless some series has the model among its labels."""
    if with_series(events).filter(S.label("series", "model") == model).isEmpty():
        raise UnknownModel(model)


def model_query(events: DataFrame, model: str, window: str | int, quantile: float = 0.95, as_of_minute: Minute | None = None, known_only: bool = False) -> DataFrame:
    """``window_query`` of the series that ``model`` stands for; an unknown model has no row, or with ``known_only`` raises ``UnknownModel``."""
    if known_only:
        require_model(events, model)
    return window_query(choose_series(with_series(events), model).drop("series", "minute"), window, quantile, as_of_minute)


def latency_above(events: DataFrame, window: str | int, threshold_ms: float, as_of_minute: Minute | None = None) -> DataFrame:
    """For each series: events in the window, and those slower than the threshold (no fallback to other series)."""
    minutes = S.window_minutes(window)
    rows = with_series(recent(events, minutes, as_of_minute)).select("series", "minute", S.finite("latency_ms").alias("latency_ms"))
    counts = in_window(rows, minutes, as_of_minute).groupBy("series")
    return counts.agg(F.count("*").alias("total"), F.count_if(F.col("latency_ms") > threshold_ms).alias("count_above"))


def latency_cdf(events: DataFrame, points: list[float]) -> DataFrame:
    """For each series and point the share of finite latencies at or below it."""
    rows = with_series(events).select("series", S.finite("latency_ms").alias("v")).filter("v IS NOT NULL")
    shares = [F.avg((F.col("v") <= p).cast("double")) for p in points]
    steps = F.array(*[F.struct(F.lit(float(p)).alias("x"), s.alias("cdf")) for p, s in zip(points, shares)])
    return rows.groupBy("series").agg(steps.alias("steps")).select("series", F.inline("steps"))


def latency_summary(events: DataFrame, quantiles: list[float]) -> DataFrame:
    """Exact count, extremes and quantiles of the finite latencies of each series."""
    v = S.finite("latency_ms")
    out = with_series(events).groupBy("series").agg(F.count(v).alias("n"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"), F.percentile(v, F.array(*[F.lit(q) for q in quantiles])).alias("_q"))
    return out.select("series", "n", "min_ms", "max_ms", *[F.col("_q")[k].alias(f"q{q:g}") for k, q in enumerate(quantiles)])


def bucket_window(buckets: DataFrame, window: str | int, as_of_minute: Minute | None = None) -> DataFrame:
    """The counters' part of a window query from stored buckets; sketch columns aren't read."""
    rows = with_totals(buckets).select("series", "minute", "total", "good", "server_failures")
    sums = in_window(rows, S.window_minutes(window), as_of_minute).groupBy("series").agg(*[F.sum(c).alias(c) for c in ("total", "good", "server_failures")])
    return sums.withColumn("success_ratio", S.success_ratio())


def rolling_totals(buckets: DataFrame, window: str | int) -> DataFrame:
    """At every bucket of every series, the window that ends there."""
    frame = Window.partitionBy("series").orderBy("minute").rangeBetween(-S.window_minutes(window), 0)
    rows = with_totals(buckets)
    return rows.select("series", "minute", *[F.sum(c).over(frame).alias(c) for c in ("total", "good", "server_failures")])
