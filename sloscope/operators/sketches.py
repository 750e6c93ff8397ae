"""Mergeable sketches: latency quantiles (KLL) and version cardinality (HLL).

They follow the exact operators of ``windows`` closely enough for dashboards, and
unlike them combine over minutes, batches and series without the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloscope.functions import scalars as S
from sloscope.operators.buckets import SKETCH_K
from sloscope.operators.windows import Minute, in_window, quantile_of


def rank_of(sketch: Column | str, x: float) -> Column:
    """Share of values up to ``x``."""
    column = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.when(F.kll_sketch_get_n_double(column) > 0, F.kll_sketch_get_rank_double(column, F.lit(float(x))))


def count_above(sketch: Column | str, x: float) -> Column:
    column = F.col(sketch) if isinstance(sketch, str) else sketch
    n = F.kll_sketch_get_n_double(column)
    return F.coalesce(F.round(n.cast("double") * (F.lit(1.0) - rank_of(column, x))).cast("long"), F.lit(0).cast("long"))


def sketch_window(buckets: DataFrame, window: str | int, quantile: float = 0.95, as_of_minute: Minute | None = None) -> DataFrame:
    """Latency quantile of each series' window from stored buckets, and its versions over all of them."""
    versions = buckets.groupBy("series").agg(F.hll_sketch_estimate(F.hll_union_agg("version_sketch")).alias("model_version_cardinality"))
    rows = in_window(buckets.select("series", "minute", "latency_sketch"), S.window_minutes(window), as_of_minute)
    merged = rows.groupBy("series").agg(F.kll_merge_agg_double(F.col("latency_sketch"), F.lit(SKETCH_K)).alias("_sketch"))
    found = merged.select("series", F.kll_sketch_get_n_double("_sketch").alias("n"), quantile_of("_sketch", quantile).alias("latency_quantile_ms"))
    return versions.join(found, "series", "left")


def windowed_versions(buckets: DataFrame, window: str | int, as_of_minute: Minute | None = None) -> DataFrame:
    """Extension: versions seen inside the window, next to the lifetime number that queries report."""
    rows = in_window(buckets.select("series", "minute", "version_sketch"), S.window_minutes(window), as_of_minute)
    return rows.groupBy("series").agg(F.hll_sketch_estimate(F.hll_union_agg("version_sketch")).alias("versions_in_window"))
