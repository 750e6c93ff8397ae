"""Windows over stored roll-ups: minute, hour and day partials and a catalogue of series.

A window is cut into the fewest whole blocks: days inside it, hours beside those, minutes
beside these. A row of a level counts for a window if its block lies inside and the block
above it doesn't, so many windows of many lengths are sums over one read of the levels,
conditional and summed on the map side. All partials merge (counters add, KLL and HLL
sketches union), so several batches' rows for one block need no merging first. What a
30-day window adds up is at most 60 + 60 minutes, 24 + 24 hours and 30 days a series and
batch, and the read is limited to those blocks by literal ranges that reach the scan.

The catalogue has one row a series: its last minute and a sketch of all its versions. So
the window's right edge and the lifetime versions need no look at the history.

A sketch knows a quantile only by rank, within its error once a block or a window has more
latencies than it keeps. Where the quantile itself is asked for, the stored latencies of the
window's minutes are read as well, and the value is selected from them by exact counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sloscope.functions import scalars as S
from sloscope.operators.buckets import SKETCH_K, merge_buckets, with_totals
from sloscope.operators.quantiles import exact_quantile
from sloscope.operators.windows import Minute, _lit, quantile_of

#: Minutes of a block of each level, and of the block above it.
LEVELS = {"minute": (1, 60), "hour": (60, 1440), "day": (1440, None)}
#: Reads the rows of a level whose block's first minute lies in one of the ranges.
Reader = Callable[[str, list[tuple[int, int]]], DataFrame]
#: Reads the latencies (series, minute, latency_ms) of a range of minutes.
Latencies = Callable[[int, int], DataFrame]


def roll_up(parts: DataFrame, level: str) -> DataFrame:
    """Partials of a finer level as those of a coarser one; ``minute`` is a block's first minute."""
    size, _ = LEVELS[level]
    return merge_buckets(parts.withColumn("minute", F.expr(f"minute - pmod(minute, {size}L)")))


def catalogue_of(parts: DataFrame) -> DataFrame:
    """series, last_minute and version_sketch of bucket partials with sketches."""
    return parts.groupBy("series").agg(F.max("minute").alias("last_minute"), F.hll_union_agg("version_sketch").alias("version_sketch"))


def merge_catalogue(parts: DataFrame) -> DataFrame:
    """One row for each series: model, whether it has no other label, last minute, number of versions."""
    whole = parts.groupBy("series").agg(F.max("last_minute").alias("last_minute"), F.hll_sketch_estimate(F.hll_union_agg("version_sketch")).alias("model_version_cardinality"))
    return whole.select("series", S.label("series", "model").alias("model"), S.is_bare().alias("bare"), "last_minute", "model_version_cardinality")


def needed(level: str, windows: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Ranges of first minutes that hold every block of the level that a window may need whose right edge is in low .. high."""
    _, above = LEVELS[level]
    if above is None:
        return [(low - max(windows), high)]
    left = [(low - w, min(high, high - w + above - 1)) for w in windows]
    ranges = sorted([*left, *((max(low - w, low - above + 1), high) for w in windows)])
    merged = [ranges[0]]
    for a, b in ranges[1:]:
        if a <= merged[-1][1] + 1:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def blocks(read: Reader, windows: list[int], low: int, high: int, *columns: str) -> DataFrame:
    """The levels' rows for such windows: series, minute, size, above and ``columns``."""
    found = None
    for level, (size, above) in LEVELS.items():
        rows = with_totals(read(level, needed(level, windows, low, high))).select("series", "minute", F.lit(size).alias("size"), F.lit(above).cast("int").alias("above"), *columns)
        found = rows if found is None else found.union(rows)
    return found


def covers(minutes: Column | int, to: Column) -> Column:
    """Whether a block is one of those that make up the window of ``minutes`` before ``to``, both ends included."""
    start, first = F.col("minute"), to - minutes
    inside = (start >= first) & (start + F.col("size") - 1 <= to)
    over = start - F.pmod(start, F.col("above"))
    return inside & ~F.coalesce((over >= first) & (over + F.col("above") - 1 <= to), F.lit(False))


def right_edges(known: DataFrame, as_of_minute: Minute | None) -> tuple[int, int] | None:
    """The least and greatest right edge of the series' windows: two numbers."""
    to = F.greatest("last_minute", _lit(as_of_minute))
    low, high = known.agg(F.min(to), F.max(to)).first()
    return None if low is None else (low, high)


def stored_window(read: Reader, known: DataFrame, window: str | int, quantile: float = 0.95, as_of_minute: Minute | None = None, latencies: Latencies | None = None) -> DataFrame:
    """``window_query`` from stored levels and the merged catalogue; quantiles and versions are the sketches'.

    With ``latencies`` the quantile is exact, a value of the window at any number of events.
    A series without events in the window has a row with nothing in it.
    """
    minutes, q = S.window_minutes(window), min(1.0, max(0.0, quantile))
    low, high = right_edges(known, as_of_minute) or (0, 0)
    to = F.greatest("last_minute", _lit(as_of_minute)).alias("to")
    edges, counts = known.select("series", to), ("total", "good", "server_failures")
    sums = [F.sum(c).alias(c) for c in counts]
    rows = blocks(read, [minutes], low, high, *counts, *(() if latencies else ("latency_sketch",))).join(edges, "series").filter(covers(minutes, F.col("to")))
    if latencies:
        values = latencies(low - minutes, high).join(edges, "series").filter(F.col("minute").between(F.col("to") - minutes, F.col("to")))
        exact = exact_quantile(values.select("series", F.col("latency_ms").alias("v")), q, discrete=True)
        found = rows.groupBy("series").agg(*sums).join(exact.select("series", F.col("quantile").alias("latency_quantile_ms")), "series", "left")
    else:
        found = rows.groupBy("series").agg(*sums, F.kll_merge_agg_double("latency_sketch", F.lit(SKETCH_K)).alias("sketch"))
        found = found.withColumn("latency_quantile_ms", quantile_of("sketch", q)).drop("sketch")
    out = known.join(found, "series", "left").na.fill(0, ["total", "good", "server_failures"])
    return out.select("series", F.coalesce("model", F.lit("unknown")).alias("model"), "total", "good", "server_failures", S.success_ratio().alias("success_ratio"), F.lit(q).alias("quantile"), "latency_quantile_ms", "model_version_cardinality")
