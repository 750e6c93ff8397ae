"""Scalar expressions over inference events, all built from JVM functions."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_NANOS = 60_000_000_000
LONG_MAX = 2**63 - 1
U64_MAX = 2**64 - 1
STATUSES = ("success", "client_error", "server_error", "timeout")
METRIC = "inference"


def _name(c: str) -> str:
    return f"`{c}`"


# --- time -------------------------------------------------------------------------------


def minute_of(ts_nanos: str = "ts_nanos") -> Column:
    """Minutes since the epoch, exact for any long."""
    return F.expr(f"{_name(ts_nanos)} div {MINUTE_NANOS}L")


def bucket_start(ts_nanos: str, size_nanos: int) -> Column:
    """Nanoseconds at which the bucket of ``size_nanos`` begins."""
    return F.expr(f"{_name(ts_nanos)} - {_name(ts_nanos)} % {size_nanos}L")


def nanos_to_millis(c: str) -> Column:
    return F.expr(f"{_name(c)} div 1000000L")


def nanos_to_seconds(c: str) -> Column:
    return F.expr(f"{_name(c)} div 1000000000L")


def millis_to_nanos(c: str) -> Column:
    """Clamped at the largest long instead of failing."""
    return F.when(F.col(c) > LONG_MAX // 1_000_000, F.lit(LONG_MAX)).otherwise(F.col(c) * 1_000_000)


def saturating_add(a: str, b: str) -> Column:
    return F.coalesce(F.try_add(a, b), F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.lit(LONG_MAX)))


def saturating_sub(a: str, b: str) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.col(a) - F.col(b))


def event_time(ts_nanos: str = "ts_nanos") -> Column:
    """Timestamp (microseconds) of an event, for watermarks and ``window``."""
    return F.timestamp_micros(F.expr(f"{_name(ts_nanos)} div 1000L"))


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
_DURATION = re.compile(r"\+?([0-9]+)([smhd])")


def parse_duration(text: str | None) -> int | None:
    """Nanoseconds of ``30s``, ``5m``, ``6h``, ``3d``; None for anything else or beyond 64 bits."""
    found = _DURATION.fullmatch((text or "").strip(" \t\n\r\x0b\x0c"))
    nanos = int(found[1]) * _UNITS[found[2]] * 1_000_000_000 if found else None
    return nanos if nanos is not None and nanos <= U64_MAX else None


def duration_nanos(c: str) -> Column:
    """The same for a column; null for anything else. Beyond a long (292 years) it is null, too."""
    text = F.btrim(F.col(c), F.lit(" \t\n\r\x0b\x0c"))
    number = F.regexp_extract(text, r"^\+?([0-9]+)[smhd]$", 1).try_cast("bigint")
    unit = F.when(F.endswith(text, F.lit("s")), 1).when(F.endswith(text, F.lit("m")), 60).when(F.endswith(text, F.lit("h")), 3600).when(F.endswith(text, F.lit("d")), 86400)
    return F.try_multiply(number, unit.cast("long") * 1_000_000_000)


def window_minutes(window: str | int) -> int:
    """Whole minutes of a window given as text or nanoseconds; a sub-minute window has 0 (the current bucket only)."""
    nanos = parse_duration(window) if isinstance(window, str) else window
    if nanos is None:
        raise ValueError(f"not a duration: {window!r}")
    return nanos // MINUTE_NANOS


# --- outcome ----------------------------------------------------------------------------


def is_good(status: str = "status") -> Column:
    return F.col(status) == "success"


def is_server_failure(status: str = "status") -> Column:
    return F.col(status).isin("server_error", "timeout")


def finite(value: str) -> Column:
    """The value, or null if it is infinite or NaN (which sorts above infinity)."""
    return F.when(F.abs(F.col(value)) < F.lit(float("inf")), F.col(value))


def success_ratio(good: str = "good", total: str = "total") -> Column:
    """Null when there is nothing to divide by."""
    return F.when(F.col(total) > 0, F.col(good).cast("double") / F.col(total).cast("double"))


# --- series -----------------------------------------------------------------------------


def canonical_labels(model: str = "model", metadata: str = "metadata") -> Column:
    """Sorted key-value structs of the model and the metadata; a metadata key ``model`` wins."""
    given = F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>"))
    own = F.map_filter(F.create_map(F.lit("model"), F.col(model)), lambda k, _: ~F.map_contains_key(given, k))
    bare = F.array(F.struct(F.lit("model").alias("key"), F.col(model).alias("value")))
    # most events have no metadata; their key takes no map work
    return F.when(F.size(given) == 0, bare).otherwise(F.array_sort(F.map_entries(F.map_concat(own, given))))


def series_key(model: str = "model", metadata: str = "metadata") -> Column:
    return F.struct(F.lit(METRIC).alias("metric"), canonical_labels(model, metadata).alias("labels"))


def series_text(series: str = "series") -> Column:
    """``inference{model=m,region=r}``."""
    pairs = F.transform(F.col(f"{series}.labels"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return F.concat(F.col(f"{series}.metric"), F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def series_id(series: str = "series") -> Column:
    """64-bit hash for display; groups always form on the key itself."""
    return F.xxhash64(F.col(series))


def label(series: str, key: str) -> Column:
    """A label's value, or null."""
    return F.try_element_at(F.transform(F.filter(F.col(f"{series}.labels"), lambda x: x["key"] == key), lambda x: x["value"]), F.lit(1))


def is_bare(series: str = "series") -> Column:
    """Whether the series has no label but its model."""
    return F.size(F.col(f"{series}.labels")) == 1


# --- budgets ----------------------------------------------------------------------------


def burn_rate(total: Column, bad: Column, objective: Column) -> Column:
    """Observed over tolerable share of bad events; infinite if none is tolerable and some are bad."""
    tolerable = F.lit(1.0) - objective
    observed = bad.cast("double") / F.greatest(total, F.lit(1)).cast("double")
    return F.when(total == 0, F.lit(0.0)).when(tolerable <= 0, F.when(bad > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))).otherwise(F.try_divide(observed, tolerable))


def budget_allowance(total: Column, objective: Column) -> Column:
    return total.cast("double") * (F.lit(1.0) - objective)


def budget_consumed(total: Column, bad: Column, objective: Column) -> Column:
    """Share of the allowance that is spent; 0 where there is none."""
    allowance = budget_allowance(total, objective)
    return F.when(allowance <= 0, F.lit(0.0)).otherwise(F.try_divide(bad.cast("double"), allowance))


def budget_remaining(total: Column, bad: Column, objective: Column) -> Column:
    return F.lit(1.0) - budget_consumed(total, bad, objective)


# --- anomalies --------------------------------------------------------------------------


def z_severity(z: Column) -> Column:
    return F.when(F.abs(z) >= 6, "critical").when(F.abs(z) >= 4, "warning").otherwise("info")


def threshold_fires(value: Column, limit: Column, direction: Column) -> Column:
    """NaN never crosses a limit."""
    crossed = F.when(direction == "above", value > limit).otherwise(value < limit)
    return crossed & ~F.isnan(value) & ~F.isnan(limit)


# --- text -------------------------------------------------------------------------------


def percent_encode(text: str) -> str:
    """UTF-8 percent encoding that keeps letters, digits and ``-_.~``."""
    return quote(text, safe="-_.~")


def safe_title(title: Column, most: int = 256) -> Column:
    return F.substring(F.regexp_replace(title, "[\\r\\n]", ""), 1, most)


def safe_notes(notes: Column, most: int = 32, length: int = 1024, closing: str = "</untrusted_notes>") -> Column:
    """The first notes, cut to length, with the envelope's closing tag made harmless."""
    harmless = closing.replace("<", "&lt;").replace(">", "&gt;")
    return F.transform(F.slice(notes, 1, most), lambda n: F.replace(F.substring(n, 1, length), F.lit(closing), F.lit(harmless)))


def success_health(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "unknown").when(ratio >= 0.999, "green").when(ratio >= 0.99, "yellow").otherwise("red")


def latency_health(millis: Column) -> Column:
    return F.when(millis.isNull(), "unknown").when(millis < 300, "green").when(millis < 1000, "yellow").otherwise("red")
