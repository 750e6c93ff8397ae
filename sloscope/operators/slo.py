"""Objectives, error budgets and multi-window burn-rate alerts.

A first pass over the events' series and minutes finds each objective's series and
its last minute: one row for each objective. With these broadcast, a second pass sums
every window of every tier by conditional counts, summed on the map side, so neither a
hot model's events nor its minutes are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sloscope.functions import scalars as S
from sloscope.operators import pyramid
from sloscope.operators.buckets import with_series
from sloscope.operators.sketches import count_above
from sloscope.operators.windows import Minute, _lit, recent

TIER_SCHEMA = "tier_no int, burn_rate double, long_min long, short_min long, severity string, label string"
#: Threshold, windows in minutes, severity.
DEFAULT_TIERS = (
    (1, 14.4, 60, 5, "page", "fast"),
    (2, 6.0, 360, 30, "page", "moderate"),
    (3, 1.0, 4320, 360, "ticket", "slow"),
)
HOUR = 60


def tier_table(spark: SparkSession, tiers: tuple = DEFAULT_TIERS) -> DataFrame:
    return spark.createDataFrame(list(tiers), TIER_SCHEMA)


def _minutes(window_nanos: str) -> Column:
    return F.floor(F.col(window_nanos) / F.lit(S.MINUTE_NANOS).cast("decimal(20,0)")).cast("long")


def chosen_series(events: DataFrame, slos: DataFrame) -> DataFrame:
    """One row for each objective that has a series: the objective, its series and that one's last minute.

    The series is the model's own, else, for a success ratio, the first in key order that
    has the model among its labels. Objectives are as many as the configuration has.
    """
    last = with_series(events).groupBy("series").agg(F.max("minute").alias("last_minute"))
    return chosen_of(last.select("series", "last_minute", S.is_bare().alias("bare"), S.label("series", "model").alias("model")), slos)


def chosen_of(known: DataFrame, slos: DataFrame) -> DataFrame:
    """The same from a table of series: series, last_minute, bare and model."""
    met = known.select("series", "last_minute", "bare", "model").join(F.broadcast(slos), "model").filter((F.col("sli_kind") != "latency_threshold") | F.col("bare"))
    best = F.min_by(F.struct("series", "last_minute"), F.struct(~F.col("bare"), F.col("series")))
    return met.groupBy("name").agg(best.alias("best")).join(F.broadcast(slos), "name").select(F.col("name").alias("slo"), "best.*", "sli_kind", "threshold_ms", "window_nanos")


def chosen_events(events: DataFrame, slos: DataFrame, minutes: int | None = None, as_of_minute: Minute | None = None) -> DataFrame:
    """slo, minute, the columns of ``chosen_series`` and whether each event of an objective's series is bad.

    Bad is anything but success for a success ratio, and a finite latency above the
    threshold for a latency objective. With ``minutes`` only events that a window of so many
    can hold are read; the series are still chosen from all.
    """
    rows = with_series(events if minutes is None else recent(events, minutes, as_of_minute)).select("series", "minute", "status", S.finite("latency_ms").alias("latency_ms"))
    met = rows.join(F.broadcast(chosen_series(events, slos)), "series")
    bad = F.when(F.col("sli_kind") == "latency_threshold", F.col("latency_ms") > F.col("threshold_ms")).otherwise(~S.is_good())
    return met.select("slo", "minute", "last_minute", "window_nanos", F.coalesce(bad, F.lit(False)).alias("bad"))


def tier_windows(tiers: tuple) -> list[int]:
    return sorted({m for _, _, long_min, short_min, *_ in tiers for m in (long_min, short_min)} | {HOUR})


def budgets(events: DataFrame, slos: DataFrame, tiers: tuple = DEFAULT_TIERS, as_of_minute: Minute | None = None, longest: int | None = None) -> DataFrame:
    """One row for each objective with ``total_<minutes>`` and ``bad_<minutes>`` of every window; objectives without a series have zeros.

    Who knows the configuration gives the minutes of its ``longest`` window: older events are then not read.
    """
    windows = {str(m): F.lit(m) for m in tier_windows(tiers)} | {"full": _minutes("window_nanos")}
    rows = chosen_events(events, slos, None if longest is None else max(longest, *tier_windows(tiers)), as_of_minute).withColumn("_to", F.greatest("last_minute", _lit(as_of_minute)))
    sums = []
    for name, minutes in windows.items():
        inside = F.col("minute").between(F.col("_to") - minutes, F.col("_to"))
        sums += [F.count_if(inside).alias(f"total_{name}"), F.count_if(inside & F.col("bad")).alias(f"bad_{name}")]
    named = slos.select(F.col("name").alias("slo"), "model", "objective")
    out = named.join(rows.groupBy("slo").agg(*sums), "slo", "left")
    return out.na.fill(0, [c for c in out.columns if c.startswith(("total_", "bad_"))])


def budgets_from_blocks(read: pyramid.Reader, known: DataFrame, slos: DataFrame, tiers: tuple = DEFAULT_TIERS, as_of_minute: int | None = None) -> DataFrame:
    """``budgets`` from stored levels and the catalogue of series.

    Bad calls of a latency objective are counted from each block's sketch: exact for blocks
    of fewer latencies than the sketch keeps, else within its rank error. The objectives'
    right edges and windows, a few numbers each, limit what is read; sketches are read only
    where an objective needs them.
    """
    chosen = chosen_of(known, slos).select("*", F.greatest("last_minute", _lit(as_of_minute)).alias("_to"), _minutes("window_nanos").alias("_full"))
    edges = chosen.select("_to", "_full", "sli_kind", "threshold_ms").collect()
    windows = {str(m): F.lit(m) for m in tier_windows(tiers)} | {"full": F.col("_full")}
    lengths = [*tier_windows(tiers), *{r["_full"] for r in edges}]
    low, high = min((r["_to"] for r in edges), default=0), max((r["_to"] for r in edges), default=0)
    slow = sorted({r["threshold_ms"] for r in edges if r["sli_kind"] == "latency_threshold"})
    columns = ("total", "good", *(["latency_sketch"] if slow else []))
    rows = pyramid.blocks(read, lengths, low, high, *columns).join(F.broadcast(chosen), "series")
    bad = F.col("total") - F.col("good")
    if slow:
        # a sketch is asked for a fixed value only, and thresholds are as many as the configuration has
        above = F.coalesce(*(F.when(F.col("threshold_ms") == x, count_above("latency_sketch", x)) for x in slow))
        bad = F.when(F.col("sli_kind") == "latency_threshold", above).otherwise(bad)
    rows = rows.withColumn("bad", bad)
    sums = [F.sum(F.when(pyramid.covers(m, F.col("_to")), F.col(c))).alias(f"{c}_{name}") for name, m in windows.items() for c in ("total", "bad")]
    named = slos.select(F.col("name").alias("slo"), "model", "objective")
    out = named.join(rows.groupBy("slo").agg(*sums), "slo", "left")
    return out.na.fill(0, [c for c in out.columns if c.startswith(("total_", "bad_"))])


def alerts_of(tiers: tuple = DEFAULT_TIERS) -> Column:
    """Of the columns of ``budgets``, an array of the tiers that fire: both windows burn at the tier's rate or more."""
    parts = []
    for number, rate, long_min, short_min, severity, label in tiers:
        burn = {m: S.burn_rate(F.col(f"total_{m}"), F.col(f"bad_{m}"), F.col("objective")) for m in (long_min, short_min)}
        alert = F.struct(
            F.lit(number).alias("tier_no"), F.lit(label).alias("tier_label"), F.lit(severity).alias("severity"),
            burn[long_min].alias("long_burn_rate"), burn[short_min].alias("short_burn_rate"), F.col(f"total_{long_min}").alias("long_total"), F.col(f"total_{short_min}").alias("short_total"),
        )
        parts.append(F.when((burn[long_min] >= F.lit(float(rate))) & (burn[short_min] >= F.lit(float(rate))), alert))
    if not parts:
        return F.expr("CAST(array() AS array<struct<tier_no: int, tier_label: string, severity: string, long_burn_rate: double, short_burn_rate: double, long_total: bigint, short_total: bigint>>)")
    return F.filter(F.array(*parts), lambda t: t.isNotNull())


def flat_alerts(sums: DataFrame, tiers: tuple = DEFAULT_TIERS) -> DataFrame:
    """One row for each objective and tier that fires."""
    return sums.select("slo", F.inline(alerts_of(tiers)))


def evaluate(events: DataFrame, slos: DataFrame, tiers: tuple = DEFAULT_TIERS, as_of_minute: Minute | None = None, longest: int | None = None) -> DataFrame:
    """One row for each objective: burn rates, what is left of the budget, and its alerts in tier order."""
    return evaluation_of(budgets(events, slos, tiers, as_of_minute, longest), tiers)


def evaluation_of(sums: DataFrame, tiers: tuple = DEFAULT_TIERS) -> DataFrame:
    """``evaluate`` of the windows' sums."""
    one = lambda name, f: f(F.col(f"total_{name}"), F.col(f"bad_{name}"), F.col("objective"))
    return sums.select("slo", "objective", one(HOUR, S.burn_rate).alias("burn_rate_1h"), one("full", S.burn_rate).alias("burn_rate_full_window"), one("full", S.budget_remaining).alias("budget_remaining"), alerts_of(tiers).alias("alerts"))


def fired_count(evaluations: DataFrame) -> DataFrame:
    """How many alerts fire over all objectives."""
    return evaluations.agg(F.coalesce(F.sum(F.size("alerts")), F.lit(0)).cast("long").alias("fired"))


def timeline(events: DataFrame, slos: DataFrame, tiers: tuple = DEFAULT_TIERS, step: int = 1) -> DataFrame:
    """Every objective and tier at every ``step``-th minute from its first event to its last: burn rates and whether it fires.

    The spine of minutes makes quiet minutes visible, so that a short window is seen to clear.
    """
    rows = chosen_events(events, slos).groupBy("slo", "minute").agg(F.count("*").alias("total"), F.count_if("bad").alias("bad"))
    ends = rows.groupBy("slo").agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    spine = ends.select("slo", F.explode(F.sequence(F.col("a"), F.expr(f"b + pmod(-b, {step})"))).alias("minute"))
    dense = spine.join(rows, ["slo", "minute"], "left").na.fill(0, ["total", "bad"])
    # every minute is there, so a window's sum is the difference of two running sums, whatever its length
    order = Window.partitionBy("slo").orderBy("minute")
    running = dense.select("slo", "minute", *[F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("total", "bad")])
    sums = [(F.col(c) - F.lag(c, m + 1, 0).over(order)).alias(f"{c}_{m}") for m in tier_windows(tiers) for c in ("total", "bad")]
    out = running.select("slo", "minute", *sums).filter(F.col("minute") % step == 0)
    return tiers_at(out, slos, tiers)


def tiers_at(sums: DataFrame, slos: DataFrame, tiers: tuple = DEFAULT_TIERS) -> DataFrame:
    """Of the windows' sums of objectives at minutes: both burn rates of every tier and whether it fires."""
    named = slos.select(F.col("name").alias("slo"), "objective")
    out = sums.join(F.broadcast(named), "slo")
    each = [
        F.struct(
            F.lit(number).alias("tier_no"), F.lit(label).alias("tier_label"), F.lit(float(rate)).alias("threshold"),
            S.burn_rate(F.col(f"total_{a}"), F.col(f"bad_{a}"), F.col("objective")).alias("long_burn_rate"),
            S.burn_rate(F.col(f"total_{b}"), F.col(f"bad_{b}"), F.col("objective")).alias("short_burn_rate"),
        )
        for number, rate, a, b, _, label in tiers
    ]
    out = out.select("slo", "minute", F.inline(F.array(*each)))
    fires = (F.col("long_burn_rate") >= F.col("threshold")) & (F.col("short_burn_rate") >= F.col("threshold"))
    return out.withColumn("fires", fires).drop("threshold")
