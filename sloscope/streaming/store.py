"""The store of a stream: levels of bucket partials, latencies and the catalogue of series, by batch.

Every micro-batch adds a folder of its own to each level and to the catalogue; a batch that
is run again replaces its folders, and a new checkpoint has a stream id of its own, so no
stream touches another's. Minutes are partitioned by day, and rows are sorted by minute, so
that ranges of minutes prune folders, files and row groups. So are the latencies, one short
row an event, which only exact quantiles read.

Compaction merges the minutes of days that several batches have written to. Its output is a
batch of the stream COMPACT that nobody sees until a kept table names it, with the parts of
days that it replaces: that table's one file appears at once, so readers see one version or
the other, and a compaction that is broken off leaves nothing but unseen files, which the
next one overwrites. Replaced files are deleted by the compaction after, when no reader of
the older version should be left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sloscope.functions import scalars as S
from sloscope.operators import buckets, pyramid, slo
from sloscope.operators.windows import Minute
from sloscope.streaming.kept import Kept, exists, located

SERIES = "series struct<metric: string, labels: array<struct<key: string, value: string>>>"
_PLACE = "stream_id string, batch_id long"
LEVEL_SCHEMA = f"{SERIES}, minute long, success long, client_error long, server_error long, timeout long, latency_sketch binary, version_sketch binary, {_PLACE}"
CATALOGUE_SCHEMA = f"{SERIES}, last_minute long, version_sketch binary, {_PLACE}"
LATENCY_SCHEMA = f"{SERIES}, minute long, latency_ms double, {_PLACE}, event_date date"


#: The stream that compactions write as.
COMPACT = "compact"
#: A part of a day that is replaced by, or (``gone`` 0) is the output of, a compaction.
REPLACED_SCHEMA = "event_date date, stream_id string, batch_id long, gone int"


def stream_id(batch: DataFrame) -> str:
    """The id of the stream that a micro-batch belongs to, as long as its checkpoint lives."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def batch_folder(folder: str, stream: str, batch_id: int) -> str:
    return f"{folder}/stream_id={stream}/batch_id={batch_id}"


def _day(minute: Column) -> Column:
    return F.to_date(F.timestamp_seconds(minute * 60))


def write_store(batch: DataFrame, batch_id: int, home: str, stream: str | None = None) -> None:
    """One micro-batch's partials at every level, its latencies and its series; each level is made of the one below."""
    spark, stream = batch.sparkSession, stream or stream_id(batch)
    place = {name: batch_folder(f"{home}/{name}", stream, batch_id) for name in (*pyramid.LEVELS, "latency", "catalogue")}
    parts = buckets.minute_buckets(batch, sketches=True).withColumn("event_date", _day(F.col("minute")))
    parts.repartition("event_date").sortWithinPartitions("event_date", "minute").write.mode("overwrite").partitionBy("event_date").parquet(place["minute"])
    values = buckets.with_series(batch).select("series", "minute", S.finite("latency_ms").alias("latency_ms"), _day(F.col("minute")).alias("event_date")).filter("latency_ms IS NOT NULL")
    values.hint("rebalance", "event_date").sortWithinPartitions("event_date", "minute").write.mode("overwrite").partitionBy("event_date").parquet(place["latency"])
    below = spark.read.schema(f"{LEVEL_SCHEMA}, event_date date").parquet(place["minute"]).drop("event_date", "stream_id", "batch_id")
    pyramid.catalogue_of(below).write.mode("overwrite").parquet(place["catalogue"])
    for level in ("hour", "day"):
        pyramid.roll_up(below, level).sort("minute").write.mode("overwrite").parquet(place[level])
        below = spark.read.schema(LEVEL_SCHEMA).parquet(place[level]).drop("stream_id", "batch_id")


def _read(spark: SparkSession, home: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{home}/{name}").parquet(f"{home}/{name}")


def catalogue(spark: SparkSession, home: str) -> DataFrame:
    """The merged catalogue: one row for each series that the store has."""
    return pyramid.merge_catalogue(_read(spark, home, "catalogue", CATALOGUE_SCHEMA))


def _replaced(spark: SparkSession, home: str) -> Kept:
    return Kept(spark, f"{home}/compacted", REPLACED_SCHEMA)


def _live_minutes(spark: SparkSession, home: str) -> DataFrame:
    """The minutes' parts of the version that the last compaction has left."""
    rows = _read(spark, home, "minute", f"{LEVEL_SCHEMA}, event_date date")
    if not exists(spark, f"{home}/compacted"):
        return rows.filter(F.col("stream_id") != COMPACT)
    known, part = _replaced(spark, home).latest(), ["event_date", "stream_id", "batch_id"]
    seen = rows.filter(F.col("stream_id") != COMPACT).unionByName(rows.filter(F.col("stream_id") == COMPACT).join(F.broadcast(known.filter("gone = 0").select(*part)), part, "left_semi"))
    return seen.join(F.broadcast(known.filter("gone > 0").select(*part)), part, "left_anti").select(*rows.columns)


def compact(spark: SparkSession, home: str, before_minute: int | None = None) -> int:
    """Merges the minutes of every day with several live parts (of days that end before the minute); returns how many days."""
    kept, part = _replaced(spark, home), ["event_date", "stream_id", "batch_id"]
    known = kept.latest()
    turn = (known.agg(F.max(F.greatest("gone", F.when(F.col("stream_id") == COMPACT, F.col("batch_id"))))).first()[0] or 0) + 1
    live = _live_minutes(spark, home)
    if before_minute is not None:
        live = live.filter(F.col("event_date") < _day(F.lit(before_minute).cast("long")))
    parts = live.select(*part).distinct()
    days = parts.groupBy("event_date").agg(F.count("*").alias("parts")).filter("parts > 1").select("event_date")
    due = [tuple(r) for r in parts.join(days, "event_date", "left_semi").collect()]  # days and batches, not their rows
    if not due:
        return 0
    merged = live.join(F.broadcast(days), "event_date", "left_semi").drop("stream_id", "batch_id")
    out = buckets.merge_buckets(merged).withColumn("event_date", _day(F.col("minute")))
    out.repartition("event_date").sortWithinPartitions("event_date", "minute").write.mode("overwrite").partitionBy("event_date").parquet(batch_folder(f"{home}/minute", COMPACT, turn))
    old = [tuple(r)[:3] for r in known.filter("gone > 0").collect()]
    now = {(day, COMPACT, turn, 0) for day, *_ in due} | {(*p, turn) for p in due}
    still = {tuple(r) for r in known.filter("gone = 0").collect() if tuple(r)[:3] not in {p[:3] for p in due}}
    for day, stream, batch_id in old:  # replaced a compaction ago, and named as such until the next line
        path, files = located(spark, f"{batch_folder(f'{home}/minute', stream, batch_id)}/event_date={day}")
        files.delete(path, True)
    kept.put(spark.createDataFrame(sorted(now | still, key=str), REPLACED_SCHEMA), COMPACT, turn)
    return len({p[0] for p in due})


def reader(spark: SparkSession, home: str) -> pyramid.Reader:
    def read(level: str, ranges: list[tuple[int, int]]) -> DataFrame:
        dated = level == "minute"
        rows = _live_minutes(spark, home) if dated else _read(spark, home, level, LEVEL_SCHEMA)
        inside = lambda c, f: reduce(Column.__or__, (c.between(f(a), f(b)) for a, b in ranges))
        rows = rows.filter(inside(F.col("minute"), F.lit))
        return rows.filter(inside(F.col("event_date"), lambda m: _day(F.lit(m).cast("long")))) if dated else rows

    return read


def latencies(spark: SparkSession, home: str) -> pyramid.Latencies:
    def read(low: int, high: int) -> DataFrame:
        rows, day = _read(spark, home, "latency", LATENCY_SCHEMA), lambda m: _day(F.lit(m).cast("long"))
        return rows.filter(F.col("minute").between(low, high) & F.col("event_date").between(day(low), day(high))).select("series", "minute", "latency_ms")

    return read


def stored_window(spark: SparkSession, home: str, window: str | int, quantile: float = 0.95, as_of_minute: Minute | None = None, exact: bool = False) -> DataFrame:
    """The rolling window of every series of the store.

    ``exact`` selects the latency quantile from the stored latencies of the window, else it
    is the sketches', within their rank error. A store that was written before latencies
    were kept has sketches only.
    """
    return pyramid.stored_window(reader(spark, home), catalogue(spark, home), window, quantile, as_of_minute, latencies(spark, home) if exact else None)


def stored_budgets(spark: SparkSession, home: str, slos: DataFrame, tiers: tuple = slo.DEFAULT_TIERS, as_of_minute: int | None = None) -> DataFrame:
    """``slo.budgets`` from the store: no event is read, and of the history only the blocks that windows end on."""
    return slo.budgets_from_blocks(reader(spark, home), catalogue(spark, home), slos, tiers, as_of_minute)
