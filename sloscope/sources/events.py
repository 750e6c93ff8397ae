"""Event schema, JSON ingest and the adapter from the generic ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sloscope.functions.scalars import STATUSES

#: As on the wire; ``arrival_seq`` is added by whatever reads the events.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
COLUMNS = ("arrival_seq", "ts_nanos", "model", "model_version", "latency_ms", "status", "input_tokens", "output_tokens", "cost_usd", "metadata")
#: Limits of an ingest request.
MOST_BYTES, MOST_EVENTS = 1 << 20, 1000
#: Arrival numbers that a batch has for its events.
BATCH_SPAN = 1024
_U32_MAX = 2**32 - 1


def empty_metadata() -> Column:
    return F.create_map().cast("map<string,string>")


def _tidy(rows: DataFrame, event: str, *carried: str) -> DataFrame:
    at = lambda name: F.col(f"{event}.{name}")
    return rows.select(
        *carried,
        at("timestamp").alias("ts_nanos"), at("model").alias("model"), at("model_version").alias("model_version"), at("latency_ms").alias("latency_ms"),
        at("status").alias("status"), at("input_tokens").alias("input_tokens"), at("output_tokens").alias("output_tokens"), at("cost_usd").alias("cost_usd"),
        F.coalesce(at("metadata"), empty_metadata()).alias("metadata"),
    )


def valid() -> Column:
    """All required fields are there and in their domains."""
    token = lambda c: F.col(c).isNull() | F.col(c).between(0, _U32_MAX)
    required = [F.col(c).isNotNull() for c in ("ts_nanos", "model", "model_version", "latency_ms")]
    ok = (F.col("ts_nanos") >= 0) & F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)) & token("input_tokens") & token("output_tokens")
    for r in required:
        ok = ok & r
    return F.coalesce(ok, F.lit(False))


def _parsed(value: str, kind: T.DataType) -> Column:
    """The parsed message as a generator's output: used many times over, it is still parsed once."""
    return F.explode_outer(F.array(F.from_json(value, kind)))


def parse_events(messages: DataFrame, value: str = "value", seq: str = "arrival_seq") -> DataFrame:
    """One JSON event in each message; messages that are none, or too long, are left out. Works on streams."""
    parsed = messages.filter(F.octet_length(value) <= MOST_BYTES).select(F.col(seq).alias("arrival_seq"), _parsed(value, EVENT_SCHEMA).alias("_event"))
    return _tidy(parsed.filter("_event IS NOT NULL"), "_event", "arrival_seq").filter(valid())


def parse_batches(messages: DataFrame, value: str = "value", seq: str = "arrival_seq") -> DataFrame:
    """A JSON array of events in each message, refused whole if it has more than MOST_EVENTS or a bad event.

    Events arrive in the order of ``seq``, then of their place in the array: ``arrival_seq`` is a long of both.
    """
    parsed = messages.filter(F.octet_length(value) <= MOST_BYTES).select(F.col(seq).alias("batch_seq"), _parsed(value, T.ArrayType(EVENT_SCHEMA)).alias("_events"))
    parsed = parsed.filter(F.size("_events").between(0, MOST_EVENTS))
    whole = parsed.filter(F.forall("_events", lambda e: F.coalesce(_complete(e), F.lit(False))))
    rows = whole.select("batch_seq", F.posexplode("_events").alias("place", "_event"))
    return _tidy(rows.withColumn("arrival_seq", F.col("batch_seq").cast("long") * BATCH_SPAN + F.col("place")), "_event", "arrival_seq").filter(valid())


def _complete(event: Column) -> Column:
    """As ``valid`` for the required fields of a parsed event."""
    ok = event["status"].isin(*STATUSES) & (event["timestamp"] >= 0)
    for f in ("model", "model_version", "latency_ms"):
        ok = ok & event[f].isNotNull()
    return ok


def batch_reply(messages: DataFrame, value: str = "value") -> DataFrame:
    """For each message the status an ingest endpoint would give (202, 400 or 413) and the events it took."""
    parsed = messages.select("*", _parsed(value, T.ArrayType(EVENT_SCHEMA)).alias("_events"))
    good = F.coalesce(F.forall("_events", lambda e: F.coalesce(_complete(e), F.lit(False))), F.lit(False))
    code = F.when((F.octet_length(value) > MOST_BYTES) | (F.size("_events") > MOST_EVENTS), 413).when(good, 202).otherwise(400)
    out = parsed.withColumn("http_status", code)
    return out.withColumn("ingested", F.when(F.col("http_status") == 202, F.size("_events")).otherwise(0).cast("long")).drop("_events")


def to_wire(events: DataFrame) -> DataFrame:
    """``arrival_seq`` and the JSON of each event; a latency that JSON can't hold becomes null."""
    latency = F.when(F.abs("latency_ms") < F.lit(float("inf")), F.col("latency_ms"))
    event = F.struct(F.col("ts_nanos").alias("timestamp"), "model", "model_version", latency.alias("latency_ms"), "status", "input_tokens", "output_tokens", "cost_usd", "metadata")
    return events.select("arrival_seq", F.to_json(event).alias("value"))


def from_event_table(table: DataFrame, region: bool = False) -> DataFrame:
    """The generic ``events`` table (event_id, ts, user_id, event_type, value, props) as inference events."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table.select("*", k.alias("k"))
    status = (
        F.when((F.col("event_type") == "error") & (F.col("k") < 60), "server_error")
        .when(F.col("event_type") == "error", "timeout")
        .when((F.col("event_type") == "view") & (F.col("k") < 25), "client_error")
        .otherwise("success")
    )
    metadata = F.create_map(F.lit("region"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string"))) if region else empty_metadata()
    return rows.select(
        F.col("event_id").alias("arrival_seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_nanos"),
        F.concat(F.lit("model-"), (F.col("user_id") % 8).cast("string")).alias("model"),
        F.concat(F.lit("v"), F.expr("1 + k div 50").cast("string")).alias("model_version"),
        F.col("value").cast("double").alias("latency_ms"), status.alias("status"),
        (F.lit(50) + 7 * F.col("k")).cast("long").alias("input_tokens"), (2 * F.col("k")).cast("long").alias("output_tokens"),
        ((F.lit(50) + 7 * F.col("k") + 4 * F.col("k")).cast("double") * F.lit(2e-6)).alias("cost_usd"),
        metadata.alias("metadata"),
    )
