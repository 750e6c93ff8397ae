"""Observability analytics for inference services on Spark: the names most callers need."""

from sloscope.operators.anomaly import detect, detectors_for, ring, threshold_detector, zscore_detector
from sloscope.operators.buckets import merge_buckets, minute_buckets, retain_newest
from sloscope.operators.incident import incident_context, prompt, report, summarise
from sloscope.operators.slo import budgets, evaluate, fired_count, flat_alerts, timeline
from sloscope.operators.windows import UnknownModel, latency_above, model_query, require_model, snapshot_all, window_query
from sloscope.session import local_session, session
from sloscope.sources.config import Slo, load_config, slo_table
from sloscope.sources.events import EVENT_SCHEMA, batch_reply, from_event_table, parse_batches, parse_events

__all__ = [
    "EVENT_SCHEMA", "Slo", "UnknownModel", "batch_reply", "budgets", "detect", "detectors_for", "evaluate", "fired_count", "flat_alerts", "from_event_table",
    "incident_context", "latency_above", "load_config", "local_session", "merge_buckets", "minute_buckets", "model_query", "parse_batches", "parse_events", "prompt",
    "report", "require_model", "retain_newest", "ring", "session", "slo_table", "snapshot_all", "summarise", "threshold_detector", "timeline", "window_query", "zscore_detector",
]
