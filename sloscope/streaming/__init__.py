"""Structured Streaming forms of ingest, buckets and detectors."""
